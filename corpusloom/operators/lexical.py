"""Frequency, co-occurrence, collocation and similarity over words, and lookups over entries and edges."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.staging import cut


def conjunction(tests: list[Column]) -> Column:
    """AND of any subset of tests; none is no restriction."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def glob(col: str, pattern: str) -> Column:
    """Case-sensitive GLOB (* ? [..]) as one anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = re.sub(r"([\\\[\]&~])", r"\\\1", pattern[i + 1 : end])
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body) + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or ("\\" + c if not c.isalnum() and c != "_" else c)
        i += 1
    return F.col(col).rlike(f"^{out}$")


def forms(words: DataFrame, lemma: str) -> DataFrame:
    """Histogram of the surface forms of a lemma."""
    return words.where(F.col("lemma") == lemma).groupBy("surface").agg(F.count("*").alias("n"), F.min("verse_id").alias("first"))


def frequency(words: DataFrame, lemma: str, by: Column, name: str) -> DataFrame:
    """Occurrences and distinct verses of a lemma in each group."""
    hit = words.where(F.col("lemma") == lemma)
    return hit.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.countDistinct("verse_id").alias("verses"), F.min("verse_id").alias("first"))


def units_with_all(words: DataFrame, lemmas: list[str], unit: str) -> DataFrame:
    """Units (verses or chapters) that hold every lemma, in one scan."""
    hit = words.where(F.col("lemma").isin(lemmas))
    return hit.groupBy(unit).agg(F.countDistinct("lemma").alias("k")).where(F.col("k") == len(set(lemmas))).select(unit)


def rarest_in(words: DataFrame, passage: DataFrame, limit: int) -> DataFrame:
    """Vocabulary of a passage, its words, rarest in the corpus first. The passage's lemmas are few, so the corpus side is only filtered."""
    inside = passage.groupBy("lemma").agg(F.count("*").alias("in_passage"))
    corpus = words.join(inside, "lemma", "left_semi").groupBy("lemma").agg(F.count("*").alias("corpus"))
    return inside.join(corpus, "lemma").orderBy("corpus", F.desc("in_passage"), "lemma").limit(limit)


def similar(words: DataFrame, terms: DataFrame, start: int, end: int, most: int = 400, least: int = 2, limit: int = 15) -> DataFrame:
    """Verses outside [start, end] that share at least `least` of the terms (lemma) of corpus frequency up to `most`, by
    summed 1/ln(freq+2). The corpus is read once; what it has of the terms is tallied by verse and written."""
    held = cut(words.join(terms, "lemma", "left_semi").groupBy("verse_id", "lemma").agg(F.count("*").alias("n")), "terms")
    freq = held.groupBy("lemma").agg(F.sum("n").alias("freq")).where(F.col("freq").between(1, most))
    pairs = held.where(~F.col("verse_id").between(start, end)).join(freq, "lemma")
    # decimal sums don't depend on the order of addition
    weight = F.round(1 / F.log(F.col("freq") + 2), 6).cast("decimal(18,6)")
    scored = pairs.groupBy("verse_id").agg(F.count("*").alias("shared"), F.sum(weight).cast("double").alias("score"))
    return scored.where(F.col("shared") >= least).orderBy(F.desc("score"), "verse_id").limit(limit)


def collocates(seqs: DataFrame, lemma: str, least: int = 3, candidates: int = 60, most: int = 500, limit: int = 8) -> DataFrame:
    """Lemmas that share at least `least` units of seqs (unit, ws) with a lemma: the first `candidates`, then those of corpus
    frequency up to `most`. Only units that hold the lemma are taken apart for the first, and few words leave the second scan."""
    near = seqs.where(F.array_contains("ws", lemma)).select(F.explode(F.array_distinct("ws")).alias("lemma")).where(F.col("lemma") != lemma)
    top = near.groupBy("lemma").agg(F.count("*").alias("together")).where(F.col("together") >= least).orderBy(F.desc("together"), "lemma").limit(candidates)
    every = seqs.select(F.explode("ws").alias("lemma"))
    corpus = every.join(F.broadcast(top), "lemma", "left_semi").groupBy("lemma").agg(F.count("*").alias("corpus"))  # top has at most `candidates` rows
    return top.join(corpus, "lemma").where(F.col("corpus") <= most).orderBy(F.desc("together"), "lemma").limit(limit)


def underlying(left: DataFrame, right: DataFrame, unit: str, word: str, least: int = 3, top: int = 6, share: float = 0.3, keep: int = 3) -> DataFrame:
    """Words of the right side that explain a word of the left: those in enough of its units, kept above a share of them."""
    units = left.where(F.col("lemma") == word).select(unit).distinct()
    total = units.agg(F.count("*").alias("total"))
    found = right.join(units, unit, "left_semi").groupBy("lemma").agg(F.countDistinct(unit).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "lemma").limit(top)
    return found.crossJoin(total).where(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("total"))).orderBy(F.desc("n"), "lemma").limit(keep).select("lemma", "n", "total")


def cascade(stages: list[DataFrame]) -> DataFrame:
    """Rows of the first stage that has any, with its number from 1; every stage has the same columns."""
    every = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i + 1)) for i, s in enumerate(stages)])
    return every.join(F.broadcast(every.agg(F.min("stage").alias("stage"))), "stage", "left_semi")  # one row


def folded(col: str | Column) -> Column:
    """The letters a to z of a transliteration, in lower case."""
    return F.regexp_replace(F.lower(col), "[^a-z]", "")


def word_keys(entries: DataFrame, tokens: DataFrame, query: str, few: int = 8, many: int = 12, least: int = 3, top: int = 6, share: float = 0.5) -> DataFrame:
    """(key, stage): the entries that a query means, by the first stage that finds any.

    entries has key, lemma, translit and gloss; tokens has unit, key and word, what a reader's text has beside an entry's
    word. Stages: 1 the key itself, 2 the lemma, 3 the transliteration, 4 its letters alone, 5 a word of the gloss, 6 the
    keys under a reader's word: of the `top` keys with `least` places or more, those with a `share` of the word's units.
    """
    low = query.lower()
    cut = lambda test, n: entries.where(test).select("key").distinct().orderBy("key").limit(n)
    word = F.concat(F.lit(" "), F.regexp_replace(F.lower("gloss"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    units = tokens.where(F.col("word") == low).select("unit").distinct()
    under = tokens.join(units, "unit", "left_semi").where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(top)
    kept = under.crossJoin(units.agg(F.count("*").alias("total"))).where(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("total"))).select("key")  # one row
    letters = re.sub("[^a-z]", "", low)
    stages = [
        cut(F.lower(F.col("key").cast("string")) == low, few), cut(F.col("lemma") == query, few), cut(F.lower("translit") == low, few),
        cut((folded("translit") == letters) & F.lit(letters != ""), few), cut(F.contains(word, F.lit(f" {low} ")), many), kept,
    ]
    return cascade(stages)


def dossier(words: DataFrame, lemma: str, half: int, books: int = 5, firsts: int = 8, forms: int = 5) -> DataFrame:
    """One row on a lemma: uses, verses, uses up to and after the book `half`, its forms and books, most frequent first,
    and its first places. One scan, from tallies by form and verse."""
    tally = words.where(F.col("lemma") == lemma).groupBy("surface", "book_num", "verse_id").agg(F.count("*").alias("n"))

    def most(by: str, n: int, name: str) -> DataFrame:
        top = tally.groupBy(by).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), by).limit(n)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("back"), by)))
        return top.agg(F.array_join(F.transform(listed, lambda r: F.concat(r[by].cast("string"), F.lit(":"), (-r["back"]).cast("string"))), ",").alias(name))

    total = tally.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.countDistinct("verse_id").alias("verses"), F.coalesce(F.sum(F.when(F.col("book_num") <= half, F.col("n"))), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(F.col("book_num") > half, F.col("n"))), F.lit(0)).alias("after"))
    first = tally.select("verse_id").distinct().orderBy("verse_id").limit(firsts).agg(F.array_join(F.array_sort(F.collect_list("verse_id")).cast("array<string>"), ",").alias("firsts"))
    return total.crossJoin(most("surface", forms, "forms")).crossJoin(most("book_num", books, "books")).crossJoin(first)  # one row each


def head_entries(entries: DataFrame, priority: list[str]) -> DataFrame:
    """One entry for each key: that of the lexicon that comes first in the priority, then the least entry_id."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("lexicon"))
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.when(place > 0, place).otherwise(len(priority) + 1), "entry_id"))
    return entries.withColumn("k", k).where("k = 1").drop("k")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest."""
    tally = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return tally.withColumn("k", rank).where("k = 1").drop("k")


def name_usage(names: DataFrame, bridge: DataFrame, uses: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Entities whose name begins with the query in any case, with their keys and the total, first and last of their uses."""
    found = names.where(F.startswith(F.lower("name"), F.lower(F.lit(query)))).orderBy("name", "name_id").limit(limit)
    joined = found.join(bridge, "name_id", "left").join(uses, "key", "left")
    return joined.groupBy("name_id", "name").agg(F.countDistinct("key").alias("keys"), F.count("place").alias("total"), F.min("place").alias("first"), F.max("place").alias("last"))


def edges_from(edges: DataFrame, start: int, end: int, least: float, limit: int) -> DataFrame:
    """Ranked edges out of the interval."""
    return edges.where(F.col("src").between(start, end) & (F.col("votes") >= least)).orderBy(F.desc("votes"), "src", "dst_start").limit(limit)


def edges_into(edges: DataFrame, start: int, end: int, least: float, limit: int) -> DataFrame:
    """Ranked edges whose target interval meets the given one."""
    return edges.where((F.col("dst_start") <= end) & (F.col("dst_end") >= start) & (F.col("votes") >= least)).orderBy(F.desc("votes"), "src", "dst_start").limit(limit)
