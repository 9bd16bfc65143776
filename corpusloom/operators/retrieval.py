"""Interval retrieval on the spine key: passages, neighbours, pivots, chunked reading, outlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.scalar import first_words
from corpusloom.staging import cut


def in_scope(key: str, scope: list[tuple[int, int]]) -> Column:
    """OR of inclusive ranges; an empty scope is no restriction."""
    return reduce(lambda a, b: a | b, [F.col(key).between(a, b) for a, b in scope]) if scope else F.lit(True)


def passage(verses: DataFrame, start: int, end: int) -> DataFrame:
    """Verses of the interval, and those before it whose bridge reaches into it."""
    bridged = F.col("bridge_end").isNotNull() & (F.col("verse_id") < start) & (F.col("bridge_end") >= start)
    return verses.where(F.col("verse_id").between(start, end) | bridged)


def overlapping(rows: DataFrame, low: str, high: str, start: int, end: int) -> DataFrame:
    """Rows whose own interval [low, high] meets [start, end]."""
    return rows.where((F.col(high) >= start) & (F.col(low) <= end))


def neighbours(verses: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """The n verses before and after the interval in its book, as side 'before' or 'after'; a bounded top-n on each side."""
    book = verses.where(F.col("verse_id").between(start, end)).agg(F.min("book_num").alias("b"))
    same = verses.join(F.broadcast(book), F.col("book_num") == F.col("b"), "left_semi")  # one row
    before = same.where(F.col("verse_id") < start).orderBy(F.desc("verse_id")).limit(n).withColumn("side", F.lit("before"))
    after = same.where(F.col("verse_id") > end).orderBy("verse_id").limit(n).withColumn("side", F.lit("after"))
    return before.unionByName(after)


def neighbouring_documents(docs: DataFrame, book: str, start: int, end: int, n: int) -> DataFrame:
    """Documents start to end and the n nearest on either side in the book of the first; each has a line, so they hold the
    n lines before and after. Which they are is found by ids alone, so the text of others isn't read."""
    ids = docs.select("doc_id", F.col(book).alias("book_"))
    own = ids.where(F.col("doc_id").between(start, end)).orderBy("doc_id").limit(1).select("book_")
    same = ids.join(F.broadcast(own), "book_", "left_semi").select("doc_id")  # one row
    before, after = same.where(F.col("doc_id") < start).orderBy(F.desc("doc_id")).limit(n), same.where(F.col("doc_id") > end).orderBy("doc_id").limit(n)
    some = before.union(after).union(ids.where(F.col("doc_id").between(start, end)).select("doc_id"))
    return docs.join(F.broadcast(some), "doc_id", "left_semi") if end - start < 1000 else docs.join(some, "doc_id", "left_semi")


def compare(texts: DataFrame, key: str, version: str, versions: list[str]) -> DataFrame:
    """One column of text for each version; keys that none of the versions has are left out."""
    out = texts.groupBy(key).pivot(version, versions).agg(F.min("text"))
    return out.where(reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in versions]))


def pick(verses: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """n verses drawn by a seed: those with the least digest of seed and key, so that equal seeds draw alike."""
    return verses.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("verse_id").cast("string"))), "verse_id").limit(n)


def chunks(chapters: DataFrame, book: str, order: str, size: str, budget: int) -> DataFrame:
    """Greedy packing of each book's chapters in order: a chunk closes when the next chapter would exceed the budget.

    A chapter above the budget is a chunk of its own. The fold over a book's sizes keeps the number of the first chapter of
    each chunk only, and chapters are numbered and tallied by these afterwards.
    """
    listed = chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("key"), F.col(size).cast("long").alias("size")))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["at"] == 0) | (acc["held"] + x["size"] > budget)
        return F.struct(F.when(new, x["size"]).otherwise(acc["held"] + x["size"]).alias("held"), (acc["at"] + 1).alias("at"), F.when(new, F.concat(acc["heads"], F.array(acc["at"] + 1))).otherwise(acc["heads"]).alias("heads"))

    heads = listed.select(book, "c", F.aggregate("c", start, step, lambda acc: acc["heads"]).alias("heads"))
    each = heads.select(book, "c", "heads", F.posexplode("heads").alias("nth", "low"))
    part = F.slice("c", F.col("low"), F.coalesce(F.get("heads", F.col("nth") + 1), F.size("c") + 1) - F.col("low"))
    return each.select(book, (F.col("nth") + 1).cast("long").alias("chunk"), part.alias("p")).select(
        book, "chunk", F.get("p", F.lit(0))["key"].alias("first"), F.element_at("p", -1)["key"].alias("last"), F.size("p").cast("long").alias("chapters"),
        F.aggregate(F.transform("p", lambda x: x["size"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"),
    )


def outline(verses: DataFrame, words: DataFrame, rare: int = 2, incipit: int = 9, most: int = 20_000) -> DataFrame:
    """For each chapter: verses after the title, its first words, and its rarest lemmas by corpus frequency.

    The frequencies of the `most` commonest lemmas, which make up the bulk of a text, go to the tasks, where each chapter keeps
    its rarest; only the other lemmas are joined to theirs.
    """
    heads = verses.groupBy("doc_id").agg(F.count(F.when(F.col("verse") > 0, 1)).alias("n_verses"), F.min_by("text", "verse").alias("first"))
    opening = first_words("first", incipit)
    said = cut(words.select("doc_id", "lemma"), "vocabulary")  # the words are read once
    freq = cut(said.groupBy("lemma").agg(F.count("*").alias("freq")), "frequencies")
    named = said.join(F.broadcast(freq.orderBy(F.desc("freq"), "lemma").limit(most)), "lemma", "left").select("doc_id", "lemma", "freq")
    others = named.where("freq is null").select("doc_id", "lemma").distinct().join(freq, "lemma").select("doc_id", "lemma", "freq")
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("freq", "lemma"))  # repeated lemmas count once; limited before the shuffle
    top = named.where("freq is not null").union(others).withColumn("k", rank).where(F.col("k") <= rare)
    top = top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("k", "lemma"))), lambda x: x["lemma"]), ",").alias("rarest"))
    return heads.select("doc_id", "n_verses", opening.alias("incipit")).join(top, "doc_id", "left")


def check_on_spine(spine: DataFrame, keys: list[int]) -> None:
    """Raise ValueError for a verse key that isn't on the spine; the message names the last verse of its chapter.

    Verse 0 and 999 are open ends and always pass. One bounded look-up for all keys.
    """
    wanted = [k for k in keys if k % 1000 not in (0, 999)]
    chapters = sorted({k // 1000 for k in wanted})
    if not chapters:
        return
    rows = spine.where(F.expr("verse_id div 1000").isin(chapters)).groupBy(F.expr("verse_id div 1000").alias("ch")).agg(F.max("verse_id").alias("last"), F.collect_set(F.when(F.col("verse_id").isin(wanted), F.col("verse_id"))).alias("have")).collect()
    have, last = {k for r in rows for k in r.have}, {r.ch: r.last for r in rows}
    for k in wanted:
        if k not in have:
            end = last.get(k // 1000)
            raise ValueError(f"{k} is not there; " + (f"its chapter ends at {end}" if end else "its chapter has no verses"))


def guard_size(spine: DataFrame, start: int, end: int, most: int) -> None:
    """Raise ValueError if the interval holds more than `most` verses; at most one more than that is counted."""
    if spine.where(F.col("verse_id").between(start, end)).limit(most + 1).count() > most:
        raise ValueError(f"the range holds more than {most} verses")


def flow(verses: DataFrame) -> DataFrame:
    """(doc_id, text): each chapter as running text with [n] before each verse but the title."""
    piece = F.when(F.col("verse") == 0, F.col("text")).otherwise(F.concat(F.lit("["), F.col("verse").cast("string"), F.lit("] "), F.col("text")))
    parts = verses.select("doc_id", "verse", piece.alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("verse", "p"))).alias("x"))
    return parts.select("doc_id", F.array_join(F.transform("x", lambda r: r["p"]), " ").alias("text"))
