"""Queries of the lexical family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import lexical
from corpusloom.plans.registry import query
from corpusloom.tables import sequences, table, tokens, verses, words

#: The passage that vocabulary queries start from: lines 1 to 12 of document 6.
PASSAGE = 6_000_001, 6_000_012


def passage_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir, [PASSAGE]).where(F.col("verse_id").between(*PASSAGE))


@query("SELECT surface, count(*)::BIGINT AS n, min(verse_id) AS first FROM words WHERE lemma = 'that' GROUP BY surface", "words")
def lemma_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.forms(words(spark, sf_dir), "that")


@query("SELECT verse_id, word_num, surface FROM words WHERE lemma = 'of' AND book_num BETWEEN 1 AND 3 ORDER BY verse_id, word_num LIMIT 50", "words")
def lemma_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = words(spark, sf_dir).where((F.col("lemma") == "of") & F.col("book_num").between(1, 3))
    return hit.orderBy("verse_id", "word_num").limit(50).select("verse_id", "word_num", "surface")


@query("SELECT count(*)::BIGINT AS total, count(DISTINCT verse_id)::BIGINT AS verses, count(DISTINCT doc_id)::BIGINT AS docs FROM words WHERE lemma = 'thing'", "words")
def lemma_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = words(spark, sf_dir).where(F.col("lemma") == "thing")
    return hit.agg(F.count("*").alias("total"), F.countDistinct("verse_id").alias("verses"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT book_num, count(*)::BIGINT AS n, count(DISTINCT verse_id)::BIGINT AS verses, min(verse_id) AS first FROM words WHERE lemma = 'the' GROUP BY book_num", "words")
def freq_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.frequency(words(spark, sf_dir), "the", F.col("book_num"), "book_num")


@query("SELECT CASE WHEN book_num <= 10 THEN 'first' ELSE 'second' END AS half, count(*)::BIGINT AS n, count(DISTINCT verse_id)::BIGINT AS verses, min(verse_id) AS first FROM words WHERE lemma = 'and' GROUP BY 1", "words")
def freq_by_testament_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.frequency(words(spark, sf_dir), "and", F.when(F.col("book_num") <= 10, "first").otherwise("second"), "half")


@query("SELECT lemma, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS n FROM words GROUP BY lemma HAVING count(DISTINCT doc_id) >= 3", "words")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two partial aggregates keep the shuffle at one row for each (lemma, document)
    once = words(spark, sf_dir).groupBy("lemma", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("lemma").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where("docs >= 3")


@query("SELECT lang, count(DISTINCT doc_id)::BIGINT AS docs FROM words WHERE lemma IN ('idiot', 'moron', 'scum') GROUP BY lang", "words")
def freq_word_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where(F.col("lemma").isin("idiot", "moron", "scum")).groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"))


@query(
    """SELECT verse_id FROM words WHERE lemma = 'the' INTERSECT SELECT verse_id FROM words WHERE lemma = 'of' INTERSECT SELECT verse_id FROM words WHERE lemma = 'thing'""",
    "words",
)
def cooccur_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.units_with_all(words(spark, sf_dir), ["the", "of", "thing"], "verse_id")


@query("SELECT doc_id FROM words WHERE lemma = 'idiot' INTERSECT SELECT doc_id FROM words WHERE lemma = 'clown'", "words")
def cooccur_chapter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.units_with_all(words(spark, sf_dir), ["idiot", "clown"], "doc_id")


@query(
    """p AS (SELECT lemma, count(*)::BIGINT AS in_passage FROM words WHERE verse_id BETWEEN 6000001 AND 6000012 GROUP BY lemma),
c AS (SELECT lemma, count(*)::BIGINT AS corpus FROM words GROUP BY lemma)
SELECT lemma, in_passage, corpus FROM p JOIN c USING (lemma) ORDER BY corpus, in_passage DESC, lemma LIMIT 30""",
    "words",
)
def cooccur_profile_rarest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rarest_in(words(spark, sf_dir), passage_words(spark, sf_dir), 30)


SIMILAR_SQL = """f AS (SELECT lemma, count(*) AS freq FROM words WHERE lemma IN (SELECT lemma FROM terms) GROUP BY lemma HAVING count(*) BETWEEN 1 AND 400),
s AS (SELECT verse_id, count(*)::BIGINT AS shared, sum(round(1 / ln(freq + 2), 6)::DECIMAL(18, 6))::DOUBLE AS score
  FROM (SELECT DISTINCT verse_id, lemma, freq FROM words JOIN f USING (lemma) WHERE verse_id NOT BETWEEN 6000001 AND 6000012) GROUP BY verse_id)
SELECT verse_id, shared, score FROM s WHERE shared >= 2 ORDER BY score DESC, verse_id LIMIT 15"""


@query("terms AS (SELECT DISTINCT lemma FROM words WHERE verse_id BETWEEN 6000001 AND 6000012), " + SIMILAR_SQL, "words")
def similar_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.similar(words(spark, sf_dir), passage_words(spark, sf_dir).select("lemma").distinct(), *PASSAGE)


@query(
    """own AS (SELECT DISTINCT lemma FROM words WHERE verse_id BETWEEN 6000001 AND 6000012),
links AS (SELECT DISTINCT lemma AS a, 're' || lemma AS b FROM words),
terms AS (SELECT lemma FROM own UNION SELECT b FROM links JOIN own ON a = lemma UNION SELECT a FROM links JOIN own ON b = lemma), """
    + SIMILAR_SQL,
    "words",
)
def similar_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    own = passage_words(spark, sf_dir).select("lemma").distinct()
    links = w.select(F.col("lemma").alias("a"), F.concat(F.lit("re"), "lemma").alias("b")).distinct()
    across = links.join(own, links["a"] == own["lemma"], "left_semi").select(F.col("b").alias("lemma")).union(links.join(own, links["b"] == own["lemma"], "left_semi").select("a"))
    return lexical.similar(w, own.union(across).distinct(), *PASSAGE)


@query(
    """vs AS (SELECT DISTINCT verse_id FROM words WHERE lemma = 'worthless'),
t AS (SELECT lemma, count(DISTINCT verse_id)::BIGINT AS together FROM words WHERE lemma <> 'worthless' AND verse_id IN (SELECT verse_id FROM vs) GROUP BY lemma HAVING count(DISTINCT verse_id) >= 3 ORDER BY together DESC, lemma LIMIT 60),
c AS (SELECT lemma, count(*)::BIGINT AS corpus FROM words GROUP BY lemma)
SELECT lemma, together, corpus FROM t JOIN c USING (lemma) WHERE corpus <= 500 ORDER BY together DESC, lemma LIMIT 8""",
    "words",
)
def survey_collocates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.collocates(sequences(verses(spark, sf_dir).select("verse_id", "text")), "worthless")


@query("SELECT count(*)::BIGINT AS total, count(DISTINCT verse_id)::BIGINT AS verses, count(DISTINCT book_num)::BIGINT AS books, min(verse_id) AS first, max(verse_id) AS last, count(CASE WHEN book_num <= 10 THEN 1 END)::BIGINT AS in_first_half FROM words WHERE lemma = 'worthless'", "words")
def survey_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = words(spark, sf_dir).where(F.col("lemma") == "worthless")
    return hit.agg(F.count("*").alias("total"), F.countDistinct("verse_id").alias("verses"), F.countDistinct("book_num").alias("books"), F.min("verse_id").alias("first"), F.max("verse_id").alias("last"), F.count(F.when(F.col("book_num") <= 10, 1)).alias("in_first_half"))


@query("SELECT book_num, count(*)::BIGINT AS n FROM words WHERE lemma = 'pathetic' GROUP BY book_num ORDER BY n DESC, book_num LIMIT 5", "words")
def survey_top_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where(F.col("lemma") == "pathetic").groupBy("book_num").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "book_num").limit(5)


@query("SELECT DISTINCT verse_id FROM words WHERE lemma = 'pathetic' ORDER BY verse_id LIMIT 8", "words")
def survey_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where(F.col("lemma") == "pathetic").select("verse_id").distinct().orderBy("verse_id").limit(8)


@query(
    """t AS (SELECT verse_id FROM words WHERE lemma = 'the' GROUP BY verse_id ORDER BY count(*) DESC, verse_id LIMIT 1)
SELECT l_orderkey AS src, l_partkey AS dst, l_quantity AS votes FROM lineitem WHERE l_orderkey = (SELECT verse_id % 1000 + 1 FROM t) ORDER BY votes DESC, dst LIMIT 5""",
    "words",
)
def survey_top_verse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = words(spark, sf_dir).where(F.col("lemma") == "the").groupBy("verse_id").count().orderBy(F.desc("count"), "verse_id").limit(1)
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("votes"))
    one = top.select((F.col("verse_id") % 1000 + 1).alias("src"))
    return edges.join(F.broadcast(one), "src", "left_semi").orderBy(F.desc("votes"), "dst").limit(5)


TURN_WORDS_SQL = r"""tw AS (SELECT conv_id, role, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS lemma FROM conversations)"""


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("verse_id"), F.col("role").alias("lang"), "text")
    return tokens(turns).select(F.col("verse_id").alias("conv_id"), F.col("lang").alias("role"), "lemma")


@query(
    "WITH " + TURN_WORDS_SQL + """, u AS (SELECT DISTINCT conv_id FROM tw WHERE role = 'user' AND lemma = 'thing'),
n AS (SELECT lemma, count(DISTINCT conv_id)::BIGINT AS n FROM tw WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM u) GROUP BY lemma HAVING count(DISTINCT conv_id) >= 3 ORDER BY n DESC, lemma LIMIT 6)
SELECT lemma, n, total FROM n, (SELECT count(*)::BIGINT AS total FROM u) WHERE n >= greatest(3.0, 0.3 * total) ORDER BY n DESC, lemma LIMIT 3"""
)
def survey_underlying(spark: SparkSession, sf_dir: str) -> DataFrame:
    tw = turn_words(spark, sf_dir)
    return lexical.underlying(tw.where("role = 'user'"), tw.where("role = 'assistant'"), "conv_id", "thing")


@query(
    """WITH s AS (
  SELECT 1 AS stage, p_partkey, p_name FROM part WHERE p_partkey::VARCHAR = 'brand#12'
  UNION ALL (SELECT 2, p_partkey, p_name FROM part WHERE p_name = 'brand#12' ORDER BY p_partkey LIMIT 8)
  UNION ALL (SELECT 3, p_partkey, p_name FROM part WHERE lower(p_brand) = 'brand#12' ORDER BY p_partkey LIMIT 8)
  UNION ALL (SELECT 4, p_partkey, p_name FROM part WHERE p_type ILIKE '%brand#12%' ORDER BY p_partkey LIMIT 12))
SELECT stage, p_partkey, p_name FROM s WHERE stage = (SELECT min(stage) FROM s)"""
)
def word_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, q = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "brand#12"
    cut = lambda test, n: part.where(test).orderBy("p_partkey").limit(n).select("p_partkey", "p_name")
    exact = part.where(F.col("p_partkey").cast("string") == q).select("p_partkey", "p_name")
    return lexical.cascade([exact, cut(F.col("p_name") == q, 8), cut(F.lower("p_brand") == q, 8), cut(F.col("p_type").ilike(f"%{q}%"), 12)])


@query(
    """WITH u AS (SELECT l_partkey, count(*)::BIGINT AS uses, count(DISTINCT l_suppkey)::BIGINT AS suppliers, min(l_orderkey) AS first FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_name, coalesce(uses, 0)::BIGINT AS uses, coalesce(suppliers, 0)::BIGINT AS suppliers, first FROM part LEFT JOIN u ON l_partkey = p_partkey WHERE p_size <= 3"""
)
def word_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size <= 3").select("p_partkey", "p_name")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    uses = line.groupBy("l_partkey").agg(F.count("*").alias("uses"), F.countDistinct("l_suppkey").alias("suppliers"), F.min("l_orderkey").alias("first"))
    out = part.join(uses, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("p_partkey", "p_name", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "first")


@query(
    """WITH f AS (SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000000%' ORDER BY c_name, c_custkey LIMIT 12)
SELECT c_custkey AS name_id, c_name AS name, count(DISTINCT o_custkey)::BIGINT AS keys, count(o_orderkey)::BIGINT AS total, min(o_orderkey) AS first, max(o_orderkey) AS last
FROM f LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
)
def name_prefix_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name_id"), F.col("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders")
    bridge = orders.select(F.col("o_custkey").alias("name_id"), F.col("o_custkey").alias("key")).distinct()
    return lexical.name_usage(names, bridge, orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("place")), "CUSTOMER#00000000")


EDGES_SQL = "WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst_start, l_partkey + l_linenumber AS dst_end, l_quantity AS votes FROM lineitem) "


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst_start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("dst_end"), F.col("l_quantity").alias("votes"))


@query(EDGES_SQL + "SELECT * FROM e WHERE src BETWEEN 100 AND 160 AND votes >= 5 ORDER BY votes DESC, src, dst_start LIMIT 20")
def xref_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.edges_from(edges(spark, sf_dir), 100, 160, 5, 20)


@query(EDGES_SQL + "SELECT * FROM e WHERE dst_start <= 60 AND dst_end >= 50 AND votes >= 5 ORDER BY votes DESC, src, dst_start LIMIT 20")
def xref_reverse_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.edges_into(edges(spark, sf_dir), 50, 60, 5, 20)


MORPH_SQL = r"""m AS (SELECT *, length(surface)::BIGINT AS size, CASE WHEN regexp_matches(surface, '^\p{Lu}') THEN 'upper' ELSE 'lower' END AS shape, right(lemma, 2) AS ending FROM words)"""


def attributes(w: DataFrame) -> DataFrame:
    shape = F.when(F.col("surface").rlike(r"^\p{Lu}"), "upper").otherwise("lower")
    return w.withColumns({"size": F.length("surface").cast("long"), "shape": shape, "ending": F.right(F.col("lemma"), F.lit(2))})


@query(MORPH_SQL + " SELECT verse_id, word_num, surface, size, shape, ending, concat_ws(' ', shape, ending, CASE WHEN size > 9 THEN 'long' END) AS summary FROM m WHERE verse_id BETWEEN 8000008 AND 8000017", "words")
def morph_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = attributes(words(spark, sf_dir, [(8_000_008, 8_000_017)])).where(F.col("verse_id").between(8_000_008, 8_000_017))
    return m.select("verse_id", "word_num", "surface", "size", "shape", "ending", F.concat_ws(" ", "shape", "ending", F.when(F.col("size") > 9, "long")).alias("summary"))


@query(MORPH_SQL + " SELECT verse_id, word_num, surface FROM m WHERE lang = 'en' AND shape = 'upper' AND size = 5 AND lemma GLOB 't*[!a-d]' ORDER BY verse_id, word_num LIMIT 50", "words")
def morph_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"lang": "en", "shape": "upper", "size": 5}
    m = attributes(words(spark, sf_dir)).where(lexical.conjunction([F.col(k) == v for k, v in wanted.items()] + [lexical.glob("lemma", "t*[!a-d]")]))
    return m.orderBy("verse_id", "word_num").limit(50).select("verse_id", "word_num", "surface")


@query(MORPH_SQL + " SELECT lemma, count(*)::BIGINT AS n FROM m WHERE lang = 'de' AND shape = 'upper' GROUP BY lemma ORDER BY n DESC, lemma LIMIT 40", "words")
def morph_count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = attributes(words(spark, sf_dir)).where("lang = 'de' and shape = 'upper'")
    return m.groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(40)


@query(MORPH_SQL + " SELECT lang, string_agg(DISTINCT shape, ',' ORDER BY shape) AS shapes, count(DISTINCT ending)::BIGINT AS endings, max(size) AS longest FROM m GROUP BY lang", "words")
def morph_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = attributes(words(spark, sf_dir))
    return m.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("shape")), ",").alias("shapes"), F.countDistinct("ending").alias("endings"), F.max("size").alias("longest"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type GLOB '*[A-M]*' AND p_brand GLOB 'Brand#1?'")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(lexical.glob("p_type", "*[A-M]*") & lexical.glob("p_brand", "Brand#1?")).select("p_partkey", "p_name", "p_type")


@query(
    """t AS (SELECT lemma, surface, count(*)::BIGINT AS n FROM words GROUP BY ALL)
SELECT lemma, surface, n FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, surface) AS k FROM t) WHERE k = 1""",
    "words",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.majority(words(spark, sf_dir), "lemma", "surface")


@query("SELECT lemma, min(surface) AS gloss, arg_min(verse_id, surface || lpad(verse_id::VARCHAR, 20, '0')) AS verse_id FROM words WHERE book_num = 1 GROUP BY lemma", "words")
def bare_column_of_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).where("book_num = 1")
    order = F.concat("surface", F.lpad(F.col("verse_id").cast("string"), 20, "0"))
    return w.groupBy("lemma").agg(F.min("surface").alias("gloss"), F.min_by("verse_id", order).alias("verse_id"))


#: Parts stand for dictionary entries, line items for the words of a text beside them; an order is a verse.
KEYS_SQL = """WITH e AS (SELECT p_partkey AS key, p_type AS lemma, p_brand AS translit, p_name AS gloss FROM part),
t AS (SELECT l_orderkey AS unit, l_linenumber AS key, lower(l_returnflag) AS word FROM lineitem),
u AS (SELECT DISTINCT unit FROM t WHERE word = '{low}'),
n AS (SELECT key, count(*) AS n FROM t WHERE unit IN (SELECT unit FROM u) GROUP BY key HAVING count(*) >= 3 ORDER BY n DESC, key LIMIT 6),
s AS ((SELECT DISTINCT key, 1 AS stage FROM e WHERE lower(key::VARCHAR) = '{low}' ORDER BY key LIMIT 8)
  UNION ALL (SELECT DISTINCT key, 2 FROM e WHERE lemma = '{word}' ORDER BY key LIMIT 8) UNION ALL (SELECT DISTINCT key, 3 FROM e WHERE lower(translit) = '{low}' ORDER BY key LIMIT 8)
  UNION ALL (SELECT DISTINCT key, 4 FROM e WHERE regexp_replace(lower(translit), '[^a-z]', '', 'g') = '{letters}' AND '{letters}' <> '' ORDER BY key LIMIT 8)
  UNION ALL (SELECT DISTINCT key, 5 FROM e WHERE contains(' ' || regexp_replace(lower(gloss), '[^a-z0-9]+', ' ', 'g') || ' ', ' {low} ') ORDER BY key LIMIT 12)
  UNION ALL (SELECT key, 6 FROM n WHERE n >= greatest(3.0, 0.5 * (SELECT count(*) FROM u))))
SELECT key::BIGINT AS key, stage::INT AS stage FROM s WHERE stage = (SELECT min(stage) FROM s)"""


def keys_sql(word: str) -> str:
    return KEYS_SQL.replace("{low}", word.lower()).replace("{word}", word).replace("{letters}", "".join(c for c in word.lower() if "a" <= c <= "z"))


def word_keys(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("lemma"), F.col("p_brand").alias("translit"), F.col("p_name").alias("gloss"))
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("long").alias("key"), F.lower("l_returnflag").alias("word"))
    return lexical.word_keys(entries, tokens, word)


@query(keys_sql("Bra.nd"))
def word_keys_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found by the letters of the transliteration alone."""
    return word_keys(spark, sf_dir, "Bra.nd")


@query(keys_sql("widget"))
def word_keys_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_keys(spark, sf_dir, "widget")


@query(keys_sql("R"))
def word_keys_underlying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No entry has the word; the keys beside it in the text are tried."""
    return word_keys(spark, sf_dir, "R")


@query(
    """t AS (SELECT surface, book_num, verse_id, count(*) AS n FROM words WHERE lemma = 'that' GROUP BY ALL),
f AS (SELECT string_agg(surface || ':' || n, ',' ORDER BY n DESC, surface) AS forms FROM (SELECT surface, sum(n)::BIGINT AS n FROM t GROUP BY surface ORDER BY n DESC, surface LIMIT 5)),
b AS (SELECT string_agg(book_num || ':' || n, ',' ORDER BY n DESC, book_num) AS books FROM (SELECT book_num, sum(n)::BIGINT AS n FROM t GROUP BY book_num ORDER BY n DESC, book_num LIMIT 5)),
i AS (SELECT string_agg(verse_id, ',' ORDER BY verse_id) AS firsts FROM (SELECT DISTINCT verse_id FROM t ORDER BY verse_id LIMIT 8))
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM t) AS total, (SELECT count(DISTINCT verse_id)::BIGINT FROM t) AS verses, (SELECT coalesce(sum(n) FILTER (book_num <= 10), 0)::BIGINT FROM t) AS before,
  (SELECT coalesce(sum(n) FILTER (book_num > 10), 0)::BIGINT FROM t) AS after, forms, books, firsts FROM f, b, i""",
    "words",
)
def survey_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.dossier(words(spark, sf_dir), "that", 10)


@query(
    """WITH e AS (SELECT o_custkey AS key, o_orderpriority AS lexicon, o_orderkey AS entry_id FROM orders)
SELECT key, lexicon, entry_id FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE lexicon WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, entry_id) = 1"""
)
def head_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("lexicon"), F.col("o_orderkey").alias("entry_id"))
    return lexical.head_entries(entries, ["1-URGENT", "3-MEDIUM"])
