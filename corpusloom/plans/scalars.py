"""Queries of the scalar functions: references, codes, search forms, tiers, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalise, refs, scalar
from corpusloom.operators import retrieval
from corpusloom.plans.registry import query
from corpusloom.session import TABLES, describe
from corpusloom.tables import table, verses, words

#: A verse reference for each line item: book, chapter and verse are remainders.
REF_SQL = "WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber AS book, (l_suppkey % 20 + 1)::BIGINT AS chapter, (l_partkey % 30 + 1)::BIGINT AS verse FROM lineitem WHERE l_orderkey < 2000)"
NAMES = [b.name for b in refs.BOOKS[:7]]
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_orderkey < 2000")
    return line.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("book"), (F.col("l_suppkey") % 20 + 1).cast("long").alias("chapter"), (F.col("l_partkey") % 30 + 1).cast("long").alias("verse"))


def name_of(book: str):
    return F.get(F.array(*map(F.lit, NAMES)), F.col(book).cast("int") - 1)


@query(REF_SQL + " SELECT l_orderkey, l_linenumber, k AS key, (k // 1000000)::INT AS book, (k % 1000000 // 1000)::INT AS chapter FROM (SELECT *, (book * 1000 + chapter) * 1000 + verse AS k FROM r)")
def spine_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_references(spark, sf_dir).withColumn("key", refs.key_column("book", "chapter", "verse"))
    return r.select("l_orderkey", "l_linenumber", "key", refs.book_column("key").alias("book"), refs.chapter_column("key").alias("chapter"))


@query(
    REF_SQL + f""", k AS (SELECT *, {_NAMES_SQL}[book] || ' ' || chapter || ':' || verse || CASE WHEN verse % 3 = 0 THEN '-' || (verse + 2) ELSE '' END AS text FROM r WHERE chapter <= [50, 40, 27, 36, 34, 24, 21][book])
SELECT l_orderkey, l_linenumber, text, (book * 1000 + chapter) * 1000 + verse AS start, (book * 1000 + chapter) * 1000 + verse + CASE WHEN verse % 3 = 0 THEN 2 ELSE 0 END AS "end", CASE WHEN verse % 3 = 0 THEN 'range' ELSE 'verse' END AS kind FROM k"""
)
def reference_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written out, and read again."""
    chapters = F.get(F.array(*[F.lit(b.chapters) for b in refs.BOOKS[:7]]), F.col("book").cast("int") - 1)
    r = line_references(spark, sf_dir).where(F.col("chapter") <= chapters)
    tail = F.when(F.col("verse") % 3 == 0, F.concat(F.lit("-"), F.col("verse") + 2)).otherwise("")
    r = r.select("l_orderkey", "l_linenumber", F.concat(name_of("book"), F.lit(" "), "chapter", F.lit(":"), "verse", tail).alias("text")).withColumn("r", refs.reference_struct("text"))
    return r.select("l_orderkey", "l_linenumber", "text", "r.start", "r.end", "r.kind")


@query(
    REF_SQL + f""", s AS (SELECT *, chapter + l_linenumber % 2 AS last, CASE WHEN l_linenumber % 2 = 0 THEN verse + verse % 3 ELSE verse END AS stop FROM r)
SELECT l_orderkey, l_linenumber, {_NAMES_SQL}[book] || ' ' || chapter || ':' || verse || CASE WHEN last <> chapter THEN '-' || last || ':' || stop WHEN stop <> verse THEN '-' || stop ELSE '' END AS shown FROM s"""
)
def range_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest form of an interval of spine keys."""
    r = line_references(spark, sf_dir).withColumns({"start": refs.key_column("book", "chapter", "verse"), "name": name_of("book")})
    even = F.col("l_linenumber") % 2 == 0
    r = r.withColumn("stop", F.when(even, F.col("start") + F.col("verse") % 3).otherwise(F.col("start") + 1000))
    return r.select("l_orderkey", "l_linenumber", scalar.range_ref("name", "start", "stop").alias("shown"))


@query("SELECT DISTINCT n::INT AS lxx, CASE WHEN n <= 8 THEN n WHEN n BETWEEN 10 AND 112 THEN n + 1 WHEN n BETWEEN 116 AND 145 THEN n + 1 WHEN n >= 148 THEN n END::INT AS psalm FROM (SELECT p_partkey % 151 + 1 AS n FROM part)")
def psalm_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") % 151 + 1).cast("int").alias("lxx")).distinct()
    return n.select("lxx", refs.psalm_number(F.col("lxx")).cast("int").alias("psalm"))


@query("SELECT p_partkey, code, TRY_CAST(nullif(regexp_extract(code, '^[HG]([0-9]{1,4})[A-Za-z]?$', 1), '') AS INT) AS number FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'X' WHEN p_size % 2 = 0 THEN 'H' ELSE 'G' END || p_partkey * 7 || CASE WHEN p_size % 3 = 0 THEN 'a' ELSE '' END AS code FROM part)")
def dictionary_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.when(F.col("p_size") % 5 == 0, "X").when(F.col("p_size") % 2 == 0, "H").otherwise("G")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(letter, (F.col("p_partkey") * 7).cast("string"), F.when(F.col("p_size") % 3 == 0, "a").otherwise("")).alias("code"))
    return p.select("p_partkey", "code", normalise.strongs_number("code").alias("number"))


@query("SELECT surface, lang, strip_accents(lower(surface)) AS form, count(*)::BIGINT AS n FROM words WHERE verse = 1 GROUP BY surface, lang", "words")
def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without accents in lower case; each distinct word is normalised once."""
    w = words(spark, sf_dir).where("verse = 1").groupBy("surface", "lang").agg(F.count("*").alias("n"))
    return w.select("surface", "lang", normalise.normalised("surface", "lang").alias("form"), "n")


@query("SELECT verse_id, array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:4], ' ') AS opening FROM verses WHERE verse <= 2".replace("\\\\", "\\"), "verses")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses(spark, sf_dir).where("verse <= 2").select("verse_id", scalar.first_words("text", 4).alias("opening"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 5 THEN 'parallel' WHEN l_linenumber = 4 THEN 'allusion' ELSE 'echo' END AS tier FROM lineitem ORDER BY CASE tier WHEN 'parallel' THEN 0 WHEN 'allusion' THEN 1 ELSE 2 END, l_orderkey, l_linenumber LIMIT 30")
def tiers_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers sorted by rank, not by name."""
    rank = F.array_position(F.array(*map(F.lit, ["parallel", "allusion", "echo"])), F.col("tier"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.tier_of("l_linenumber").alias("tier"))
    return line.orderBy(rank, "l_orderkey", "l_linenumber").limit(30)


@query("SELECT verse_id, text FROM verses ORDER BY md5('7:' || verse_id), verse_id LIMIT 3", "verses")
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pick(verses(spark, sf_dir).select("verse_id", "text"), 7, 3)


@query("SELECT book_num, min(lang) AS lang, count(DISTINCT doc_id)::BIGINT AS chapters, count(*)::BIGINT AS verses, min(verse_id) AS first, max(verse_id) AS last FROM verses GROUP BY book_num", "verses")
def catalogue_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books that there are, with their chapters and ends."""
    v = verses(spark, sf_dir)
    return v.groupBy("book_num").agg(F.min("lang").alias("lang"), F.countDistinct("doc_id").alias("chapters"), F.count("*").alias("verses"), F.min("verse_id").alias("first"), F.max("verse_id").alias("last"))


@query("SELECT lang, count(*)::BIGINT AS documents, count(DISTINCT source)::BIGINT AS sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def catalogue_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("SELECT table_name AS \"table\", column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')")
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(spark, sf_dir).select("table", "column")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS rows FROM {t}" for t in TABLES))
def doctor_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that can be read, with their rows."""
    each = [table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t in TABLES]
    return reduce(DataFrame.union, each)


@query("WITH e AS (SELECT user_id, nullif(event_type, 'view') AS kind, event_id FROM events WHERE user_id < 300), n AS (SELECT user_id, kind, min(event_id) AS first FROM e GROUP BY ALL) SELECT e.event_id, n.first FROM e JOIN n ON e.user_id = n.user_id AND e.kind IS NOT DISTINCT FROM n.kind")
def null_safe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two columns, one of which may be null on both sides."""
    e = table(spark, sf_dir, "events").where("user_id < 300").select("user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"), "event_id")
    n = e.groupBy(F.col("user_id").alias("u"), F.col("kind").alias("k")).agg(F.min("event_id").alias("first"))
    return e.join(n, (F.col("user_id") == F.col("u")) & F.col("kind").eqNullSafe(F.col("k"))).select("event_id", "first")
