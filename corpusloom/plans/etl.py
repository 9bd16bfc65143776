"""Queries of the ingest and verification family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup, scalar
from corpusloom.operators import structure
from corpusloom.plans.registry import query
from corpusloom.session import read_only_sql
from corpusloom.tables import table, words


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br */?>|</p>|</div>|</li>', chr(10), 'g'), '<[^>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM pages"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_to_text("html").alias("text"))


@query(r"SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '/(\w\w)/\d+', 1) AS lang, TRY_CAST(nullif(regexp_extract(url, '/\w\w/(\d+)', 1), '') AS BIGINT) AS num FROM pages")
def url_reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part(r"^(\w+)://").alias("scheme"), part(r"/(\w\w)/\d+").alias("lang"), F.nullif(part(r"/\w\w/(\d+)"), F.lit("")).cast("long").alias("num"))


@query(
    """WITH d AS (SELECT doc_id, md5(text) AS body, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT body, doc_id, lang FROM d QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1"""
)
def import_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body"), "lang")
    on_spine = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return structure.first_wins(on_spine, "body", "doc_id").select("body", "doc_id", "lang")


@query("SELECT doc_id, lang, n_chars FROM documents SEMI JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_chars) = 1")
def import_on_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is on the spine, the first of each key."""
    return structure.import_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "n_chars")


@query("SELECT quality, toxic, doc_id FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id DESC) = 1")
def import_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.first_wins(table(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id", last=True)


@query("SELECT d.lang, count(*)::BIGINT AS off_spine FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY d.lang")
def import_off_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("off_spine"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(
    """u AS (SELECT lemma, left(lemma, 4) AS stem, count(*)::BIGINT AS n FROM words WHERE book_num = 2 GROUP BY ALL),
e AS (SELECT DISTINCT lemma, left(lemma, 4) AS stem FROM words WHERE book_num = 1)
SELECT lemma, n FROM u WHERE lemma NOT IN (SELECT lemma FROM e) AND stem NOT IN (SELECT stem FROM e)""",
    "words",
)
def gap_entries_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumn("stem", F.left("lemma", F.lit(4)))
    uses = w.where("book_num = 2").groupBy("lemma", "stem").agg(F.count("*").alias("n"))
    return structure.gaps(w.where("book_num = 1"), uses, "lemma", "stem").select("lemma", "n")


@query("SELECT 'N' AS kind, n_name AS name FROM nation UNION SELECT 'R', r_name FROM region UNION SELECT 'N', n_name FROM nation WHERE n_regionkey = 1")
def union_distinct_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    name = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("name"))
    return name(nation, "N", "n_name").union(name(table(spark, sf_dir, "region"), "R", "r_name")).union(name(nation.where("n_regionkey = 1"), "N", "n_name")).distinct()


@query("SELECT n_name, levenshtein('germny', lower(substr(n_name, 1, greatest(6, 3)))) AS distance FROM nation ORDER BY distance, n_name LIMIT 3")
def suggest_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.levenshtein(F.lit("germny"), F.lower(F.substring("n_name", 1, 6))).cast("long")
    return table(spark, sf_dir, "nation").select("n_name", distance.alias("distance")).orderBy("distance", "n_name").limit(3)


@query("SELECT o_orderkey, o_orderkey // 1000 AS chapter, o_orderkey % 1000 AS verse, CASE WHEN o_orderkey % 1000 = 0 THEN 'Book ' || (o_orderkey // 1000) || ' title' ELSE 'Book ' || (o_orderkey // 1000) || ':' || (o_orderkey % 1000) END AS ref FROM orders")
def spine_key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 1000").alias("chapter"), (F.col("o_orderkey") % 1000).alias("verse"))
    return o.withColumn("ref", F.concat(F.lit("Book "), F.col("chapter").cast("string"), F.when(F.col("verse") == 0, " title").otherwise(F.concat(F.lit(":"), F.col("verse").cast("string")))))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 10 + 0.5) / 10 AS tenth, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS cent FROM lineitem WHERE l_quantity > 0")
def rounding_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, unit = table(spark, sf_dir, "lineitem").where("l_quantity > 0"), F.col("l_extendedprice") / F.col("l_quantity")
    return line.select("l_orderkey", "l_linenumber", scalar.round_half_up(unit, 1).alias("tenth"), scalar.round_half_up(unit, 2).alias("cent"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.slug("p_name").alias("slug"))


@query("SELECT o_orderpriority AS priority, count(*)::BIGINT AS n, sum(o_totalprice)::DECIMAL(38, 2)::DOUBLE AS total FROM (SELECT o_orderpriority, o_totalprice::DECIMAL(18, 2) AS o_totalprice FROM orders) GROUP BY 1 ORDER BY 1 LIMIT 200")
def sql_readonly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over all tables, read-only, cut at a limit."""
    return read_only_sql(spark, sf_dir, "SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY 1", 200)
