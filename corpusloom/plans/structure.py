"""Queries of the structural family: clauses are conversations, editions are the event types of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import structure
from corpusloom.plans.lexical import TURN_WORDS_SQL, turn_words
from corpusloom.plans.registry import query
from corpusloom.tables import table


@query(
    "WITH " + TURN_WORDS_SQL + """ SELECT conv_id FROM (SELECT DISTINCT conv_id FROM tw) c
WHERE EXISTS (SELECT 1 FROM tw WHERE tw.conv_id = c.conv_id AND role = 'user' AND lemma = 'thing')
  AND EXISTS (SELECT 1 FROM tw WHERE tw.conv_id = c.conv_id AND role = 'assistant' AND lemma = 'and')
  AND EXISTS (SELECT 1 FROM tw WHERE tw.conv_id = c.conv_id AND lemma = 'of')"""
)
def syntax_multi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"subject": (F.col("role") == "user") & (F.col("lemma") == "thing"), "verb": (F.col("role") == "assistant") & (F.col("lemma") == "and"), "any": F.col("lemma") == "of"}
    return structure.clauses_with(turn_words(spark, sf_dir), "conv_id", tests)


@query("WITH " + TURN_WORDS_SQL + " SELECT role, count(DISTINCT conv_id)::BIGINT AS clauses FROM tw WHERE conv_id NOT IN (SELECT conv_id FROM tw WHERE lemma = 'that') GROUP BY role")
def syntax_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    tw = turn_words(spark, sf_dir)
    free = tw.groupBy("conv_id").agg(F.max(F.when(F.col("lemma") == "that", 1).otherwise(0)).alias("has")).where("has = 0").select("conv_id")
    return tw.join(free, "conv_id", "left_semi").groupBy("role").agg(F.countDistinct("conv_id").alias("clauses"))


@query(
    """WITH c AS (SELECT conv_id, min(turn) AS low, max(turn) AS high, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id, low, high, turns FROM c WHERE low <= 4 AND high >= 3 ORDER BY turns DESC, conv_id LIMIT 20"""
)
def syntax_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("*").alias("turns"))
    return c.where("low <= 4 and high >= 3").orderBy(F.desc("turns"), "conv_id").limit(20)


KINDS = ["click", "error", "signup", "purchase", "view", "other"]
BIT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {1 << i}" for i, k in enumerate(KINDS[:-1])) + " ELSE 32 END"
MASK_SQL = f"WITH m AS (SELECT user_id, bit_or({BIT})::INT AS mask, count(*)::BIGINT AS n FROM events WHERE value > 60 AND event_id % 3 = 0 GROUP BY user_id)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value > 60 and event_id % 3 = 0").groupBy("user_id").agg(F.bit_or(F.expr(BIT)).alias("mask"), F.count("*").alias("n"))


@query(MASK_SQL + " SELECT mask, bit_count(mask)::INT AS editions, count(*)::BIGINT AS users, min(user_id) AS first FROM m GROUP BY mask")
def variants_bitmask_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks(spark, sf_dir).groupBy("mask").agg(F.bit_count("mask").alias("editions"), F.count("*").alias("users"), F.min("user_id").alias("first"))


@query(MASK_SQL + " SELECT user_id, mask FROM m WHERE mask <> 0 AND bit_count(mask) < bit_count((SELECT bit_or(mask) FROM m))")
def variants_disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks(spark, sf_dir)
    every = m.agg(F.bit_or("mask").alias("every"))
    return m.crossJoin(F.broadcast(every)).where("mask <> 0 and bit_count(mask) < bit_count(every)").select("user_id", "mask")  # one row


@query(MASK_SQL + " SELECT user_id, rtrim(CASE WHEN (mask & 1) <> 0 THEN 'click,' ELSE '' END || CASE WHEN (mask & 8) <> 0 THEN 'purchase,' ELSE '' END, ',') AS names FROM m WHERE (mask & 9) <> 0 AND n >= 3")
def edition_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks(spark, sf_dir).where(structure.in_edition("mask", 9) & (F.col("n") >= 3))
    return m.select("user_id", structure.edition_names("mask", ["click", None, None, "purchase"]).alias("names"))


@query(MASK_SQL + " SELECT user_id, CASE WHEN mask & 31 = 0 AND n > 1 THEN 31 ELSE mask & 31 END AS mask FROM m")
def edition_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without any named kind count as in all of them, if they are busy."""
    m = masks(spark, sf_dir).select("user_id", F.col("mask").bitwiseAND(31).alias("mask"), (F.col("n") > 1).alias("busy"))
    return m.select("user_id", structure.effective_mask("mask", "busy", 31).alias("mask"))


PARTS_SQL = r"""p AS (SELECT doc_id, word_num, unnest(range(1, len(s) + 1)) AS part_num, unnest(s) AS surface, lang
  FROM (SELECT *, [left(surface, 3), substr(surface, 4)] AS s FROM words WHERE verse = 1))"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.tables import words

    w = words(spark, sf_dir).where("verse = 1")
    cut = F.posexplode(F.array(F.left("surface", F.lit(3)), F.substring("surface", 4, 1 << 30))).alias("at", "s")
    return w.select("doc_id", "word_num", "lang", cut).select("doc_id", "word_num", "lang", (F.col("at") + 1).alias("part_num"), F.col("s").alias("surface"))


@query(
    PARTS_SQL + """, s AS (SELECT doc_id, word_num, CASE WHEN min(lang) IN ('de') THEN arg_min(surface, part_num) ELSE string_agg(surface, '' ORDER BY part_num) END AS w FROM p GROUP BY ALL)
SELECT doc_id, string_agg(w, ' ' ORDER BY word_num) AS text FROM s GROUP BY doc_id""",
    "words",
)
def original_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reconstruct(parts(spark, sf_dir), "doc_id", ("de",))


@query(
    """e AS (SELECT doc_id, word_num, surface, ((word_num * 7 + length(surface)) % 7 + 1)::INT AS editions FROM words WHERE verse = 1
  UNION ALL SELECT doc_id, word_num, lemma || 'x', 5 FROM words WHERE verse = 1 AND word_num % 5 = 0),
x AS (SELECT doc_id, word_num, surface, i::INT AS edition, editions FROM e, (SELECT unnest([0, 1, 2]) AS i) WHERE (editions >> i) & 1 = 1),
r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, word_num, edition ORDER BY bit_count(editions), surface) = 1),
s AS (SELECT doc_id, edition, string_agg(surface, ' ' ORDER BY word_num) AS text FROM r GROUP BY ALL),
t AS (SELECT d.doc_id, n.i AS edition, coalesce(s.text, '') AS text FROM (SELECT DISTINCT doc_id FROM e) d CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS i) n LEFT JOIN s ON s.doc_id = d.doc_id AND s.edition = n.i)
SELECT doc_id, text, string_agg(edition::VARCHAR, ',' ORDER BY edition) AS editions FROM t GROUP BY doc_id, text""",
    "words",
)
def variants_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.tables import words

    w = words(spark, sf_dir).where("verse = 1")
    main = w.select("doc_id", "word_num", "surface", ((F.col("word_num") * 7 + F.length("surface")) % 7 + 1).cast("int").alias("editions"))
    other = w.where("word_num % 5 = 0").select("doc_id", "word_num", F.concat("lemma", F.lit("x")).alias("surface"), F.lit(5).alias("editions"))
    return structure.edition_texts(main.union(other), "doc_id", 3)


@query(
    """WITH m AS (SELECT s_suppkey AS key, s_nationkey AS id FROM supplier WHERE s_suppkey % 3 = 0)
SELECT l_orderkey, l_linenumber, coalesce(m.id, n.n_nationkey::INT)::INT AS resolved FROM lineitem
LEFT JOIN m ON l_suppkey = m.key LEFT JOIN nation n ON n.n_nationkey = l_suppkey WHERE l_orderkey < 200"""
)
def versification_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_orderkey < 200").select("l_orderkey", "l_linenumber", "l_suppkey")
    mapping = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("id"))
    spine = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return structure.mapped_key(line, mapping, spine, "l_suppkey").select("l_orderkey", "l_linenumber", F.col("resolved").cast("int").alias("resolved"))
