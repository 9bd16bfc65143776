"""Queries of the reading family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.operators import lexical, retrieval
from corpusloom.plans.registry import query
from corpusloom.tables import LINES, documents, lines_of, table, verses, words

#: The interval the passage queries read: lines 8 to 12 of document 8.
START, END = 8_000_008, 8_000_012


@query("SELECT verse_id, book_num, text FROM verses WHERE verse_id BETWEEN 8000008 AND 8000012 OR (bridge_end IS NOT NULL AND verse_id < 8000008 AND bridge_end >= 8000008)", "verses")
def passage_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.passage(verses(spark, sf_dir, [(START, END)]), START, END).select("verse_id", "book_num", "text")


@query("SELECT verse_id, text FROM verses WHERE verse_id BETWEEN 1000000 AND 3999999 OR verse_id BETWEEN 40000000 AND 41999999", "verses")
def passage_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = [(1_000_000, 3_999_999), (40_000_000, 41_999_999)]
    return verses(spark, sf_dir, scope).where(retrieval.in_scope("verse_id", scope)).select("verse_id", "text")


@query(
    """same AS (SELECT * FROM verses WHERE book_num = (SELECT min(book_num) FROM verses WHERE verse_id BETWEEN 8000008 AND 8000012))
SELECT verse_id, side FROM (
  (SELECT verse_id, 'before' AS side FROM same WHERE verse_id < 8000008 ORDER BY verse_id DESC LIMIT 3)
  UNION ALL (SELECT verse_id, 'after' AS side FROM same WHERE verse_id > 8000012 ORDER BY verse_id LIMIT 3))""",
    "verses",
)
def context_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.neighbouring_documents(documents(spark, sf_dir), "source", START // LINES, END // LINES, 3)
    return retrieval.neighbours(lines_of(near), START, END, 3).select("verse_id", "side")


@query(
    """SELECT conv_id, min(text) FILTER (role = 'user') AS "user", min(text) FILTER (role = 'assistant') AS assistant, min(text) FILTER (role = 'system') AS "system"
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role IN ('user', 'assistant', 'system') AND text IS NOT NULL) > 0"""
)
def compare_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.compare(table(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant", "system"])


@query("SELECT verse_id, word_num, surface, lemma FROM words WHERE verse_id BETWEEN 8000008 AND 8000037", "words")
def interlinear_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir, [(8_000_008, 8_000_037)]).where(F.col("verse_id").between(8_000_008, 8_000_037)).select("verse_id", "word_num", "surface", "lemma")


@query(
    """WITH RECURSIVE c AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (SELECT source, doc_id, n, k, 1::BIGINT AS chunk, n AS held FROM c WHERE k = 1
  UNION ALL SELECT c.source, c.doc_id, c.n, c.k, CASE WHEN p.held + c.n > 12000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.held + c.n > 12000 THEN c.n ELSE p.held + c.n END
  FROM p JOIN c ON c.source = p.source AND c.k = p.k + 1)
SELECT source, chunk, min(doc_id) AS first, max(doc_id) AS last, count(*)::BIGINT AS chapters, sum(n)::BIGINT AS chars FROM p GROUP BY source, chunk"""
)
def read_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return retrieval.chunks(chapters, "source", "doc_id", "n", 12_000)


@query(
    r"""freq AS (SELECT lemma, count(*) AS f FROM words GROUP BY lemma),
r AS (SELECT doc_id, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY f, lemma) AS k FROM (SELECT DISTINCT doc_id, lemma FROM words) JOIN freq USING (lemma)),
t AS (SELECT doc_id, string_agg(lemma, ',' ORDER BY k) AS rarest FROM r WHERE k <= 2 GROUP BY doc_id),
h AS (SELECT doc_id, count(*)::BIGINT AS n_verses, arg_min(text, verse) AS first FROM verses GROUP BY doc_id)
SELECT doc_id, n_verses, array_to_string(regexp_split_to_array(trim(first), '\s+')[1:9], ' ') AS incipit, rarest FROM h LEFT JOIN t USING (doc_id)""",
    "words",
)
def outline_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.outline(verses(spark, sf_dir), words(spark, sf_dir))


@query(
    """f AS (SELECT lemma, surface, count(*) AS n FROM words GROUP BY ALL), g AS (SELECT lemma, surface AS gloss FROM f QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY n DESC, surface) = 1)
SELECT verse_id, word_num, left(surface, 3) || CASE WHEN length(surface) > 3 THEN '+' || substr(surface, 4) ELSE '' END AS parts, gloss,
  concat_ws(' ', CASE WHEN regexp_matches(surface, '^\\p{Lu}') THEN 'upper' ELSE 'lower' END, right(lemma, 2)) AS morph
FROM words JOIN g USING (lemma) WHERE verse_id BETWEEN 8000008 AND 8000037""".replace("\\\\p", "\\p"),
    "words",
)
def interlinear_glossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a passage with its parts, its usual form as gloss, and its attributes. Only lemmas of the passage are tallied."""
    here = words(spark, sf_dir, [(8_000_008, 8_000_037)]).where(F.col("verse_id").between(8_000_008, 8_000_037))
    gloss = lexical.majority(words(spark, sf_dir).join(here.select("lemma").distinct(), "lemma", "left_semi"), "lemma", "surface").select("lemma", F.col("surface").alias("gloss"))
    parts = F.concat(F.left("surface", F.lit(3)), F.when(F.length("surface") > 3, F.concat(F.lit("+"), F.substring("surface", 4, 1 << 30))).otherwise(""))
    shape = F.when(F.col("surface").rlike(r"^\p{Lu}"), "upper").otherwise("lower")
    return here.join(gloss, "lemma").select("verse_id", "word_num", parts.alias("parts"), "gloss", scalar.summary(shape, F.right(F.col("lemma"), F.lit(2))).alias("morph"))
