"""Queries of the full-text family; verses are the lines of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, search
from corpusloom.plans.registry import query
from corpusloom.tables import table, verses

TOKENS_SQL = r"""t AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}''\-]+') AS k FROM verses)"""


def hits(spark: SparkSession, sf_dir: str, text: str, **how: bool) -> DataFrame:
    return search.search(verses(spark, sf_dir).select("verse_id", "book_num", "lang", "text"), text, **how)


@query(TOKENS_SQL + " SELECT verse_id FROM t WHERE list_contains(k, 'thing') AND list_contains(k, 'the') ORDER BY verse_id LIMIT 20", "verses")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "thing the").orderBy("verse_id").limit(20).select("verse_id")


@query(TOKENS_SQL + " SELECT verse_id FROM t WHERE (list_contains(k, 'idiot') OR list_contains(k, 'moron')) AND NOT list_contains(k, 'of')", "verses")
def search_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "(idiot OR moron) NOT of").select("verse_id")


@query(r"SELECT verse_id FROM verses WHERE ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}''\-]+'), ' ') || ' ' LIKE '% of the %'", "verses")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "of the", as_phrase=True).select("verse_id")


@query(TOKENS_SQL + " SELECT verse_id FROM t WHERE len(list_filter(k, lambda x: starts_with(x, 'worthl'))) > 0", "verses")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "worthl*").select("verse_id")


@query(TOKENS_SQL + " SELECT verse_id FROM t WHERE k[1] = 'the'", "verses")
def search_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "^the").select("verse_id")


@query(
    TOKENS_SQL + """, p AS (SELECT verse_id, unnest(k) AS w, unnest(range(len(k))) AS i FROM t)
SELECT DISTINCT a.verse_id FROM p a JOIN p b ON a.verse_id = b.verse_id AND a.w = 'thing' AND b.w = 'are' AND a.i <> b.i AND abs(a.i - b.i) - 1 <= 4""",
    "verses",
)
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "NEAR(thing are, 4)").select("verse_id")


@query(TOKENS_SQL + " SELECT count(DISTINCT verse_id)::BIGINT AS matching_verses, count(*)::BIGINT AS hits FROM t WHERE list_contains(k, 'qui') AND lang IN ('fr', 'es') AND (verse_id BETWEEN 0 AND 400000000)", "verses")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "qui").where(F.col("lang").isin("fr", "es") & retrieval.in_scope("verse_id", [(0, 400_000_000)]))
    return found.agg(F.countDistinct("verse_id").alias("matching_verses"), F.count("*").alias("hits"))


@query(TOKENS_SQL + " SELECT book_num, count(*)::BIGINT AS verses FROM t WHERE list_contains(k, 'that') GROUP BY book_num", "verses")
def search_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "that").groupBy("book_num").agg(F.count("*").alias("verses"))


@query(TOKENS_SQL + " SELECT verse_id FROM t WHERE len(list_filter(k, lambda x: regexp_full_match(x, 'thing(s|es|ed|ing)?'))) > 0", "verses")
def search_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "things", stemmed=True).select("verse_id")


@query(
    r"""w AS (SELECT verse_id, regexp_split_to_array(trim(text), '\s+') AS t FROM verses),
c AS (SELECT *, list_position(list_transform(t, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}''\-]+|[^\p{L}\p{N}''\-]+$', '', 'g')), 'pathetic') AS pos FROM w),
b AS (SELECT *, greatest(pos - 8, 1) AS low, least(pos + 8, len(t)) AS high FROM c WHERE pos > 0)
SELECT verse_id, (CASE WHEN low > 1 THEN '…' ELSE '' END) || array_to_string(list_transform(t[low:high], lambda x, i: CASE WHEN i + low - 1 = pos THEN '>>' || x || '<<' ELSE x END), ' ') || (CASE WHEN high < len(t) THEN '…' ELSE '' END) AS shown FROM b""",
    "verses",
)
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verses(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("pathetic")))
    return search.snippets(rows, "verse_id", "text", "pathetic", around=8)


PHRASE_SQL = r"""w AS (SELECT verse_id, regexp_split_to_array(trim(text), '\s+') AS t FROM verses),
c AS (SELECT *, list_transform(t, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}''\-]+|[^\p{L}\p{N}''\-]+$', '', 'g')) AS k FROM w),
h AS (SELECT *, list_filter(range(1, len(k)), lambda i: k[i] = 'of' AND starts_with(k[i + 1], 'th')) AS hits FROM c),
b AS (SELECT *, greatest(least(hits[1], len(t) - 31), 1) AS low FROM h WHERE len(hits) > 0),
s AS (SELECT *, least(low + 31, len(t)) AS high FROM b)"""


@query(
    PHRASE_SQL + """ SELECT verse_id, (CASE WHEN low > 1 THEN '…' ELSE '' END) || array_to_string(list_transform(t[low:high], lambda x, i:
  (CASE WHEN list_contains(hits, i + low - 1) THEN '>>' ELSE '' END) || x || (CASE WHEN list_contains(hits, i + low - 2) THEN '<<' ELSE '' END)), ' ') || (CASE WHEN high < len(t) THEN '…' ELSE '' END) AS shown FROM s""",
    "verses",
)
def search_snippet_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase whose last word is a prefix, every match in a window of 32 tokens marked."""
    rows = verses(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("of")))
    return search.snippets(rows, "verse_id", "text", "of th", prefix=True)


@query(r"SELECT page_id FROM pages WHERE ' ' || array_to_string(regexp_extract_all(lower(url), '[\p{L}\p{N}''\-]+'), ' ') || ' ' LIKE '% example com %' AND NOT ' ' || array_to_string(regexp_extract_all(lower(url), '[\p{L}\p{N}''\-]+'), ' ') || ' ' LIKE '% www%'")
def search_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query limited to one column of several."""
    return search.search(table(spark, sf_dir, "pages"), '"example com" NOT www*', column="url").select("page_id")


@query(
    TOKENS_SQL + """, c AS (SELECT lower(role) AS src, conv_id * 1000 + turn AS id FROM conversations WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}''\\-]+'), 'that'))
SELECT id, src FROM (SELECT verse_id AS id, 'doc' AS src FROM t WHERE list_contains(k, 'that') UNION ALL SELECT id, src FROM c) ORDER BY id, src LIMIT 21""".replace("\\\\", "\\"),
    "verses",
)
def search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections searched alike, merged in key order, with one row more than the limit to tell that it was cut."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lower("role").alias("src"), "text")
    lines = verses(spark, sf_dir).select(F.col("verse_id").alias("id"), F.lit("doc").alias("src"), "text")
    return search.search(lines.unionByName(turns), "that").orderBy("id", "src").limit(21).select("id", "src")
