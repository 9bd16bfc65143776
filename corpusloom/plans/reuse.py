"""Queries of the positional and reuse families: documents against the benchmark passages, and lines against lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import positional, reuse
from corpusloom.plans.registry import query
from corpusloom.tables import LINES, book_of, sequences, table, verses, words


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(verse_id, book_num, slots): the lemmas of every line, in order."""
    return sequences(verses(spark, sf_dir).select("verse_id", "book_num", "text")).withColumnRenamed("ws", "slots")


def starts_of(lines: DataFrame, items: list[str], slack: int = 0) -> DataFrame:
    # cheap tests of the whole text come first
    return positional.pattern_starts(lines.where(F.forall(F.array(*map(F.lit, set(items))), lambda w: F.array_contains("slots", w))), [positional.word_is(w) for w in items], slack)


@query("SELECT a.verse_id, a.book_num, a.word_num AS start FROM words a JOIN words b ON a.verse_id = b.verse_id AND b.word_num = a.word_num + 1 WHERE a.lemma = 'of' AND b.lemma = 'the'", "words")
def pattern_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts_of(lines(spark, sf_dir), ["of", "the"]).drop("end")


SLACK_SQL = """s AS (SELECT DISTINCT a.verse_id, a.book_num, a.word_num AS start FROM words a
  JOIN words b ON a.verse_id = b.verse_id AND b.word_num BETWEEN a.word_num + 1 AND a.word_num + 4
  JOIN words c ON b.verse_id = c.verse_id AND c.word_num BETWEEN b.word_num + 1 AND b.word_num + 4
  WHERE a.lemma = 'the' AND b.lemma = 'of' AND c.lemma = 'and')"""


@query(SLACK_SQL + " SELECT verse_id, book_num, start FROM s", "words")
def pattern_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts_of(lines(spark, sf_dir), ["the", "of", "and"], slack=3).drop("end")


@query(
    SLACK_SQL + """, n AS (SELECT book_num, count(*) AS slots FROM (SELECT DISTINCT verse_id, word_num, book_num FROM words) GROUP BY book_num),
o AS (SELECT book_num, count(*)::BIGINT AS observed FROM s GROUP BY book_num),
e AS (SELECT book_num, observed, (SELECT sum(observed) FROM o)::DOUBLE * slots / (SELECT sum(slots) FROM n)::DOUBLE AS x FROM o JOIN n USING (book_num))
SELECT book_num, observed, floor(x * 10 + 0.5) / 10 AS expected, CASE WHEN x > 0 THEN floor(observed / x * 10 + 0.5) / 10 END AS ratio FROM e""",
    "words",
)
def pattern_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return positional.concentration(starts_of(rows, ["the", "of", "and"], slack=3), rows.select("book_num", F.size("slots").alias("slots")))


FORMULA_SQL = r"""p AS (SELECT verse_id, doc_id, word_num, unnest([1, 2]) AS part_num, unnest(['H', 'G']) AS lang, unnest([length(surface), word_num % 9]) AS num,
    unnest([CASE WHEN length(surface) % 2 = 1 THEN 'a' END, NULL]) AS suffix, unnest([lemma, '']) AS lemma, unnest([surface, '+']) AS surface FROM words WHERE doc_id BETWEEN 2 AND 30),
i AS (SELECT verse_id, word_num, bool_or(lang = 'H' AND num = 3 AND suffix = 'a') AS x, bool_or(lang = 'G' AND num = 4) AS y FROM p GROUP BY ALL)"""


@query(
    FORMULA_SQL + """, t AS (SELECT verse_id, word_num, string_agg(surface, '' ORDER BY part_num) AS w FROM p GROUP BY ALL),
s AS (SELECT a.verse_id, a.word_num AS start, min(b.word_num) AS "end" FROM i a JOIN i b ON a.verse_id = b.verse_id AND b.word_num BETWEEN a.word_num + 1 AND a.word_num + 3 WHERE a.x AND b.y GROUP BY ALL)
SELECT s.verse_id, start, "end", (SELECT string_agg(w, ' ' ORDER BY word_num) FROM t WHERE t.verse_id = s.verse_id AND word_num BETWEEN start AND "end") AS text FROM s""",
    "words",
)
def pattern_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of numbers over slots of two parts, with slack, inside a scope; shown with its text."""
    w = words(spark, sf_dir, [(2_000_000, 30_999_999)])
    both = F.posexplode(F.array(
        F.struct(F.lit("H").alias("lang"), F.length("surface").cast("long").alias("n"), F.when(F.length("surface") % 2 == 1, "a").alias("x"), F.col("lemma").alias("l"), F.col("surface").alias("s")),
        F.struct(F.lit("G").alias("lang"), (F.col("word_num") % 9).alias("n"), F.lit(None).cast("string").alias("x"), F.lit("").alias("l"), F.lit("+").alias("s")),
    )).alias("at", "p")
    parts = w.select("verse_id", "word_num", both).select("verse_id", "word_num", (F.col("at") + 1).alias("part_num"), "p.lang", F.col("p.n").alias("strongs_num"), F.col("p.x").alias("strongs_suffix"), F.col("p.l").alias("lemma"), F.col("p.l").alias("lemma_norm"), F.col("p.s").alias("surface"))
    rows = positional.slots_of(parts).withColumn("all_", F.col("slots"))
    found = positional.pattern_starts(rows, [i.test for i in positional.parse_formula("H3a G4")], slack=2)
    return found.select("verse_id", "start", "end", positional.matched_text("all_", "start", "end").alias("text"))


def units(df: DataFrame, key: str) -> DataFrame:
    """(unit, ws): the lower-cased words of each row's text."""
    return sequences(df.where("text is not null").select(F.col(key).alias("unit"), "text"))


UNITS_SQL = r"""WITH d AS (SELECT unit, unnest(range(len(k))) AS pos, unnest(k) AS w FROM (SELECT doc_id AS unit, regexp_extract_all(lower(text), '\p{L}+') AS k FROM documents)),
q AS (SELECT unit, unnest(range(len(k))) AS pos, unnest(k) AS w FROM (SELECT item_id AS unit, regexp_extract_all(lower(text), '\p{L}+') AS k FROM benchmark)),
freq AS (SELECT w, count(*) AS n FROM (SELECT w FROM d UNION ALL SELECT w FROM q) GROUP BY w)"""


def runs_sql(n: int, cap: int) -> str:
    """The runs of cross_runs as common table expressions ending in `runs` and `best`."""
    leads = ", ".join(f"lead(w, {k}) OVER l" if k else "w" for k in range(n))
    gram = lambda t: f"SELECT unit, pos, [{leads}] AS g FROM {t} WINDOW l AS (PARTITION BY unit ORDER BY pos) QUALIFY lead(w, {n - 1}) OVER l IS NOT NULL"
    return f""", dg AS ({gram("d")}), qg AS ({gram("q")}),
live AS (SELECT * FROM qg QUALIFY count(*) OVER (PARTITION BY g) <= {cap}),
hits AS (SELECT dg.unit AS a, live.unit AS b, live.pos - dg.pos AS diag, dg.pos AS pa FROM dg JOIN live USING (g)),
diags AS (SELECT DISTINCT a, b, diag FROM hits),
cells AS (SELECT a, b, diag, x.pos AS pa, x.pos - row_number() OVER (PARTITION BY a, b, diag ORDER BY x.pos) AS isle
  FROM diags JOIN d x ON x.unit = a JOIN q y ON y.unit = b AND y.pos = x.pos + diag AND y.w = x.w),
isles AS (SELECT a, b, diag, min(pa) AS s, count(*) AS len FROM cells GROUP BY a, b, diag, isle),
runs AS (SELECT a, b, diag, min(pa) AS start, len - min(pa) + s AS len FROM isles JOIN hits USING (a, b, diag) WHERE pa BETWEEN s AND s + len - {n} GROUP BY a, b, diag, s, len),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len DESC, start, diag) = 1),
rare AS (SELECT a, b, min(n) AS least FROM best JOIN d ON d.unit = a AND d.pos BETWEEN start AND start + len - 1 JOIN freq USING (w) GROUP BY a, b)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return units(table(spark, sf_dir, "documents"), "doc_id"), units(table(spark, sf_dir, "benchmark"), "item_id")


@query(UNITS_SQL + runs_sql(4, 40) + " SELECT a, b, start, len::BIGINT AS len FROM best")
def quotes_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.best_runs(*sides(spark, sf_dir), (4, 40))[0].select("a", "b", "start", "len")


QUOTES_SQL = "SELECT a, b, len::BIGINT AS len, start, CASE WHEN len >= 5 THEN 'quotation' ELSE 'allusion' END AS tier FROM best LEFT JOIN rare USING (a, b) WHERE len >= 5 OR least <= 300"


@query(UNITS_SQL + runs_sql(4, 40) + " " + QUOTES_SQL)
def quotes_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.quotes(*sides(spark, sf_dir))


@query(
    UNITS_SQL + runs_sql(4, 40) + """, f AS (SELECT w FROM freq WHERE n <= 25 AND length(w) >= 4),
e AS (SELECT d.unit AS a, q.unit AS b, count(DISTINCT w)::BIGINT AS shared FROM f JOIN d USING (w) JOIN q USING (w) GROUP BY ALL HAVING count(DISTINCT w) >= 2)
SELECT a, b, shared FROM e ANTI JOIN best USING (a, b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 5"""
)
def quotes_echo_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return reuse.echoes(left, right, reuse.best_runs(left, right, (4, 40))[0].select("a", "b"))


@query(UNITS_SQL + runs_sql(3, 12) + " SELECT a, b, len::BIGINT AS len, CASE WHEN len >= 4 THEN 'allusion' ELSE 'echo' END AS tier FROM best LEFT JOIN rare USING (a, b) WHERE len >= 4 OR least <= 150")
def quotes_lemma_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.lemma_links(*sides(spark, sf_dir))


LEMMAS_SQL = UNITS_SQL[: UNITS_SQL.index("freq AS")].replace("WITH d AS", "WITH d0 AS").replace("q AS (", "q0 AS (") + """
votes AS (SELECT w, CASE WHEN pos % 3 = 0 THEN w ELSE rtrim(w, 's') END AS l, count(*) AS n FROM q0 GROUP BY ALL),
dict AS (SELECT w, l FROM votes QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, l) = 1),
d AS (SELECT unit, pos, coalesce(l, w) AS w FROM d0 LEFT JOIN dict USING (w)), q AS (SELECT unit, pos, coalesce(l, w) AS w FROM q0 LEFT JOIN dict USING (w)),
freq AS (SELECT w, count(*) AS n FROM (SELECT w FROM d UNION ALL SELECT w FROM q) GROUP BY w)"""


@query(LEMMAS_SQL + runs_sql(3, 12) + " SELECT a, b, len::BIGINT AS len, CASE WHEN len >= 4 THEN 'allusion' ELSE 'echo' END AS tier FROM best LEFT JOIN rare USING (a, b) WHERE len >= 4 OR least <= 150")
def quotes_majority_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemma pass over words that a tagged corpus, here the right side, turns into lemmas."""
    left, right = sides(spark, sf_dir)
    lemma = F.when(F.col("pos") % 3 == 0, F.col("surface")).otherwise(F.rtrim("surface", F.lit("s")))
    tagged = right.select(F.posexplode("ws").alias("pos", "surface")).select("surface", lemma.alias("lemma"))
    return reuse.lemma_links(*[reuse.lemmatised(side, tagged) for side in (left, right)])


def _renamed(sql: str, names: str, mark: str) -> str:
    """SQL with the names of its table expressions marked, so that two sets of them can stand side by side."""
    return re.sub(rf"\b({'|'.join(names.split())})\b", lambda m: m[1] + mark, sql)


_RUN_TABLES = "dg qg live hits diags cells isles runs best rare"
MERGED_SQL = (
    UNITS_SQL + _renamed(runs_sql(4, 40), _RUN_TABLES, "4") + _renamed(runs_sql(3, 12), _RUN_TABLES, "3")
    + """, s AS (SELECT a, b, len::BIGINT AS len, CASE WHEN len >= 5 THEN 'quotation' ELSE 'allusion' END AS tier FROM best4 LEFT JOIN rare4 USING (a, b) WHERE len >= 5 OR least <= 300),
l AS (SELECT a, b, len::BIGINT AS len, CASE WHEN len >= 4 THEN 'allusion' ELSE 'echo' END AS tier FROM best3 LEFT JOIN rare3 USING (a, b) WHERE len >= 4 OR least <= 150)
SELECT a, b, len, tier FROM (SELECT *, 0 AS late FROM s UNION ALL SELECT *, 1 AS late FROM l)
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY CASE tier WHEN 'quotation' THEN 0 WHEN 'allusion' THEN 1 ELSE 2 END, len DESC, late) = 1"""
)


@query(MERGED_SQL)
def quotes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface links and lemma links in one table."""
    return reuse.all_links(*sides(spark, sf_dir))


def line_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every line, in order."""
    lines = verses(spark, sf_dir).select(F.col("verse_id").alias("unit"), F.col("doc_id").alias("chapter"), F.col("verse").alias("line"), "text")
    return sequences(lines)


PARALLEL_SQL = """u AS (SELECT verse_id AS unit, doc_id AS chapter, verse AS line, word_num AS pos, lemma AS w FROM words),
g AS (SELECT unit, chapter, line, pos, hash(w, lead(w) OVER l, lead(w, 2) OVER l) AS g FROM u WINDOW l AS (PARTITION BY unit ORDER BY pos) QUALIFY lead(w, 2) OVER l IS NOT NULL),
gdf AS (SELECT g, count(DISTINCT unit) AS gdf FROM g GROUP BY g), df AS (SELECT w, count(DISTINCT unit) AS df FROM u GROUP BY w),
live AS (SELECT g.* FROM g JOIN gdf USING (g) WHERE gdf <= 200),
hits AS (SELECT DISTINCT x.unit AS a, y.unit AS b, y.pos - x.pos AS diag, x.pos AS pa FROM live x JOIN live y ON x.g = y.g AND x.unit < y.unit AND NOT (x.chapter = y.chapter AND abs(x.line - y.line) <= 2)),
cells AS (SELECT a, b, diag, x.pos AS pa, x.pos - row_number() OVER (PARTITION BY a, b, diag ORDER BY x.pos) AS isle
  FROM (SELECT DISTINCT a, b, diag FROM hits) JOIN u x ON x.unit = a JOIN u y ON y.unit = b AND y.pos = x.pos + diag AND y.w = x.w),
isles AS (SELECT a, b, diag, min(pa) AS start, count(*) AS len FROM cells GROUP BY a, b, diag, isle HAVING count(*) >= 3),
ok AS (SELECT DISTINCT i.* FROM isles i JOIN hits USING (a, b, diag) WHERE pa BETWEEN start AND start + len - 3),
stretch AS (SELECT DISTINCT a, start, len FROM ok),
wd AS (SELECT unit, pos, df FROM u JOIN df USING (w)), gd AS (SELECT unit, pos, least(gdf, 201) AS gdf FROM g JOIN gdf USING (g)),
mw AS (SELECT a, start, len, min(df) AS least, max(df) AS most FROM stretch JOIN wd ON unit = a AND pos BETWEEN start AND start + len - 1 GROUP BY ALL),
mg AS (SELECT a, start, len, max(gdf) AS widest FROM stretch JOIN gd ON unit = a AND pos BETWEEN start AND start + len - 3 GROUP BY ALL),
m AS (SELECT * FROM ok JOIN mw USING (a, start, len) JOIN mg USING (a, start, len)),
best AS (SELECT * FROM m WHERE (len >= 4 AND (least <= 300 OR (least <= 600 AND widest <= 25))) OR (len = 3 AND (most <= 50 OR (least <= 50 AND widest <= 5)))
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len DESC, start, diag) = 1)"""


@query(PARALLEL_SQL + " SELECT a, b, start AS start_a, start + diag AS start_b, len::BIGINT AS len, CASE WHEN len >= 5 THEN 'parallel' WHEN len = 4 THEN 'allusion' ELSE 'echo' END AS tier FROM best", "words")
def parallels_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.parallels(line_sequences(spark, sf_dir))


@query(PARALLEL_SQL + " SELECT a, b, len::BIGINT AS len FROM best WHERE len >= 8 AND (a BETWEEN 0 AND 200000000 OR b BETWEEN 0 AND 200000000) ORDER BY len DESC, a, b LIMIT 15", "words")
def parallels_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read side: overlap of either side with the scope, long runs first."""
    p = reuse.parallels(line_sequences(spark, sf_dir)).where((F.col("len") >= 8) & (F.col("a").between(0, 200_000_000) | F.col("b").between(0, 200_000_000)))
    return p.orderBy(F.desc("len"), "a", "b").limit(15).select("a", "b", "len")


@query()
def parallels_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent merge of neighbouring pairs; tests compare it with a plain fold."""
    p = reuse.parallels(line_sequences(spark, sf_dir))
    books = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min(book_of("source")).alias("book"))
    for side in "ab":
        one = books.select(F.col("doc_id").alias(f"doc_{side}"), F.col("book").alias(f"book_{side}"))
        p = p.withColumn(f"doc_{side}", F.expr(f"{side} div {LINES}")).join(one, f"doc_{side}")
    return reuse.chains(p.select("book_a", "book_b", F.col("a").alias("oa"), F.col("b").alias("ob"), "len"))
