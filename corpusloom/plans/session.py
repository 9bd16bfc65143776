"""Queries of the study-session family; events are the log, users the sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, session
from corpusloom.plans.registry import query
from corpusloom.tables import table, verses, words


@query(
    """c AS (SELECT doc_id, min(verse_id) AS s, max(verse_id) AS e FROM verses GROUP BY doc_id),
w(lo, hi) AS (VALUES (2000003, 9999999), (40000000, 42000004))
SELECT (row_number() OVER (ORDER BY greatest(s, lo), least(e, hi)) - 1)::INT AS unit, greatest(s, lo) AS start, least(e, hi) AS "end" FROM c, w WHERE s <= hi AND e >= lo""",
    "verses",
)
def study_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = verses(spark, sf_dir).groupBy("doc_id").agg(F.min("verse_id").alias("start"), F.max("verse_id").alias("end"))
    return session.units(chapters, [(2_000_003, 9_999_999), (40_000_000, 42_000_004)])


@query(
    """WITH u AS (SELECT user_id, unnest(range(40))::INT AS unit FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT DISTINCT user_id, (event_id % 40)::INT AS unit FROM events WHERE event_type = 'view'),
m AS (SELECT u.user_id, u.unit, CASE WHEN r.unit IS NULL THEN 0 ELSE 1 END AS read FROM u LEFT JOIN r USING (user_id, unit)),
i AS (SELECT *, unit - row_number() OVER (PARTITION BY user_id, read ORDER BY unit) AS isle FROM m),
g AS (SELECT user_id, read, isle, count(*) AS size FROM i GROUP BY ALL),
f AS (SELECT user_id, sum(size)::BIGINT AS units, coalesce(sum(size) FILTER (read = 1), 0)::BIGINT AS units_read, count(*) FILTER (read = 0)::BIGINT AS gaps, coalesce(max(size) FILTER (read = 0), 0)::BIGINT AS longest_gap FROM g GROUP BY user_id)
SELECT *, floor(units_read * 100 / units + 0.5)::BIGINT AS percent FROM f"""
)
def study_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    units = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("unit"))
    reads = events.where("event_type = 'view'").select("user_id", (F.col("event_id") % 40).cast("int").alias("unit"))
    return session.coverage(units, reads, ["user_id"])


NOTES = [(1, 11_000_002), (1, 11_000_003), (2, 6_000_004), (3, 12_000_002), (3, 13_000_002), (4, 20_000_001)]


@query(
    """notes(note_id, ref) AS (VALUES (1, 11000002), (1, 11000003), (2, 6000004), (3, 12000002), (3, 13000002), (4, 20000001)),
n AS (SELECT * FROM notes WHERE note_id NOT IN (SELECT note_id FROM notes WHERE ref BETWEEN 6000001 AND 6000012)),
l AS (SELECT DISTINCT note_id, lemma FROM n JOIN words ON verse_id = ref),
f AS (SELECT lemma, count(*) AS freq FROM words GROUP BY lemma HAVING count(*) <= 300),
k AS (SELECT note_id, lemma FROM l JOIN f USING (lemma) QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY freq, lemma) <= 64),
h AS (SELECT DISTINCT verse_id, lemma FROM words WHERE verse_id BETWEEN 6000001 AND 6000012)
SELECT note_id, count(DISTINCT lemma)::BIGINT AS shared, array_to_string(list_sort(list(DISTINCT verse_id)), ',') AS locations FROM k JOIN h USING (lemma) GROUP BY note_id HAVING count(DISTINCT lemma) >= 2""",
    "words",
)
def study_recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.recurrences(spark.createDataFrame(NOTES, "note_id int, ref long"), words(spark, sf_dir), 6_000_001, 6_000_012)


@query(
    """WITH n AS (SELECT event_id AS note_id, event_type AS type, CASE WHEN value > 50 THEN 'open' ELSE 'supported' END AS status, [user_id, user_id + event_id % 7] AS refs FROM events)
SELECT type, status, count(*)::BIGINT AS n, min(note_id) AS first FROM n WHERE list_min(refs) <= 300 GROUP BY type, status"""
)
def study_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 50, "open").otherwise("supported")
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("note_id"), F.col("event_type").alias("type"), status.alias("status"), F.array("user_id", F.col("user_id") + F.col("event_id") % 7).alias("refs"))
    return session.review(notes, 300)


@query("SELECT event_type, count(*) FILTER (value > 50)::BIGINT AS \"open\", count(*) FILTER (value <= 50)::BIGINT AS supported FROM events GROUP BY event_type")
def study_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("status", F.when(F.col("value") > 50, "open").otherwise("supported"))
    return e.groupBy("event_type").pivot("status", ["open", "supported"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT verse_id, right(lag(text) OVER (PARTITION BY doc_id ORDER BY verse), 200) AS tail FROM verses WHERE book_num = 1", "verses")
def study_previous_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    v = verses(spark, sf_dir).where("book_num = 1")
    return v.select("verse_id", F.right(F.lag("text").over(Window.partitionBy("doc_id").orderBy("verse")), F.lit(200)).alias("tail"))


@query("SELECT user_id, max(ts) AS updated, count(*)::BIGINT AS events FROM events GROUP BY user_id ORDER BY updated DESC, user_id LIMIT 20")
def study_list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated"), F.count("*").alias("events")).orderBy(F.desc("updated"), "user_id").limit(20)


@query(
    """WITH RECURSIVE c AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IN ('src1', 'src2')),
p AS (SELECT source, doc_id, n, k, 1::BIGINT AS chunk, n AS held FROM c WHERE k = 1
  UNION ALL SELECT c.source, c.doc_id, c.n, c.k, CASE WHEN p.held + c.n > 9000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.held + c.n > 9000 THEN c.n ELSE p.held + c.n END
  FROM p JOIN c ON c.source = p.source AND c.k = p.k + 1),
g AS (SELECT source, chunk, min(doc_id) AS s, max(doc_id) AS e FROM p GROUP BY source, chunk)
SELECT (row_number() OVER (ORDER BY source, chunk) - 1)::INT AS unit, s AS start, e AS "end" FROM g"""
)
def study_chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "documents").where("source in ('src1', 'src2')").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return session.chunk_units(retrieval.chunks(chapters, "source", "doc_id", "n", 9_000), "source")


@query("SELECT event_id AS seq, '{\"kind\":\"' || event_type || '\",\"unit\":' || event_id % 40 || '}' AS event FROM events WHERE user_id = 7")
def study_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), (F.col("event_id") % 40).alias("unit"))
    return session.exported(log, "7").select("seq", F.regexp_replace("event", '"seq":[0-9]+,', "").alias("event"))


@query("SELECT user_id, count(*)::BIGINT AS events FROM events WHERE user_id <> 7 GROUP BY user_id")
def study_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("session", F.col("user_id").cast("string"))
    return session.deleted(log, "7").groupBy("user_id").agg(F.count("*").alias("events"))


@query(
    """WITH log AS (SELECT user_id % 5 AS session, event_id AS seq, event_id % 60 AS note_id, event_type AS kind, CASE WHEN value > 50 THEN 'supported' ELSE 'refuted' END AS status FROM events),
n AS (SELECT session, note_id, seq FROM log WHERE kind = 'error'), r AS (SELECT session, note_id, arg_max(status, seq) AS newest FROM log WHERE kind = 'signup' GROUP BY ALL)
SELECT session::VARCHAR AS session, note_id::INT AS note_id, seq::VARCHAR AS text, coalesce(newest, 'open') AS status FROM n LEFT JOIN r USING (session, note_id)"""
)
def study_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with the status of the last event that resolves them."""
    e = table(spark, sf_dir, "events")
    note = F.col("event_type") == "error"
    status = F.when(note, "open").when(F.col("value") > 50, "supported").otherwise("refuted")
    log = e.where(F.col("event_type").isin("error", "signup")).select(
        (F.col("user_id") % 5).cast("string").alias("session"), F.col("event_id").alias("seq"), F.when(note, "note").otherwise("resolve").alias("kind"), (F.col("event_id") % 60).cast("int").alias("note_id"),
        F.lit("question").alias("type"), F.col("event_id").cast("string").alias("text"), F.array("event_id").alias("refs"), F.lit(None).cast("int").alias("against"), status.alias("status"),
    )
    return session.notes(log).select("session", "note_id", "text", "status")
