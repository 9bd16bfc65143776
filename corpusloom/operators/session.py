"""Study sessions as an append-only log of events, folded by aggregation: units, cursor, coverage, recurrences, review."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTE_TYPES = ("observation", "question", "pattern", "counterexample", "conclusion")
STATUSES = ("open", "supported", "refuted")
#: The event log: kind is read, next, prev, goto, note or resolve; seq orders the events of a session.
LOG_SCHEMA = "session string, seq long, ts timestamp, kind string, unit int, note_id int, type string, text string, refs array<bigint>, against int, status string"


def units(chapters: DataFrame, scope: list[tuple[int, int]]) -> DataFrame:
    """(unit, start, end): one unit for each chapter that a scope interval meets, clamped to it, in key order from 0.

    chapters has (start, end) and is a small dimension, one row a chapter.
    """
    spark = chapters.sparkSession
    wanted = spark.createDataFrame(scope, "lo long, hi long")
    hit = chapters.join(F.broadcast(wanted), (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))  # the scope's intervals
    clamped = hit.select(F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    return clamped.withColumn("unit", F.row_number().over(Window.orderBy("start", "end")) - 1).select("unit", "start", "end")


def chunk_units(chunks: DataFrame, book: str) -> DataFrame:
    """(unit, start, end): one unit for each greedy chunk of chapters, in order of books and chunks from 0."""
    order = Window.orderBy(book, "chunk")  # a row for each chunk of one session's scope
    return chunks.withColumn("unit", F.row_number().over(order) - 1).select("unit", F.col("first").alias("start"), F.col("last").alias("end"))


def exported(log: DataFrame, session: str) -> DataFrame:
    """The events of one session in order, each as JSON."""
    own = log.where(F.col("session") == session)
    return own.select("seq", F.to_json(F.struct(*[c for c in log.columns if c != "session"])).alias("event")).orderBy("seq")


def deleted(log: DataFrame, session: str) -> DataFrame:
    """The log without one session, to be written in its place."""
    return log.where(~F.col("session").eqNullSafe(session))


def cursor(log: DataFrame, n_units: Column | int) -> DataFrame:
    """(session, cursor): next shows units[cursor] and steps on, prev goes to the one before, goto n to the one after n."""
    moves = log.where(F.col("kind").isin("next", "prev", "goto"))
    listed = moves.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "unit"))).alias("m"))
    most = n_units if isinstance(n_units, Column) else F.lit(n_units)

    def step(at: Column, x: Column) -> Column:
        return F.when(x["kind"] == "next", F.least(at + 1, most)).when(x["kind"] == "prev", F.greatest(at - 1, F.lit(1))).otherwise(x["unit"] + 1)

    return listed.select("session", F.aggregate("m", F.lit(0), step).alias("cursor"))


def add_note(spark: SparkSession, session: str, seq: int, note_id: int, type_: str, text: str, refs: list[int], against: int | None = None, patterns: set[int] = frozenset()) -> DataFrame:
    """One validated note event to append: typed, anchored, and a counterexample names the pattern it is against."""
    if type_ not in NOTE_TYPES:
        raise ValueError(f"type must be one of {', '.join(NOTE_TYPES)}")
    if not refs:
        raise ValueError("a note needs at least one reference")
    if (type_ == "counterexample") != (against is not None) or (against is not None and against not in patterns):
        raise ValueError("a counterexample, and nothing else, names the pattern it is against")
    status = "open" if type_ in ("pattern", "question") else None
    row = (session, seq, datetime.datetime.now(datetime.UTC).replace(tzinfo=None), "note", None, note_id, type_, text, refs, against, status)
    return spark.createDataFrame([row], LOG_SCHEMA)


def notes(log: DataFrame) -> DataFrame:
    """Notes with their latest status."""
    last = log.where("kind = 'resolve'").groupBy("session", "note_id").agg(F.max_by("status", "seq").alias("newest"))
    made = log.where("kind = 'note'").select("session", "note_id", "type", "text", "refs", "against", F.col("status").alias("first"))
    return made.join(last, ["session", "note_id"], "left").withColumn("status", F.coalesce("newest", "first")).drop("newest", "first")


def coverage(units: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: units, distinct units read, percent, unread runs and the longest of them; all by gaps and islands."""
    done = reads.select(*keys, "unit").distinct().withColumn("read", F.lit(1))
    marked = units.join(done, [*keys, "unit"], "left").withColumn("read", F.coalesce("read", F.lit(0)))
    isle = F.col("unit") - F.row_number().over(Window.partitionBy(*keys, "read").orderBy("unit"))
    runs = marked.withColumn("isle", isle).groupBy(*keys, "read", "isle").agg(F.count("*").alias("size"))
    read, unread = F.col("read") == 1, F.col("read") == 0
    out = runs.groupBy(*keys).agg(F.sum("size").alias("units"), F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0)).alias("units_read"), F.count(F.when(unread, 1)).alias("gaps"), F.coalesce(F.max(F.when(unread, F.col("size"))), F.lit(0)).alias("longest_gap"))
    return out.withColumn("percent", F.floor(F.col("units_read") * 100 / F.col("units") + 0.5).cast("long"))


def gap_runs(units: DataFrame, reads: DataFrame) -> DataFrame:
    """(first, last, size) of each run of unread units."""
    left = units.join(reads.select("unit").distinct(), "unit", "left_anti")
    isle = F.col("unit") - F.row_number().over(Window.orderBy("unit"))  # units of one session, a small table
    return left.withColumn("isle", isle).groupBy("isle").agg(F.min("unit").alias("first"), F.max("unit").alias("last"), F.count("*").alias("size")).drop("isle")


def recurrences(notes: DataFrame, words: DataFrame, start: int, end: int, most: int = 300, terms: int = 64, least: int = 2) -> DataFrame:
    """Open patterns and questions not anchored in [start, end] that share at least `least` distinctive lemmas with it.

    notes has (note_id, ref) rows, one for each anchor; a lemma is distinctive up to `most` occurrences, and a note
    contributes its `terms` rarest. Returns note_id, shared and the locations in the interval.
    """
    outside = notes.groupBy("note_id").agg(F.max(F.col("ref").between(start, end).cast("int")).alias("inside")).where("inside = 0").select("note_id")
    mine = notes.join(outside, "note_id", "left_semi").join(words.select(F.col("verse_id").alias("ref"), "lemma"), "ref").select("note_id", "lemma").distinct()
    freq = words.join(mine.select("lemma").distinct(), "lemma", "left_semi").groupBy("lemma").agg(F.count("*").alias("freq")).where(F.col("freq") <= most)
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy("freq", "lemma"))
    few = mine.join(freq, "lemma").withColumn("k", rank).where(F.col("k") <= terms).select("note_id", "lemma")
    here = words.where(F.col("verse_id").between(start, end)).select("verse_id", "lemma").distinct()
    out = few.join(here, "lemma").groupBy("note_id").agg(F.countDistinct("lemma").alias("shared"), F.array_join(F.array_sort(F.collect_set("verse_id")), ",").alias("locations"))
    return out.where(F.col("shared") >= least)


def review(notes: DataFrame, end: int) -> DataFrame:
    """Notes whose least anchor is not after `end`, tallied by type and status."""
    upto = notes.where(F.array_min("refs") <= end)
    return upto.groupBy("type", "status").agg(F.count("*").alias("n"), F.min("note_id").alias("first"))
