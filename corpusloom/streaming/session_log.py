"""The session log as a stream: units read and coverage, folded as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.session import LOG_SCHEMA


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The append-only folder of log files as a stream."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(folder)


def coverage_stream(log: DataFrame, units: int) -> DataFrame:
    """Percent of units read per session, exactly: the state is the first read of each session and unit, however late the
    others come, so it is bounded by what there is to read."""
    reads = log.where("kind = 'read'").dropDuplicates(["session", "unit"])
    out = reads.groupBy("session").agg(F.count("*").alias("units_read"), F.max("ts").alias("updated"))
    return out.withColumn("percent", F.floor(F.col("units_read") * 100 / units + 0.5).cast("long"))
