"""Sessions for local work, views of all tables, and the read-only SQL door."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_BLANKS = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session on this machine; on a cluster the session comes from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    return builder.config(map=conf).getOrCreate()


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """A temporary view for each table of the folder; missing ones are left out."""
    found = [t for t in TABLES if Path(sf_dir, f"{t}.parquet").exists()]
    for t in found:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return found


def read_only_sql(spark: SparkSession, sf_dir: str, text: str, limit: int = 200) -> DataFrame:
    """The first rows of one query over the tables; anything that isn't a query is refused before it is planned."""
    body = _BLANKS.sub(" ", text).strip().rstrip(";").strip()
    head = re.match(r"\(*\s*(\w+)", body)
    if not head or head[1].upper() not in ("SELECT", "WITH", "VALUES", "TABLE", "FROM") or re.search(r"\bINSERT\s+(INTO|OVERWRITE)\b", body, re.I):
        raise ValueError("only queries are allowed")
    register(spark, sf_dir)
    return spark.sql(f"SELECT * FROM ({body})").limit(limit)


def truncated(df: DataFrame, limit: int) -> tuple[list, bool]:
    """At most `limit` rows, and whether there were more: one row beyond the limit tells."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, column, type) of every table of the folder."""
    rows = [(t, c, k) for t in register(spark, sf_dir) for c, k in spark.table(t).dtypes]
    return spark.createDataFrame(rows, "table string, column string, type string")
