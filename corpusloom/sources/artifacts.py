"""Artifacts: folders of Parquet tables with a version, opened read-only, attached as views, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def open_artifact(spark: SparkSession, path: str, tables: list[str], prefix: str = "") -> dict[str, DataFrame]:
    """The tables of an artifact, also as views under a prefix; a missing or newer one is an error."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}  # a handful of rows
    if int(meta.get("schema_version", 0)) > SCHEMA_VERSION:
        raise ValueError(f"{path} has schema {meta['schema_version']}, newer than {SCHEMA_VERSION}")
    out = {t: spark.read.parquet(f"{path}/{t}") for t in tables}
    for name, df in out.items():
        df.createOrReplaceTempView(prefix + name)
    return out


def attach_optional(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A user's own table; if it is missing, an empty one of that schema. Files that can't be read count as empty."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{path}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def union_texts(shipped: DataFrame, own: DataFrame) -> DataFrame:
    return shipped.unionByName(own, allowMissingColumns=True)


def write_artifact(spark: SparkSession, path: str, tables: dict[str, DataFrame], sort: dict[str, list[str]] | None = None, meta: dict[str, str] | None = None) -> None:
    """Write all tables beside the artifact, then put them in its place by renames: readers see the old
    tables or the new ones, for a moment none, and never half of them."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        keys = (sort or {}).get(name)
        (df.sortWithinPartitions(*keys) if keys else df).write.parquet(f"{fresh}/{name}")
    rows = [("schema_version", str(SCHEMA_VERSION)), *(meta or {}).items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{fresh}/meta")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path}.old-{uuid.uuid4().hex}"

    def move(a: str, b: str) -> None:
        if not fs.rename(hadoop(a), hadoop(b)):
            raise OSError(f"can't rename {a} to {b}")

    if had := fs.exists(hadoop(path)):
        move(path, old)
    try:
        move(fresh, path)
    except Exception:
        if had:
            move(old, path)  # the old artifact stays
        raise
    fs.delete(hadoop(old), True)


def rebuild_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """Replace some tables of an artifact, each by a rename once it is written; the others stay as they are.

    The new tables may be made from the old ones.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/_new-{mark}/{name}")
    for name in tables:
        old, new, at = hadoop(f"{path}/_old-{mark}/{name}"), hadoop(f"{path}/_new-{mark}/{name}"), hadoop(f"{path}/{name}")
        fs.mkdirs(old.getParent())
        if fs.exists(at) and not fs.rename(at, old) or not fs.rename(new, at):
            raise OSError(f"can't replace {name}")
        spark.catalog.refreshByPath(f"{path}/{name}")
    for part in ("new", "old"):
        fs.delete(hadoop(f"{path}/_{part}-{mark}"), True)


def replace_by_id(existing: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of one imported id replaced by new ones."""
    return existing.where(F.col(key) != value).unionByName(new.withColumn(key, F.lit(value)), allowMissingColumns=True)


def valid_id(name: str, shipped: set[str]) -> str:
    """An id of two to eight letters and digits in upper case that no shipped text has, or ValueError."""
    up = name.strip().upper()
    if not (2 <= len(up) <= 8 and up.isascii() and up.isalnum()):
        raise ValueError("an id has two to eight letters or digits")
    if up in shipped:
        raise ValueError(f"{up} is shipped")
    return up
