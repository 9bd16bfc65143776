"""Tables written once to the folder that all executors share: the way to cut lineage and to use a result twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (spark.checkpoint.dir); on a local master without one, a new temporary one,
    which goes when Python ends."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    if "://" not in path:  # of the session's default file system; readers outside Spark must know which
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        path = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()
        path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") else path
    return path


#: Folders that the innermost open scratch() will delete.
_SCRATCH: list[list[str]] = []


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: its lineage ends there and survives lost executors.

    An open scratch deletes it at its end, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*cuts: DataFrame) -> None:
    """Delete tables that cut wrote, once everything that reads them has been written or collected itself."""
    for df in cuts:
        _delete(df.sparkSession, df.cut_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is cut inside; the last result must be cut outside, or written, by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)
