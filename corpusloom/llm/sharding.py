"""Sharding: splitters from a size-weighted sample of keys, range partition, exact subdivision of overfull ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import cut, discard, seal

#: Bytes of text a shard should hold, by how much one may exceed that before it is divided, sampled keys for a shard.
TARGET_BYTES, SLACK, PER_SHARD, SEED = 64 << 20, 1.25, 64, 29
_NULL = -(1 << 63)


def _after(bounds: tuple[np.ndarray, np.ndarray], key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of bounds below each (key, tie); bounds are sorted and distinct."""
    lo, hi = np.searchsorted(bounds[0], key, "left"), np.searchsorted(bounds[0], key, "right")
    out = lo.copy()
    same = np.flatnonzero(lo < hi)
    for i in np.unique(lo[same]):
        rows = same[lo[same] == i]
        out[rows] = i + np.searchsorted(bounds[1][i : hi[rows[0]]], tie[rows], "left")
    return out


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", "tie").distinct().toArrow().sort_by([("key", "ascending"), ("tie", "ascending")])
    return t.column("key").to_numpy(), t.column("tie").to_numpy()


def _every(rows: DataFrame, n: str, step: int) -> tuple[DataFrame, DataFrame]:
    """(key, tie) of the distinct rows (key, tie, n) at which the running sum of n in key order passes a multiple of step.

    Rows are range-partitioned and written once, in the table given beside; sums run inside each range, and start at what
    the ranges before it hold.
    """
    spark = rows.sparkSession
    ranged = cut(rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").withColumn("part", F.spark_partition_id()), "sample")
    held = ranged.groupBy("part").agg(F.sum(n).alias("held")).toArrow().sort_by("part")  # a row for each partition
    starts = np.cumsum([0, *held.column("held").to_pylist()]).tolist()
    before = spark.createDataFrame(list(zip(held.column("part").to_pylist(), starts)), "part int, before long")
    run = F.col("before") + F.sum(n).over(Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.join(F.broadcast(before), "part").withColumn("run", run)
    return found.where(F.floor(F.col("run") / step) > F.floor((F.col("run") - F.col(n)) / step)), ranged


def splitters(keys: DataFrame, target: int, slack: float = SLACK, per_shard: int = PER_SHARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds (key, tie) of all shards but the last, for rows (key, tie, size).

    Every record is drawn size * per_shard / target times on average, so ranks in the sorted sample measure bytes; each
    per_shard-th draw gives a bound. Ranges that turn out larger than slack * target are cut at exact running sums.
    What reaches the driver is one bound for each shard.
    """
    rate = per_shard / target
    times = F.col("size") * rate
    chance = F.pmod(F.xxhash64(F.lit(seed), "key", "tie"), F.lit(1 << 30)) / float(1 << 30)
    sample = keys.withColumn("draws", F.floor(times) + (chance < times - F.floor(times)).cast("long")).where("draws > 0")
    cuts, drawn = _every(sample.groupBy("key", "tie").agg(F.sum("draws").alias("draws")), "draws", per_shard)
    bounds = _collect(cuts)
    discard(drawn)
    shared = keys.sparkSession.sparkContext.broadcast(bounds)
    ranged = keys.withColumn("range", shard_of(shared)("key", "tie"))
    full = ranged.groupBy("range").agg(F.sum("size").alias("held")).where(F.col("held") > slack * target)
    inside = ranged.join(full, "range").groupBy("range", "held", "key", "tie").agg(F.sum("size").alias("size"))
    part = F.col("held") / F.ceil(F.col("held") / target)
    run = F.sum("size").over(Window.partitionBy("range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("run", run).where((F.col("run") < F.col("held")) & (F.floor(F.col("run") / part) > F.floor((F.col("run") - F.col("size")) / part)))
    more = _collect(inside)
    shared.destroy()
    both = np.unique(np.stack([np.concatenate((bounds[0], more[0])), np.concatenate((bounds[1], more[1]))], 1), axis=0) if len(more[0]) else np.stack(bounds, 1)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def shard_of(shared: Broadcast):
    """The function of (key, tie) that gives the range; the bounds, two numbers a shard, are broadcast."""

    @F.arrow_udf("int")
    def find(key: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(_after(shared.value, key.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)).astype(np.int32))

    return find


def shard(docs: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """docs with the column shard, stored by shard and sorted by doc_id inside: shards are ranges of doc_id, a partition each.

    A record counts as its text's bytes and one more, so null and empty texts count one. Rows of one doc_id are told
    apart by a hash of their text, so a doc_id with many texts can be divided too; equal rows always share a shard, which
    alone may make it exceed the slack, as may one very long text. A null doc_id sorts first. No rows in, no rows out;
    further columns stay as they are, and if one is called shard, the new one is called shard_.
    """
    inner, restore = seal(docs, "doc_id", "text")
    keyed = inner.withColumn("key", F.coalesce("doc_id", F.lit(_NULL))).withColumn("tie", F.xxhash64("text"))
    keys = cut(keyed.select("key", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")), "keys")
    bounds = splitters(keys, target)
    discard(keys)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    placed = keyed.withColumn("shard", shard_of(shared)("key", "tie"))
    placed = placed.repartitionById(len(bounds[0]) + 1, F.col("shard")).sortWithinPartitions("key", "tie")
    return restore(placed.select(*inner.columns, "shard"), "shard")
