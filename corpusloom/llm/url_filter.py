"""URL filters: a sorted array of 64-bit xxhash keys, memory-mapped by every worker and probed by binary search.

Blocked entries are hosts ("bad.example", which covers all its subdomains) or host and path ("ok.example/spam", which
covers that page and all below it). The filter is three files in the shared folder: the sorted keys, the offsets of the
full strings, and the strings, which settle collisions of the keys.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.kernels import lean
from corpusloom.llm.shared import pick, shared_dir

BLOCKED = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
_HOST = r"^[A-Za-z][0-9A-Za-z+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][0-9A-Za-z+.-]*://[^/?#]*([^?#]*)"


def cleaned(entries: DataFrame) -> DataFrame:
    return entries.select(F.rtrim(F.trim(F.col(entries.columns[0])), F.lit("/")).alias("text")).where("text != ''")


def reach(entries: DataFrame) -> tuple[int, int]:
    """Most labels of a host and most steps of a path of any entry: longer parts of a url can't be in the filter."""
    parts = F.split("text", "/")
    labels, steps = cleaned(entries).agg(F.max(F.size(F.split(parts[0], "[.]"))), F.max(F.size(parts)) - 1).first()
    return labels or 0, steps or 0


def build(entries: DataFrame, folder: str) -> str:
    """Write the filter of the table's first column, entry, to a new folder below `folder` and give its place.

    Entries lose blanks around them and closing slashes; null and empty ones are left out, repeated ones count once.
    Spark hashes and sorts them, and the driver writes them as they come, a partition at a time.
    """
    # the sign bit is flipped, as the keys are searched as unsigned numbers
    rows = cleaned(entries).distinct().withColumn("key", F.xxhash64("text"))
    rows = rows.orderBy(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), "text")
    place = f"{folder}/corpusloom/urls-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(place)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/keys") as keys, fs.open_output_stream(f"{path}/offsets") as offsets, fs.open_output_stream(f"{path}/strings") as strings:
        end = 0
        offsets.write(np.int64(end).tobytes())
        for row in rows.toLocalIterator():
            raw = row.text.encode()
            end += len(raw)
            keys.write(np.int64(row.key).tobytes())
            offsets.write(np.int64(end).tobytes())
            strings.write(raw)
    return place


def ship(spark: SparkSession, place: str) -> str:
    """Where workers find the filter: the place itself on a file system that can be mapped, else the name under which
    Spark hands every executor one copy of the folder."""
    if urlparse(place).scheme in ("", "file"):
        return place
    spark.sparkContext.addFile(place, recursive=True)
    return place.rpartition("/")[2]


class Filter:
    """The three files, mapped."""

    def __init__(self, place: str) -> None:
        path = urlparse(place).path if "/" in place else SparkFiles.get(place)

        def open_(name: str, kind: type) -> np.ndarray:
            file = f"{path}/{name}"
            return np.memmap(file, kind, "r") if os.path.getsize(file) else np.zeros(0, kind)

        self.keys, self.offsets, self.strings = open_("keys", np.uint64), open_("offsets", np.int64), open_("strings", np.uint8)

    def hits(self, digests: np.ndarray, texts) -> np.ndarray:
        """Places of the digests whose texts are in the filter; texts[i] gives the string of place i."""
        at = np.searchsorted(self.keys, digests)
        same = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests) if len(self.keys) else np.zeros(0, np.int64)
        return np.array([i for i in same.tolist() if self._holds(int(at[i]), digests[i], texts(i))], np.int64)

    def _holds(self, at: int, digest: np.uint64, text: str) -> bool:
        raw = text.encode()
        while at < len(self.keys) and self.keys[at] == digest:
            if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == raw:
                return True
            at += 1
        return False


@lru_cache(1)
def opened(place: str) -> Filter:
    """The filter, mapped once in the life of a worker."""
    return Filter(place)


def filter_urls(pages: DataFrame, blocked: Iterable[str] | DataFrame = BLOCKED) -> DataFrame:
    """(page_id, url, host, matched, blocked) for each row of pages; matched is the longest entry that covers the url.

    blocked is a table whose first column has the entries, or a few entries.
    Host and path are compared without scheme, user, port, query, fragment and closing slashes, the host in lower case. A
    null url, an empty one, and one without scheme and host are not blocked; their host is null. Rows with a null page_id
    and repeated rows are judged row by row. Only page_id and url are read. Of two entries of one length that cover a url
    the host comes first; an empty list blocks nothing. A url of any length is read to its end.
    """
    spark = pages.sparkSession
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(x,) for x in blocked], "entry string")
    place = ship(spark, build(blocked, shared_dir(spark)))
    host = F.nullif(F.rtrim(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(".")), F.lit(""))
    path = F.rtrim(F.regexp_extract("url", _PATH, 1), F.lit("/"))
    rows = pick(pages, page_id="page_id", url="url").select("page_id", "url", host.alias("host"), path.alias("path"))
    labels = F.split("host", "[.]")
    most_labels, most_steps = reach(blocked)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split("path", "/")
    below = F.transform(F.filter(F.sequence(F.lit(2), F.lit(most_steps + 2)), lambda i: (i <= F.size(steps)) & (i <= most_steps + 1)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    paths = F.when(F.col("path") != "", F.flatten(F.transform("hosts", lambda h: F.transform(below, lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))
    keyed = rows.withColumn("hosts", F.when(F.col("host").isNotNull(), hosts)).withColumn("texts", F.when(F.col("host").isNotNull(), F.concat("hosts", paths)))
    keyed = keyed.select("page_id", "url", "host", "texts", F.transform("texts", lambda t: F.xxhash64(t)).alias("digests"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(place)
        for b in batches:
            texts, digests = b.column(3), b.column(4)
            flat, values = digests.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), texts.flatten()
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(texts).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(b)), size)
            matched: list[str | None] = [None] * len(b)
            for i in own.hits(flat, lambda i: values[i].as_py()).tolist():
                text = values[i].as_py()
                if matched[row[i]] is None or len(text) > len(matched[row[i]]):
                    matched[row[i]] = text
            found = pa.array(matched, pa.string())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), found, found.is_valid()], ["page_id", "url", "host", "matched", "blocked"])

    return keyed.mapInArrow(lean(probe), "page_id long, url string, host string, matched string, blocked boolean")


def oracle(blocked: Iterable[str] = BLOCKED) -> str:
    """The same rows in DuckDB SQL."""
    values = ", ".join(f"('{e}')" for e in blocked)
    return f"""
WITH entries(entry) AS (VALUES {values}),
p AS (SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') AS host,
             rtrim(regexp_extract(url, '{_PATH}', 1), '/') AS path FROM pages)
SELECT page_id, url, host, matched, matched IS NOT NULL AS blocked FROM (
  SELECT *, (SELECT arg_max(entry, length(entry)) FROM entries
             WHERE CASE WHEN contains(entry, '/')
                   THEN (split_part(entry, '/', 1) = host OR ends_with(host, '.' || split_part(entry, '/', 1)))
                    AND starts_with(path || '/', substr(entry, strpos(entry, '/')) || '/')
                   ELSE host = entry OR ends_with(host, '.' || entry) END) AS matched FROM p)"""
