"""Sinks: JSON lines, aligned text for the screen, tables written once, and appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def aligned(df: DataFrame, limit: int = 200) -> str:
    """The first rows as text columns padded to their widest value, and a last line if there are more."""
    rows = df.limit(limit + 1).collect()
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows[:limit]]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join(lines + ["…"] * (len(rows) > limit))


def append_log(events: DataFrame, folder: str) -> None:
    """Add events to an append-only log; each call is a file of its own, so no lock is needed."""
    events.coalesce(1).write.mode("append").parquet(folder)


def clustered_tokens(words: DataFrame, table: str, buckets: int) -> None:
    """The token table bucketed and sorted by lemma, so that look-ups and joins by lemma need no shuffle."""
    words.write.mode("overwrite").bucketBy(buckets, "lemma").sortBy("lemma", "verse_id").saveAsTable(table)
