"""Helpers that the operators share: the shared folder, column picking, table reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.staging import cut, discard, scratch, shared_dir

__all__ = ["cut", "discard", "pick", "scratch", "seal", "shared_dir", "table"]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under new names, so that no other column of df can clash with those an operator adds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def seal(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with every other column under a name no operator uses, and the function that gives the old names back.

    That function takes the frame and the names of columns added at its end; an added name that df has already gets
    underscores until it is new.
    """
    inner = df.toDF(*[c if c in needed else f"extra_{i}__" for i, c in enumerate(df.columns)])

    def restore(out: DataFrame, *added: str) -> DataFrame:
        names = list(df.columns)
        for name in added:
            while name.lower() in {c.lower() for c in names}:
                name += "_"
            names.append(name)
        return out.toDF(*names)

    return inner, restore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
