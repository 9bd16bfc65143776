"""Clause search, bitmask streams and their variants, text reconstruction, key mapping, ingest rules and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clauses_with(roles: DataFrame, clause: str, tests: dict[str, Column]) -> DataFrame:
    """Clauses for which every test holds on some role row: one scan and one aggregation in place of a chain of semi-joins."""
    flags = [F.max(F.when(t, 1).otherwise(0)).alias(name) for name, t in tests.items()]
    hit = roles.groupBy(clause).agg(*flags)
    return hit.where(reduce(lambda a, b: a & b, [F.col(n) == 1 for n in tests])).select(clause)


def display_roles(roles: DataFrame, clause: str, role: str) -> DataFrame:
    """Role rows for display: embedded ones only where the role has no words of its own."""
    own = F.max(F.when(F.col("embedded") == 0, 1).otherwise(0)).over(Window.partitionBy(clause, role))
    return roles.withColumn("own", own).where("embedded = 0 or own = 0").drop("own")


def in_edition(mask: str, bit: int) -> Column:
    return F.col(mask).bitwiseAND(bit) != 0


def effective_mask(mask: str, default: str, every: int) -> Column:
    """A default row without editions counts as in all of them."""
    return F.when((F.col(mask) == 0) & F.col(default), F.lit(every)).otherwise(F.col(mask))


def edition_names(mask: str, names: list[str | None]) -> Column:
    """Names of the set bits, joined by commas; bits without a name aren't shown."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(1 << i) != 0, n) for i, n in enumerate(names) if n])), ",")


def reconstruct(words: DataFrame, unit: str, first_part_langs: tuple[str, ...] = ("G",)) -> DataFrame:
    """Text of each unit: in a slot the parts in order, or the first part only for some languages; slots joined by blanks."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_num", "surface"))), lambda x: x["surface"]), "")
    slots = words.groupBy(unit, "word_num").agg(F.when(F.min("lang").isin(*first_part_langs), F.min_by("surface", "part_num")).otherwise(whole).alias("s"))
    return slots.groupBy(unit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "s"))), lambda x: x["s"]), " ").alias("text"))


def edition_texts(words: DataFrame, unit: str, bits: int) -> DataFrame:
    """(unit, text, editions): editions with the same text grouped, those that omit the unit under an empty text. If an
    edition has several surfaces in a slot, the one shared least counts."""
    names = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit("editions", i) == 1)
    each = words.withColumn("edition", F.explode_outer(names))
    slot = Window.partitionBy(unit, "word_num", "edition")
    ranked = each.withColumn("k", F.row_number().over(slot.orderBy(F.bit_count("editions"), "surface"))).where("k = 1")
    text = ranked.groupBy(unit, "edition").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "surface"))), lambda x: x["surface"]), " ").alias("text"))
    known = text.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.when(F.col("edition").isNotNull(), F.struct("edition", "text")))).alias("known"))
    every = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.coalesce(F.try_element_at("known", i), F.lit("")))).alias("edition", "text")
    return known.select(unit, every).groupBy(unit, "text").agg(F.array_join(F.array_sort(F.collect_list("edition")), ",").alias("editions"))


def disputed(words: DataFrame, unit: str, every: int) -> DataFrame:
    """Rows that some but not all editions have."""
    return words.where((F.col("editions") != 0) & (F.bit_count("editions") < F.bit_count(F.lit(every))))


def mapped_key(rows: DataFrame, mapping: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """The mapped id, else the key itself if it is on the spine, else null. mapping has (key, id), spine has id; both keys are unique."""
    m = mapping.select(F.col("key").alias("from_"), F.col("id").alias("mapped"))
    s = spine.select(F.col("id").alias("direct"))
    return rows.join(m, F.col(key) == F.col("from_"), "left").join(s, F.col(key) == F.col("direct"), "left").withColumn("resolved", F.coalesce("mapped", "direct")).drop("from_", "mapped", "direct")


def first_wins(rows: DataFrame, key: str | list[str], order: str | list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first by order, or the last."""
    by = [order] if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) if last else F.asc(c) for c in by]))
    return rows.withColumn("nth_", rank).where("nth_ = 1").drop("nth_")


def import_rows(rows: DataFrame, spine: DataFrame, key: str, order: str) -> DataFrame:
    """Rows on the spine, the first of each key."""
    return first_wins(rows.join(spine, key, "left_semi"), key, order)


def gaps(entries: DataFrame, uses: DataFrame, exact: str, loose: str) -> DataFrame:
    """Used keys that no entry resolves, neither exactly nor by its loose form."""
    return uses.join(entries.select(exact).distinct(), exact, "left_anti").join(entries.select(loose).distinct(), loose, "left_anti")


def check(df: DataFrame, what: str) -> None:
    """A verification gate: raises with an example unless df is empty."""
    if rows := df.take(1):
        raise AssertionError(f"{what}: {rows[0]}")
