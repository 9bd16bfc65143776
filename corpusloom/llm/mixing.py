"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import seal

#: Passes over a source at most, characters drawn as a share of all characters, and the seed of the draws.
MAX_EPOCHS, BUDGET, SEED = 4.0, 1.0, 17
#: Most sources whose rates are broadcast.
MOST_BROADCAST = 100_000


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, max_epochs: float) -> np.ndarray:
    """Epochs of each source: shares of `total` by weight, clamped at max_epochs, the excess going to the others by weight.

    Empty sources and sources without weight get 0. If the caps can't take `total`, all weighted sources are at their caps.
    """
    epochs = np.zeros(len(sizes))
    free = (sizes > 0) & (weights > 0)
    left = float(total)
    while free.any():
        want = left * weights / weights[free].sum()
        over = free & (want > max_epochs * sizes)
        if not over.any():
            epochs[free] = want[free] / sizes[free]
            break
        epochs[over] = max_epochs
        left -= max_epochs * float(sizes[over].sum())
        free &= ~over
    return epochs


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and doc_id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED, numbered: bool = True) -> DataFrame:
    """The rows of docs, each as often as its source's epochs ask, with the column copy (1, 2, ...) if numbered.

    weights gives the target weight of each source, a missing one being 0; without it the weights are the square roots of
    the sources' characters. A source repeated e times has each row floor(e) times, and once more if a number drawn from
    seed and doc_id is below the rest. A null source is a source like any other. A null text has no characters, so a
    source of null or empty texts only has no size and none of its rows is drawn. Rows that repeat a doc_id are drawn
    alike; a null doc_id counts as the empty one. No rows in, no rows out. Further columns stay as they are; if one is
    called copy, the new one is called copy_.
    """
    inner, restore = seal(docs, "doc_id", "text", "source")
    sizes = inner.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size")).toPandas()  # a row for each source
    sizes = sizes.sort_values("source", na_position="first", kind="stable")
    size = sizes["size"].to_numpy(np.float64)
    names = [None if x is None or x != x else x for x in sizes["source"]]
    weight = np.sqrt(size) if weights is None else np.array([weights.get(n, 0.0) for n in names], np.float64)
    epochs = water_fill(size, weight, budget * size.sum(), max_epochs)
    rates = docs.sparkSession.createDataFrame([(n, float(e)) for n, e in zip(names, epochs)], "name string, epochs double")
    if len(names) <= MOST_BROADCAST:
        rates = F.broadcast(rates)  # else a shuffled join, whose hot sources adaptive execution splits
    whole = F.floor("epochs")
    copies = (whole + (draw(F.col("doc_id"), seed) < F.col("epochs") - whole).cast("long")).cast("int")
    drawn = inner.join(rates, F.col("source").cast("string").eqNullSafe(F.col("name")), "inner").withColumn("copies", copies).where("copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*inner.columns, "copy")
    return restore(out, "copy") if numbered else restore(out.drop("copy"))


def oracle(max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, seed: int = SEED) -> str:
    """The same rows in DuckDB SQL: the clamped sources are the first ones by cap over weight."""
    return f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS n FROM documents GROUP BY source),
w AS (SELECT *, sqrt(n) AS w, {max_epochs} * n AS cap FROM s WHERE n > 0),
o AS (SELECT *, row_number() OVER r AS k, sum(cap) OVER r - cap AS before, sum(w) OVER () - (sum(w) OVER r - w) AS rest,
             {budget} * sum(n) OVER () AS total FROM w WINDOW r AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((total - before) / rest, k) AS level, min(k) AS k FROM o WHERE (total - before) / rest * w <= cap),
e AS (SELECT o.source, CASE WHEN l.k IS NULL OR o.k < l.k THEN {max_epochs} ELSE l.level * o.w / o.n END AS epochs FROM o, l),
d AS (SELECT t.*, epochs, ('0x' || substr(md5('{seed}:' || coalesce(t.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM documents t JOIN e ON t.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, (floor(epochs) + CASE WHEN u < epochs - floor(epochs) THEN 1 ELSE 0 END)::INT))::INT AS copy FROM d"""
