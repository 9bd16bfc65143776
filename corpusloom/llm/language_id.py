"""Language identification: averaged hashed subword embeddings, linear softmax, numpy SGD, calibrated rejection.

Subwords are the byte 3-grams and 4-grams of the lower-cased text. Once trained, embeddings and output layer are folded
into one score per subword bucket and language, so a text costs one table row for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import lean, segment_sum, split_batches, text_bytes
from corpusloom.llm.shared import pick

#: Most labelled documents to fit on, hash buckets, embedding width, steps, learning rate, documents in a step.
SAMPLE, BUCKETS, WIDTH, STEPS, RATE, STEP, SEED = 2048, 1 << 15, 16, 320, 2.0, 32, 5
#: The share of wrong labels among held-out accepted texts that the rejection threshold allows.
MAX_ERROR = 0.005
_BLOCK = 1 << 20


def subwords(data: np.ndarray) -> np.ndarray:
    """Bucket of the 3-gram and of the 4-gram that begin at each byte, [n, 2]; -1 where one would leave the data."""
    d = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    three = d[:-3] * np.uint32(0x9E3779B1) ^ d[1:-2] * np.uint32(0x85EBCA77) ^ d[2:-1] * np.uint32(0xC2B2AE3D)
    four = three * np.uint32(0x27D4EB2F) ^ d[3:] * np.uint32(0x165667B1) ^ np.uint32(0x5BD1E995)
    out = np.stack([(x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 15) for x in (three, four)], 1).astype(np.int32)
    return out


def text_scores(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table rows of all subwords of each text, and their number."""
    data, off = text_bytes(texts)
    n = len(texts)
    size = np.maximum(np.diff(off) - 1, 0)  # without the closing newline
    total = np.zeros((n, table.shape[1]))
    for lo in range(0, len(data), _BLOCK):
        hi = min(len(data), lo + _BLOCK)
        grams = subwords(data[lo : min(len(data), hi + 3)])[: hi - lo]
        rows = table[grams[:, 0]] + table[grams[:, 1]]
        first, last = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
        cut = np.clip(off[first : last + 1], lo, hi) - lo
        ends = np.clip(off[first + 1 : last + 1] - 3, lo, hi) - lo  # grams must not reach over a text's end
        prefix = np.zeros((len(rows) + 1, table.shape[1]))
        np.cumsum(rows, axis=0, out=prefix[1:])
        total[first:last] += prefix[np.maximum(ends, cut[:-1])] - prefix[cut[:-1]]
    return total, 2 * np.maximum(size - 2, 0)


@dataclass
class Model:
    """table: score of each bucket and language; bias; temperature and threshold set on held-out texts."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        total, count = text_scores(texts, self.table)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z, count = self.logits(texts)
        return softmax(z / self.temperature), count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def bag_of(text: str) -> Bag:
    """The distinct subwords of a text, BUCKETS at most, and how often each occurs."""
    data, _ = text_bytes(pa.array([text]))
    times = np.zeros(BUCKETS, np.int64)
    for lo in range(0, max(len(data) - 3, 0), _BLOCK):
        times += np.bincount(subwords(data[lo : lo + _BLOCK + 3])[: min(_BLOCK, len(data) - 3 - lo)].ravel(), minlength=BUCKETS)
    ids = np.flatnonzero(times)
    return ids, times[ids]


def fit(texts: list[str], languages: list[str]) -> Model:
    return fit_bags([bag_of(t) for t in texts], languages)


def fit_bags(counted: list[Bag], languages: list[str]) -> Model:
    """Train on four fifths of the texts; calibrate temperature and rejection on the rest. Classes weigh alike."""
    names = sorted(set(languages))
    k = len(names)
    if k < 2:
        return Model(names or ["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    y = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 4
    bags = [(ids, (times / max(times.sum(), 1)).astype(np.float32)) for ids, times in counted]
    weight = len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1))
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    train = np.flatnonzero(~held)
    order = np.concatenate([rng.permutation(train) for _ in range(-(-STEPS * STEP // max(len(train), 1)))]) if len(train) else train
    for step, lo in enumerate(range(0, min(len(order), STEPS * STEP), STEP)):  # as many passes as the steps need
        rate = RATE * (1 - step / STEPS)
        rows = order[lo : lo + STEP]
        ids, part = np.concatenate([bags[i][0] for i in rows]), np.concatenate([bags[i][1] for i in rows])
        size = np.array([len(bags[i][0]) for i in rows])
        doc = np.repeat(np.arange(len(rows)), size)
        hidden = segment_sum(e[ids] * part[:, None], np.append(0, np.cumsum(size)))
        p = softmax(hidden @ w + b)
        p[np.arange(len(rows)), y[rows]] -= 1
        p *= weight[y[rows]][:, None] / len(rows)
        back = (p @ w.T).astype(np.float32) * np.float32(len(rows))  # embeddings step by text, the small layer by batch
        w -= rate * (hidden.T @ p).astype(np.float32)
        b -= rate * p.sum(0).astype(np.float32)
        by = np.argsort(ids, kind="stable")
        bucket, first = np.unique(ids[by], return_index=True)
        if len(bucket):
            e[bucket] -= np.float32(rate) * np.add.reduceat((back[doc] * part[:, None])[by], first, axis=0)
    model = Model(names, (e @ w).astype(np.float32), b.astype(np.float64))
    check = np.flatnonzero(held)
    if len(check):
        z = np.stack([(bags[i][1][:, None] * model.table[bags[i][0]]).sum(0, dtype=np.float64) for i in check]) + model.bias
        grid = np.geomspace(0.02, 5, 60)
        model.temperature = float(grid[np.argmin([-np.log(np.maximum(softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid])])
        p = softmax(z / model.temperature)
        best = p.max(1)
        order = np.argsort(-best)
        wrong = np.cumsum(p.argmax(1)[order] != y[check][order]) / np.arange(1, len(check) + 1)
        last = np.append(np.diff(best[order]) != 0, True)  # texts as confident as the threshold are all accepted
        allowed = np.flatnonzero(last & (wrong <= MAX_ERROR))
        if not len(allowed):
            model.threshold = np.inf
        elif allowed[-1] < len(order) - 1:
            model.threshold = float(best[order[allowed[-1]]])
        else:  # the bound excludes none: halfway from the least confidence down to what an even guess would have
            model.threshold = float(best[order[-1]] + 1 / k) / 2
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows whose doc_id, lang and text are there: those with the smallest hash of doc_id.

    The driver gets a bag of subwords for each, which has a bound however long the texts are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            bags = [bag_of(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([x[i].astype(np.int32) for x in bags], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.record_batch([b.column("doc_id"), b.column("lang"), *columns], ["doc_id", "lang", "ids", "times"])

    known = pick(docs, doc_id="doc_id", text="text", lang="lang").where("doc_id is not null and text is not null and text != '' and lang is not null")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")
    rows = chosen.mapInArrow(lean(count), "doc_id long, lang string, ids array<int>, times array<int>").toArrow().sort_by("doc_id")
    bags = [(np.array(i, np.int64), np.array(t, np.int64)) for i, t in zip(rows.column("ids").to_pylist(), rows.column("times").to_pylist())]
    return fit_bags(bags, rows.column("lang").to_pylist())


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, predicted, confidence, accepted) for each row of docs, over the whole text.

    predicted is the likeliest language and confidence its calibrated probability; accepted says whether that reaches the
    rejection threshold. Of languages with the same probability the first by name is predicted. A text of any length
    counts to its end. A null text, and one of under three bytes, has no subwords: predicted is "und", the confidence 0,
    and it isn't accepted. Rows with a null doc_id and repeated rows are judged row by row; lang serves for training
    only, and null labels are left out. With labels of one language only, that one is predicted with confidence 1; with
    none, "und". Only doc_id, text and lang are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for b in split_batches(batches):
            p, count = model.probabilities(b.column(1))
            best = np.where(count > 0, p.max(1), 0.0)
            ok = (count > 0) & (best >= model.threshold) & (names[p.argmax(1)] != "und")
            label = np.where(count > 0, names[p.argmax(1)], "und")
            yield pa.record_batch([b.column(0), pa.array(label.tolist(), pa.string()), pa.array(best), pa.array(ok)], ["doc_id", "predicted", "confidence", "accepted"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(run), "doc_id long, predicted string, confidence double, accepted boolean")
