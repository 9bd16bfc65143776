"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

The statistics come from whole texts by numpy kernels. The trees are fitted on the driver with at most SAMPLE labelled
documents, those with the smallest hash of doc_id; scoring walks all trees of a batch at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import lean, mix, segment_sum, span_hashes, split_batches, text_bytes, word_spans
from corpusloom.llm.shared import pick, seal

#: Most labelled documents to fit on; the sample is broadcast, so this bounds its size too.
SAMPLE = 8192
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.2, 1.0, 8
#: The share of good held-out documents that the threshold may reject.
MAX_FALSE_REJECTS = 0.002
STOP_WORDS = ("the of and to in is that for it as was with be by on are this from an at not or which le la de et les des en un une du est que pour dans par sur au aux avec ne se der die das und den von zu mit sich dem ein eine ist auf für im nicht el los las del y por con para al lo su como más").split()
FEATURES = ("bytes", "words", "word_bytes", "tokens", "token_bytes", "upper", "digit", "stop_mark", "comma", "bang", "symbol", "pipe", "space", "non_ascii", "lines", "line_bytes", "copied_lines", "copied_line_bytes", "distinct", "top_word", "stop_words", "short_words", "long_words", "marked_tokens", "upper_words", "line_ends", "longest_token")


def _byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null reads as empty."""
    data, off = text_bytes(texts, lower=False)
    n, size = len(texts), np.diff(off) - 1
    if not n:
        return np.zeros((0, len(FEATURES)))

    def count(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.diff(np.searchsorted(at, off)).astype(float)

    space = _byte_class(b" \t\n\r\x0b\x0c")[data]
    upper = _byte_class(bytes(range(65, 91)))[data]
    lowered = data + upper.astype(np.uint8) * np.uint8(32)
    ws, we = word_spans(data)
    wo = np.searchsorted(ws, off)
    words = np.diff(wo).astype(float)
    hashes = span_hashes(lowered, ws, we)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(wo))
    keys, times = np.unique((doc << np.uint64(40)) | (hashes >> np.uint64(24)), return_counts=True)
    ko = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(40))
    top = np.zeros(n)
    if len(keys):
        full = ko[1:] > ko[:-1]
        top[full] = np.maximum.reduceat(times, ko[:-1][full])
    stop = np.isin(hashes, stop_hashes())
    length = we - ws

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), wo)).astype(float)

    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    ts, te = edge[0::2], edge[1::2]
    to = np.searchsorted(ts, off)
    tokens = np.diff(to).astype(float)
    longest = np.zeros(n)
    if len(ts):
        full = to[1:] > to[:-1]
        longest[full] = np.maximum.reduceat(te - ts, to[:-1][full])
    symbol = _byte_class(b"#$%&*@^~+=<>{}[]|\\")[data]
    marked = np.diff(np.searchsorted(np.flatnonzero(symbol[te - 1]), to)).astype(float) if len(ts) else np.zeros(n)

    nl = np.flatnonzero(data == 10)
    ls, le = np.append(0, nl[:-1] + 1), nl
    lo = np.searchsorted(ls, off)
    solid = le > ls
    lh = np.where(solid, span_hashes(data, ls, le), 0).astype(np.uint64)
    ldoc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(lo))
    _, first = np.unique(mix(lh) ^ mix(ldoc + np.uint64(1)), return_index=True)
    again = solid.copy()
    again[first] = False
    lines = np.diff(np.searchsorted(np.flatnonzero(solid), lo)).astype(float)
    ends = solid & np.isin(data[np.maximum(le - 1, 0)], np.frombuffer(b'.!?:;"', np.uint8))
    copied = np.diff(np.searchsorted(np.flatnonzero(again), lo)).astype(float)
    copied_bytes = segment_sum(np.where(again, le - ls, 0), lo).astype(float)

    out = np.stack([
        size, words, _share(segment_sum(length, wo), words), tokens, _share(size - count(space) + 1, tokens),
        _share(count(upper), size), _share(count(_byte_class(b"0123456789")[data]), size), _share(count(data == 46), words), _share(count(data == 44), words), _share(count(data == 33), words),
        _share(count(symbol), size), _share(count(data == 124), tokens), _share(count(space) - 1, size), _share(count(data >= 128), size),
        lines, _share(size, lines), _share(copied, lines), _share(copied_bytes, size),
        _share(np.diff(ko).astype(float), words), _share(top, words), _share(of_words(stop), words), _share(of_words(length <= 3), words), _share(of_words(length >= 12), words),
        _share(marked, tokens), _share(of_words(upper[ws] & upper[we - 1] & (length > 1)) if len(ws) else np.zeros(n), words),
        _share(np.diff(np.searchsorted(np.flatnonzero(ends), lo)).astype(float), lines), longest,
    ], 1)
    return out


def stop_hashes() -> np.ndarray:
    data, off = text_bytes(pa.array(STOP_WORDS))
    return span_hashes(data, off[:-1], off[1:] - 1)


@dataclass
class Forest:
    """Trees of equal depth as arrays [tree, node]; children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    base: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        tree = np.arange(len(self.feature))[None]
        total = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.split[tree, node])
            total[lo : lo + 4096] += self.value[tree, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost TREES trees on logistic loss over BINS quantile bins of each feature, then set the threshold on held-out rows.

    A fifth of the rows is held out to set the threshold. With one class only, or none, everything is kept; with so few
    rows that no split leaves LEAST on both sides, all scores are the same and everything is kept, too.
    """
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    forest = Forest(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), 0.0, 0.0)
    if len(set(y.tolist())) < 2:
        return forest
    held = np.arange(len(y)) % 5 == 4
    xt, yt = x[~held], y[~held].astype(float)
    n, d = xt.shape
    cuts = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], xt[:, j], "left") for j in range(d)], 1)
    rate = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
    forest.base = float(np.log(rate / (1 - rate)))
    raw = np.full(n, forest.base)
    flat = binned + np.arange(d) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = yt - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            width = 2**depth
            key = (node[:, None] * d * BINS + flat).ravel()
            shape = (width, d, BINS)
            g, h, c = (np.bincount(key, np.repeat(v, d), width * d * BINS).reshape(shape).cumsum(2) for v in (grad, hess, np.ones(n)))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain = np.where((c >= LEAST) & (ct - c >= LEAST), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                at = width - 1 + i
                if gain[i, best[i]] > 1e-9 and b < len(cuts[j]):
                    forest.feature[t, at], forest.split[t, at] = j, cuts[j][b]
            at = width - 1 + node
            node = 2 * node + (xt[np.arange(n), forest.feature[t, at]] > forest.split[t, at])
        gs, hs = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        forest.value[t] = RATE * gs / (hs + L2)
        raw += forest.value[t][node]
    good = np.sort(forest.score(x[held & (y == 1)])) if (held & (y == 1)).any() else np.zeros(1)
    forest.threshold = float(min(0.5, good[int(MAX_FALSE_REJECTS * len(good))]))
    return forest


def _statistics_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in split_batches(batches):
        rows = statistics(b.column(1))
        yield pa.record_batch([b.column(0), b.column(2), pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32), rows.ravel())], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most `sample` labelled documents. Null labels and ids are left out; of several labels of one document the
    lowest counts, and of several texts that with the least statistics."""
    known = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null")
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, doc_id="doc_id", text="text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(lean(_statistics_udf), "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x").toArrow().sort_by("doc_id")
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows.column("quality").to_numpy())


def _scores(forest: Forest):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [forest.score(statistics(b.column(0))) for b in split_batches([pa.record_batch([texts], ["text"])])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for each row of docs.

    score is the probability of good quality, over the whole text however long; keep says whether it reaches the
    threshold, a score that equals it included. A null text has a null score and isn't kept; an empty text is scored like
    any other. Rows with a null doc_id and repeated rows are scored row by row. Equal texts get equal scores. No rows in,
    no rows out; without labels of both classes every text is kept. Of docs, only doc_id and text are read.
    """
    forest = train(docs, labels)
    scored = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.when(F.col("text").isNotNull(), _scores(forest)("text")).alias("score"))
    return scored.select("doc_id", "score", F.coalesce(F.col("score") >= forest.threshold, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns."""
    forest = train(docs, labels)
    inner, restore = seal(docs, "doc_id", "text")
    return restore(inner.where(F.col("text").isNotNull() & (_scores(forest)("text") >= forest.threshold)))
