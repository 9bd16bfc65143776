"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. A randomised SVD finds their leading right singular
vectors: every task adds its passages, each under a random sign, into one of SKETCH rows (a sparse embedding of the
passage side), the sums of those rows are the sketch of the whole corpus, and the SVD of the sketch gives the basis.
Windows of the documents and the benchmark passages are folded into that space and compared by cosine, every window with
every passage of like length. Those alike are the candidates, and are verified on word hashes: longest common subsequence
with the passage, and the share of its rarest words, the answer, that the window holds. A bit set of the words of window
and passage drops, without loss, candidates that have too few words in common for either check.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import doc_words, lean, mix, segment_sum, split_batches
from corpusloom.llm.shared import cut, pick, seal

#: Hash buckets of words, words of a TF-IDF passage, rows of the sketch, dimensions of the latent space.
BUCKETS, PASSAGE, SKETCH, RANK = 1 << 14, 32, 128, 64
#: Window sizes in words double from the first, as far as the longest passage asks, and step by half. A passage meets the
#: least window of at least 0.7 of its length.
WINDOW, FIT = 16, 0.7
#: Most passages broadcast at once; a larger benchmark is searched for in several passes over the word hashes.
PASSAGES_AT_ONCE = 4096
#: Least cosine of a candidate, least LCS share, least share of answer words, number of answer words, and the LCS share
#: from which the answer isn't asked for.
COSINE, COMMON, ANSWER, ANSWER_WORDS, STRONG = 0.4, 0.5, 0.4, 5, 0.75
#: Bits of a word set for each word of a window, and tasks whose sketches are added up first.
_BITS, _BRANCH = 8, 64


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint32(BUCKETS - 1)).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, off = doc_words(texts)
    return (hashes >> np.uint64(32)).astype(np.uint32), off


def _digest() -> Column:
    """Tells texts of rows without doc_id apart; null where there is a doc_id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, words): 32-bit word hashes of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            words, off = words_of(b.column("text"))
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(words)])
            yield pa.record_batch([b.column("doc_id"), b.column("digest"), blob.cast(pa.binary())], ["doc_id", "digest", "words"])

    known = pick(docs, doc_id="doc_id", text="text").where("text is not null").select("doc_id", _digest().alias("digest"), "text")
    return known.mapInArrow(lean(run), "doc_id long, digest long, words binary")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their words and word offsets, in blocks of bounded size."""
    for b in split_batches(batches, "words", 1 << 20):
        col = b.column("words")
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        words = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(np.uint32)
        yield b, words, (off - off[0]) // 4


def _blocks(off: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of `step` words that don't cross documents (with the end), and each document's first block."""
    count = -(-np.diff(off) // step)
    first = np.append(0, np.cumsum(count))
    at = np.repeat(off[:-1], count) + step * (np.arange(first[-1]) - np.repeat(first[:-1], count))
    return np.append(at, off[-1]), first


def passage_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Number of passages that hold each bucket, and of passages, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(BUCKETS, np.int64), 0
        for _, words, off in _batches(batches):
            start, first = _blocks(off, PASSAGE)
            rows = np.full((len(start) - 1, PASSAGE), BUCKETS, np.uint16)  # BUCKETS, the largest, fills short passages
            size = np.diff(start)
            rows.ravel()[np.arange(len(words)) + np.repeat(PASSAGE * np.arange(len(size)) - start[:-1], size)] = bucket_of(words)
            rows.sort(axis=1)
            new = np.ones(rows.shape, bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            held += np.bincount(rows[new], minlength=BUCKETS + 1)[:BUCKETS]
            n += int(first[-1])
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(held[some], n))], ["bucket", "n"])

    rows = tokens.mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    held = np.zeros(BUCKETS + 1, np.int64)
    held[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return held[:-1], int(held[-1])


def inverse_frequencies(held: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (held + 1)).astype(np.float32)


def sketch(tokens: DataFrame, idf: np.ndarray) -> np.ndarray:
    """SKETCH rows over BUCKETS: signed sums of the unit TF-IDF vectors of all passages.

    Each task has SKETCH rows; those of _BRANCH tasks are added up first, and their sums then, so that the second step
    gets a small part of what the tasks make.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(SKETCH * BUCKETS)
        for b, words, off in _batches(batches):
            start, first = _blocks(off, PASSAGE)
            size, bucket = np.diff(start), bucket_of(words)
            weight = own[bucket]
            norm = np.sqrt(np.maximum(segment_sum(weight.astype(np.float64) ** 2, start), 1e-12))
            nth = np.arange(len(start) - 1) - np.repeat(first[:-1], np.diff(first))
            ids = pc.coalesce(b.column("doc_id"), b.column("digest")).to_numpy()
            draw = mix(mix(np.repeat(ids, np.diff(first)).astype(np.uint64)) + nth.astype(np.uint64))
            sign = np.where(draw >> np.uint64(63), 1.0, -1.0) / norm
            row = (draw % np.uint64(SKETCH)).astype(np.int64)
            total += np.bincount(np.repeat(row * BUCKETS, size) + bucket, weight * np.repeat(sign, size), SKETCH * BUCKETS)
        branch = np.full(SKETCH, TaskContext.get().partitionId() // _BRANCH)
        yield pa.record_batch([pa.array(branch), pa.array(np.arange(SKETCH)), pa.array([r.astype(np.float32).tobytes() for r in total.reshape(SKETCH, BUCKETS)], pa.binary())], ["branch", "row", "part"])

    def add(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row, part in zip(b.column("row").to_pylist(), b.column("part")):
                sums[row] = sums.get(row, 0) + np.frombuffer(part.as_buffer(), kind).astype(np.float64)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["row", "part"])

    parts = tokens.mapInArrow(lean(run), "branch long, row long, part binary").repartition("row", "branch")
    some = parts.mapInArrow(lean(lambda batches: add(batches, np.float32)), "row long, part binary").repartition("row")
    rows = some.mapInArrow(lean(lambda batches: add(batches, np.float64)), "row long, part binary").toArrow()  # SKETCH rows
    shared.destroy()
    out = np.zeros((SKETCH, BUCKETS))
    for row, part in zip(rows.column("row").to_pylist(), rows.column("part").to_pylist()):
        out[row] = np.frombuffer(part)
    return out.astype(np.float32)


@dataclass
class Space:
    """fold: the latent row of each bucket, idf included; inverse frequencies."""

    fold: np.ndarray
    idf: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, idf: np.ndarray) -> Space:
        """The leading right singular vectors of the sketch, each scaled down by its singular value."""
        _, s, vt = np.linalg.svd(rows.astype(np.float64), full_matrices=False)
        keep = s[:RANK] > 1e-9 * max(s[0], 1e-300)
        fold = np.zeros((BUCKETS, RANK), np.float32)
        fold[:, : keep.sum()] = (vt[:RANK][keep] / s[:RANK][keep][:, None]).T * idf[:, None]
        return Space(fold, idf)

    def project(self, words: np.ndarray) -> np.ndarray:
        return self.fold[bucket_of(words)].sum(0)


@dataclass
class Passage:
    item_id: int
    words: list[int]
    answer: list[int]
    window: int

    @cached_property
    def masks(self) -> dict[int, int]:
        return masks_of(self.words)


def passages_of(bench: list[tuple[int, str]], idf: np.ndarray) -> list[Passage]:
    """Each benchmark passage that has words, as a whole however long it is."""
    out = []
    for item_id, text in bench:
        words, _ = words_of(pa.array([text]))
        if len(words):
            distinct = np.unique(words)
            rare = distinct[np.lexsort((distinct, -idf[bucket_of(distinct)]))][:ANSWER_WORDS]
            window = WINDOW
            while window < FIT * len(words):
                window *= 2
            out.append(Passage(item_id, words.tolist(), rare.tolist(), window))
    return out


def masks_of(words: list[int]) -> dict[int, int]:
    """Bit set of the places of each word, for lcs_length."""
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with the n masked words, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def _word_sets(words: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """A bit set of size * _BITS bits for the words of each span."""
    width = size * _BITS
    bit = (words * np.uint32(0x9E3779B1) >> np.uint32(33 - width.bit_length())).astype(np.int64)
    held = np.zeros((len(off) - 1) * width, bool)
    held[np.repeat(np.arange(len(off) - 1) * width, np.diff(off)) + bit] = True
    return np.packbits(held).view(np.uint64).reshape(len(off) - 1, width // 64)


@dataclass
class Blocks:
    """Half-window blocks of all documents: starts (with the end), each document's first block, latent sums."""

    start: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(space: Space, words: np.ndarray, off: np.ndarray, half: int) -> Blocks:
        start, first = _blocks(off, half)
        n = len(start) - 1
        sums = np.zeros((n, RANK), np.float32)
        bucket = bucket_of(words)
        for lo in range(0, n, 512):  # the gathered rows stay in cache
            hi = min(n, lo + 512)
            np.add.reduceat(space.fold.take(bucket[start[lo] : start[hi]], axis=0), start[lo:hi] - start[lo], axis=0, out=sums[lo:hi])
        return Blocks(start, first, sums)

    def doubled(self, off: np.ndarray, half: int) -> Blocks:
        """Of two neighbouring blocks one of twice the size, `half`."""
        start, first = _blocks(off, half)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        left = self.first[doc] + 2 * (np.arange(first[-1]) - first[doc])
        pair = left + 1 < self.first[doc + 1]
        sums = self.sums[left]
        sums[pair] += self.sums[left[pair] + 1]
        return Blocks(start, first, sums)


class Matcher:
    """The passages of one window size, ready for search."""

    def __init__(self, space: Space, passages: list[Passage], size: int) -> None:
        self.size, self.passages = size, [p for p in passages if p.window == size]
        self.target = _unit(np.stack([space.project(np.array(p.words, np.uint32)) for p in self.passages])).astype(np.float32).T.copy()
        self.length = np.array([len(p.words) for p in self.passages], np.int64)
        self.sets = _word_sets(np.array([w for p in self.passages for w in p.words], np.uint32), np.append(0, np.cumsum(self.length)), size)
        self.distinct = np.bitwise_count(self.sets).sum(1, dtype=np.int64)
        answers = sorted((w, j) for j, p in enumerate(self.passages) for w in p.answer)
        self.word, at = np.unique(np.array([w for w, _ in answers], np.uint32), return_index=True)
        self.passage, self.cut = np.array([j for _, j in answers], np.int64), np.append(at, len(answers))
        self.need = np.array([len(p.answer) for p in self.passages], np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.word & np.uint32(0xFFFF)] = True

    def answers_held(self, words: np.ndarray, start: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted window * passages + passage, and the share of its answer in the window with half a window around, if any."""
        where = np.flatnonzero(self.maybe[words & np.uint32(0xFFFF)])
        w = np.minimum(np.searchsorted(self.word, words[where]), len(self.word) - 1)
        same = self.word[w] == words[where]
        where, w = where[same], w[same]
        mid = np.searchsorted(start, where, "right") - 1
        # the half-window blocks whose windows, so widened, reach the word
        block = (mid[:, None] + np.array([-2, -1, 0, 1])).ravel()
        w, mid = np.repeat(w, 4), np.repeat(mid, 4)
        ok = (block >= 0) & (block < len(doc))
        ok[ok] = doc[block[ok]] == doc[mid[ok]]
        block, w = block[ok], w[ok]
        seen = np.unique(block * len(self.word) + w)  # a word counts once in a window
        block, w = seen // len(self.word), seen % len(self.word)
        each = np.diff(self.cut)[w]
        passage = self.passage[np.repeat(self.cut[w] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        pairs, count = np.unique(np.repeat(block, each) * len(self.passages) + passage, return_counts=True)
        return pairs, count / self.need[pairs % len(self.passages)]

    def candidates(self, blocks: Blocks, words: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, passage, cosine, lacks) of all pairs within COSINE whose widened window doesn't lack too many words.

        lacks is the number of words of the passage, at least, that the widened window doesn't hold; each of them is missing
        from every common subsequence.
        """
        n = len(blocks.sums)
        own = _word_sets(words, blocks.start, self.size)
        step = max(1, (1 << 21) // len(self.passages))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            window = blocks.sums[lo:hi].copy()
            inner = np.flatnonzero(~last[lo:hi])
            window[inner] += blocks.sums[lo + 1 + inner]
            cosine = _unit(window) @ self.target  # every window with every passage
            at, p = np.nonzero(cosine >= COSINE)
            wide, row = own[lo:hi].copy(), np.arange(lo, hi)
            before = row[(row > 0) & ~last[row - 1]]
            wide[before - lo] |= own[before - 1]
            after = row[~last[lo:hi]]
            wide[after - lo] |= own[after + 1]
            after = after[~last[after + 1]]
            wide[after - lo] |= own[after + 2]
            for k in range(0, len(at), 1 << 16):
                a, b = at[k : k + (1 << 16)], p[k : k + (1 << 16)]
                lacks = self.distinct[b] - np.bitwise_count(wide[a] & self.sets[b]).sum(1, dtype=np.int64)
                able = np.flatnonzero(lacks <= (1 - COMMON) * self.length[b])
                a, b = a[able], b[able]
                yield a + lo, b, cosine[a, b], lacks[able]


def search(matchers: list[Matcher], space: Space, words: np.ndarray, off: np.ndarray) -> list[tuple]:
    """Verified matches (document, item_id, lcs, answer, cosine, start) of a block of documents."""
    out: list[tuple] = []
    if not len(words):
        return out
    half = WINDOW // 2
    blocks = Blocks.of(space, words, off, half)
    for m in sorted(matchers, key=lambda m: m.size):
        while 2 * half < m.size:
            half *= 2
            blocks = blocks.doubled(off, half)
        start, first = blocks.start, blocks.first
        last = np.zeros(len(start) - 1, bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        known, share = m.answers_held(words, start, doc)
        for at, passage, cosine, lacks in m.candidates(blocks, words, last):
            place = at * len(m.passages) + passage
            k = np.minimum(np.searchsorted(known, place), max(len(known) - 1, 0))
            answer = np.where(known[k] == place, share[k], 0.0) if len(known) else np.zeros(len(place))
            n = m.length[passage]
            for j in np.flatnonzero((answer >= ANSWER) | (lacks <= (1 - STRONG) * n)).tolist():
                i, p = int(at[j]), m.passages[passage[j]]
                d = int(doc[i])
                left, right = max(off[d], start[i] - half), min(off[d + 1], start[i] + m.size + half)
                lcs = lcs_length(p.masks, len(p.words), words[left:right].tolist()) / len(p.words)
                if lcs >= (COMMON if answer[j] >= ANSWER else STRONG):
                    out.append((d, p.item_id, lcs, float(answer[j]), float(cosine[j]), int(start[i] - off[d])))
    return out


def _found(tokens: DataFrame, space: Space, passages: list[Passage]) -> DataFrame:
    """All verified matches of the passages."""
    shared = tokens.sparkSession.sparkContext.broadcast((space, passages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, passages = shared.value
        matchers = [Matcher(space, passages, size) for size in sorted({p.window for p in passages})]
        for b, words, off in _batches(batches):
            rows = search(matchers, space, words, off)
            row, *rest = zip(*rows) if rows else ((),) * 6
            ids = [b.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "digest")]
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([*ids, *(pa.array(c, k) for c, k in zip(rest, kinds))], ["doc_id", "digest", "item_id", "lcs", "answer", "cosine", "start"])

    return tokens.mapInArrow(lean(run), "doc_id long, digest long, item_id long, lcs double, answer double, cosine double, start long")


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verified matches of all windows, with the digest of texts that have no doc_id."""
    tokens = cut(tokenised(docs), "tokens")
    held, n = passage_frequencies(tokens)
    idf = inverse_frequencies(held, n)
    rows = pick(benchmark, item_id="item_id", text="text").where("item_id is not null and text is not null").distinct().toArrow()
    bench = sorted(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))
    passages, space = passages_of(bench, idf), Space.of(sketch(tokens, idf), idf)
    parts = [_found(tokens, space, passages[lo : lo + PASSAGES_AT_ONCE]) for lo in range(0, max(len(passages), 1), PASSAGES_AT_ONCE)]
    return reduce(DataFrame.union, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine, start): the best match of each document and benchmark passage that match.

    lcs is the share of the passage's words in its longest common subsequence with the text around the window that begins
    at word `start`, answer the share of its rarest words found there. A document matches if its cosine is at least
    COSINE, and lcs at least COMMON with answer at least ANSWER, or lcs at least STRONG whatever the answer. Passages of any
    length are judged as a whole, and texts of any length are searched to their end. Of equally good windows the first
    counts. Null texts match nothing, neither do texts and passages without words; equal passages match alike, each under
    its own item_id; rows that repeat a doc_id are one document. Each text without doc_id is a document of its own, whose
    matches have a null doc_id. Only doc_id, text and item_id are read. No rows in, or no passages, no rows out.
    """
    best = F.max(F.struct("lcs", "answer", (-F.col("start")).alias("back"), "cosine")).alias("m")
    each = _matches(docs, benchmark).groupBy("doc_id", "digest", "item_id").agg(best)
    return each.select("doc_id", "item_id", "m.lcs", "m.answer", "m.cosine", (-F.col("m.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that contaminated names, those without doc_id among them. Columns are those of docs."""
    inner, restore = seal(docs, "doc_id", "text")
    gone = _matches(docs, benchmark).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & _digest().eqNullSafe(F.col("gone_digest"))
    return restore(inner.join(gone, same, "left_anti"))
