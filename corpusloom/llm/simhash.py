"""Near duplicates by SimHash: half-segment signatures over bit permutations, equality join, exact verification, components.

A signature has BITS bits, each the majority vote of one hash bit over the distinct lower-cased words of the whole
text. Two documents are near duplicates if at most MAX_DISTANCE bits differ. The signature, and the signature under
each of PERMUTATIONS - 1 fixed permutations of its bits, is cut into 2 * SEGMENTS halves of 16 bits; documents meet if
some half is the same, and all that meet are compared. That is so for every pair with fewer than 2 * SEGMENTS differing
bits, and for all but about one of ten thousand pairs at MAX_DISTANCE itself (README has the measured shares).

A document costs 2 * SEGMENTS rows a permutation; the shuffle key is (permutation, half, its 16 bits). A row carries
the four segments after its own; pairs that differ in at most ACCEPT of those 128 bits (a pair within MAX_DISTANCE
exceeds that once in some thousands of meetings, and one that far apart meets eight times on average) are brought
together again, as groups around a root, with their whole signatures. Only there pairs are left out, and only such as
the pairs found connect anyway; all that a bucket hands on is who may be whose duplicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import doc_words, give_back, lean, mix, split_batches, text_bytes
from corpusloom.llm.shared import cut, discard, pick, seal

BITS, SEGMENTS, MAX_DISTANCE = 512, 16, 80
#: Orders of the bits, the plain one among them, whose halves are joined.
PERMUTATIONS = 4
#: Of the CHECK segments that travel along: most differing bits of a candidate, and of one so close that it needs no other partner.
CHECK, ACCEPT, ABSORB = 4, 32, 12
#: Whole signatures so close that one of them needs no partners beside the other's.
NEAR = 40
_BLOCK, _WORDS = 255, 1 << 14
#: Buckets of more rows are compared by leaders; smaller ones together, about so many pairs at a time.
_LARGE, _PAIRS = 1024, 1 << 22


def word_bits(words: np.ndarray) -> np.ndarray:
    """BITS pseudo-random bits of each word hash, one byte each."""
    lanes = [mix(words * np.uint64(2 * i + 3) + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for i in range(BITS // 64)]
    return np.unpackbits(np.stack(lanes, 1).view(np.uint8), axis=1)


def signatures_of(texts: pa.Array) -> np.ndarray:
    """Packed signatures, one row of BITS / 8 bytes for each text. A text without words gets a hash of its bytes."""
    hashes, off = doc_words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(off))
    key = np.unique((doc << np.uint64(40)) | (hashes >> np.uint64(24)))
    votes, size = np.zeros((n, BITS), np.int32), np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    for lo in range(0, len(key), _WORDS):  # bounds the memory however long a text is
        part = key[lo : lo + _WORDS]
        own = (part >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        # eight one-byte counters to a machine word: sums of at most 255 rows cannot overflow
        blocks = -(-np.diff(np.append(first, len(part))) // _BLOCK)
        until = np.cumsum(blocks)
        step = np.arange(until[-1]) - np.repeat(until - blocks, blocks)
        bits = word_bits(part & np.uint64((1 << 40) - 1)).view(np.uint64)
        parts = np.add.reduceat(bits, np.repeat(first, blocks) + step * _BLOCK, axis=0).view(np.uint8).reshape(-1, BITS)
        votes[own[first]] += np.add.reduceat(parts, until - blocks, axis=0, dtype=np.int32)
    packed = np.packbits(2 * votes > size[:, None], axis=1)
    if (bare := np.flatnonzero(size == 0)).size:
        import xxhash

        data, at = text_bytes(texts, lower=False)
        own = np.array([xxhash.xxh64_intdigest(data[at[i] : at[i + 1]].tobytes()) for i in bare], np.uint64)
        packed[bare] = np.packbits(word_bits(own), axis=1)
    return packed


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _rows(col: pa.Array) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(col), BITS // 8)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig) for rows whose doc_id and text are both there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            yield pa.record_batch([b.column(0), _binary(signatures_of(b.column(1)))], ["doc_id", "sig"])

    known = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    return known.mapInArrow(lean(run), "doc_id long, sig binary")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def spanning_pairs(words: np.ndarray, limit: int = ACCEPT, absorb: int = ABSORB) -> list[tuple[int, int]]:
    """Pairs of rows within `limit` that connect whatever all such pairs connect.

    Leaders take every row within the limit as a pair, and absorb those within `absorb`, which lead no more. A row that a
    leader just misses, by `absorb` at most, is compared with those absorbed; none of them can reach a row further off. So
    the work on a large group of copies is linear in its size, and nothing is capped.
    """
    left, out = np.arange(len(words)), []
    while len(left):
        d = _distances(words[left], words[left[0]][None])
        out += [(int(left[0]), int(x)) for x in left[d <= limit][1:]]
        missed = left[(d > limit) & (d <= limit + absorb)]
        for x in left[d <= absorb][1:]:
            if not len(missed):
                break
            near = _distances(words[missed], words[x][None]) <= limit
            out += [(int(x), int(y)) for y in missed[near]]
            missed = missed[~near]
        left = left[d > absorb]
    return out


def _close_pairs(group: np.ndarray, words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, smaller first, of all pairs within the limit of one group; rows are sorted by group."""
    columns = list(np.ascontiguousarray(words.T))
    after = np.searchsorted(group, group, "right") - np.arange(len(group))  # the row and those behind it
    row, step, found = np.flatnonzero(after > 1), 1, []
    while len(row):
        d = sum(np.bitwise_count(w[row] ^ w[row + step]).astype(np.int16) for w in columns)
        near = row[d <= limit]
        found.append(np.stack([near, near + step]))
        step += 1
        row = row[after[row] > step]
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 2


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each of n rows is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs.ravel(), np.repeat(low, 2))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def group_pairs(group: np.ndarray, words: np.ndarray, limit: int, absorb: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """All pairs of rows within the limit of one group, [n, 2], but for groups with many such pairs: of these the first
    row, the number of rows, and spanning pairs counted from the first row. Rows are sorted by group."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    found, spans = [np.zeros((0, 2), np.int64)], []

    def span(at: int, n: int) -> None:
        if len(pairs := spanning_pairs(words[at : at + n], limit, absorb)):
            spans.append((int(at), int(n), np.array(pairs)))

    small = np.flatnonzero((size > 1) & (size <= _LARGE))
    for i in np.flatnonzero(size > _LARGE):
        span(start[i], size[i])
    part = np.cumsum(size[small] * (size[small] - 1) // 2) // _PAIRS
    for runs in np.split(small, np.flatnonzero(np.diff(part)) + 1):
        n = size[runs]
        rows = np.repeat(start[runs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run = np.repeat(np.arange(len(runs)), n)
        a, b = _close_pairs(run, words[rows], limit)
        dense = np.bincount(run[a], minlength=len(runs)) > 4 * n
        for i in runs[dense]:
            span(start[i], size[i])
        keep = ~dense[run[a]]
        found.append(np.stack([rows[a[keep]], rows[b[keep]]], 1))
    return np.concatenate(found), spans


def bucket_edges(bucket: np.ndarray, doc: np.ndarray, words: np.ndarray, limit: int = ACCEPT, absorb: int = ABSORB) -> np.ndarray:
    """(smaller, larger) pairs of documents within the limit that connect what all such pairs of one bucket connect.

    Rows are sorted by (bucket, doc), and all rows of a bucket are compared.
    """
    pairs, spans = group_pairs(bucket, words, limit, absorb)
    return _edges([doc[pairs], *(doc[at + p] for at, _, p in spans)])


def bucket_members(bucket: np.ndarray, doc: np.ndarray, check: np.ndarray) -> np.ndarray:
    """(root, member) pairs such that any two documents within ACCEPT in one bucket have a root in common, or one is the
    other's. In a bucket with many pairs the root is the smallest document of a connected component."""
    pairs, spans = group_pairs(bucket, check, ACCEPT, ABSORB)
    found = [doc[pairs]]
    for at, n, p in spans:
        root = np.full(n, np.iinfo(np.int64).max)
        own, label = doc[at : at + n], _roots(p, n)
        np.minimum.at(root, label, own)
        found.append(np.stack([root[label], own], 1)[np.bincount(label, minlength=n)[label] > 1])
    return _edges(found)


def _edges(found: list[np.ndarray]) -> np.ndarray:
    pairs = np.sort(np.concatenate(found), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def permuted(sig: np.ndarray, p: int) -> np.ndarray:
    """Packed signatures with their bits in the p-th fixed order; the first is as they are."""
    if not p:
        return sig
    order = np.argsort(mix(np.arange(BITS, dtype=np.uint64) + np.uint64(p * BITS)), kind="stable")
    return np.packbits(np.ascontiguousarray(np.unpackbits(sig, axis=1)[:, order]), axis=1)


def spread(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and check of each document's 2 * SEGMENTS rows, [n, 2 * SEGMENTS] and for the check [.., 2]."""
    half = sig.view(">u2").astype(np.int32)
    segment = np.arange(2 * SEGMENTS) // 2
    bucket = np.arange(2 * SEGMENTS, dtype=np.int32)[None] << 16 | half
    word = sig.view(np.uint32)[:, (segment[:, None] + 1 + np.arange(CHECK)) % SEGMENTS]
    return bucket, np.ascontiguousarray(word).view(np.uint64)


def _by_group(batches: Iterator[pa.RecordBatch], done: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """done(rows) over runs of whole groups; rows come sorted by group, their first column."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        kept.append(b)
        if sum(map(len, kept)) >= 1 << 18 and kept[0].column(0)[0] != (last := b.column(0)[-1]):
            whole = pa.concat_batches(kept)
            end = int(np.searchsorted(whole.column(0).to_numpy(), last.as_py()))
            yield done(whole.slice(0, end))
            kept = [pa.concat_batches([whole.slice(end)])]
            give_back()
    if kept:
        yield done(pa.concat_batches(kept))


def _pairs(edges: np.ndarray, *names: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], list(names))


def candidates(reps: DataFrame) -> DataFrame:
    """(root, member), distinct and partitioned by member: groups, their roots included, that hold every pair of
    (doc_id, sig) rows that some half joins and the check accepts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 8192):
                part = b.slice(lo, 8192)
                for p in range(PERMUTATIONS):
                    bucket, check = spread(permuted(_rows(part.column(1)), p))
                    bucket += p * 2 * SEGMENTS << 16
                    check = check.reshape(-1, 2).view(np.int64)
                    columns = (bucket.ravel(), np.repeat(part.column(0).to_numpy(), 2 * SEGMENTS), check[:, 0], check[:, 1])
                    yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["bucket", "doc", "c0", "c1"])
            give_back()

    def done(b: pa.RecordBatch) -> pa.RecordBatch:
        bucket, doc, c0, c1 = (c.to_numpy() for c in b.columns)
        members = bucket_members(bucket, doc, np.stack([c0, c1], 1).view(np.uint64))
        roots = np.unique(members[:, 0])
        return _pairs(np.concatenate([members, np.stack([roots, roots], 1)]), "root", "member")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, done)

    spreading = reps.select("doc_id", "sig").mapInArrow(lean(rows), "bucket int, doc long, c0 long, c1 long")
    together = spreading.repartition("bucket").sortWithinPartitions("bucket", "doc")
    return together.mapInArrow(lean(join), "root long, member long").repartition("member").dropDuplicates(["root", "member"])


def verified(groups: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of one group whose whole signatures differ in at most MAX_DISTANCE bits, as many as connect
    what all such pairs connect."""

    def done(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = _rows(b.column(2)).view(np.uint64)
        return _pairs(bucket_edges(b.column(0).to_numpy(), b.column(1).to_numpy(), sig, MAX_DISTANCE, NEAR), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, done)

    rows = groups.join(reps.select(F.col("doc_id").alias("member"), "sig"), "member").select("root", "member", "sig")
    return rows.repartition("root").sortWithinPartitions("root", "member").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large-star and small-star rounds."""
    state = before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least neighbours are combined before the shuffle, and a hub's rows may be split in the join
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        down = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "star")
        if before is not None:
            discard(before)
        edges = before = now
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) for each document that goes; keep_id, the smallest doc_id of its group, stays.

    Groups are the connected components of the near-duplicate relation. Rows whose doc_id or text is null are never
    duplicates. Rows that repeat a doc_id are one document: it is in a group if any of its texts is. Texts without any
    word, the empty one among them, are duplicates only of texts with the same bytes. A text counts whole however long
    it is, in bounded memory beyond its words. No rows in, no rows out. Only doc_id and text are read, so further columns
    of any name do no harm.
    """
    every = cut(signatures(docs), "signatures")
    reps = cut(every.groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "representatives")
    alike = every.join(reps.select("sig", F.col("doc_id").alias("a")), "sig").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    edges = cut(verified(candidates(reps), reps).union(alike), "edges")
    roots = components(edges)
    discard(every, reps, edges)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without those that near_duplicates names, and with one row for each doc_id and text that repeat.

    Rows whose doc_id or text is null stay, and so do rows of one doc_id with different texts, unless the document goes.
    Columns are those of docs; of equal doc_ids and texts any row's further columns stay.
    """
    inner, restore = seal(docs, "doc_id", "text")
    gone = near_duplicates(docs).select(F.col("doc_id").alias("gone_id"))
    ids = inner.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("again_id")).count()
    again = cut(ids.where("count > 1").select("again_id"), "repeated")
    left = inner.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    # only the rows of repeated ids are shuffled; if there are none, the second branch falls away
    is_again = (F.col("doc_id") == F.col("again_id")) & F.col("text").isNotNull()
    once = left.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"])
    return restore(left.join(again, is_again, "left_anti").unionByName(once))
