"""Numpy kernel of the text reuse between two corpora of which the right one is held by every task.

Words are numbers of the right vocabulary, -1 beyond it, and grams numbers of right grams, so nothing rests on hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]
#: Words of the left corpus that are compared at once; a longer unit goes alone.
WORDS = 200_000


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row begins in the values, and the values."""
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.flatten()


def _within(at: np.ndarray) -> np.ndarray:
    """For each value the end of its row."""
    return np.repeat(at[1:], np.diff(at))


class Held:
    """The right corpus: its vocabulary, its words as numbers, and its grams of up to n words for each (n, cap)."""

    def __init__(self, units: pa.Array, ws: pa.Array, kinds: tuple[tuple[int, int], ...]) -> None:
        self.units, self.kinds = units, kinds
        self.at, words = _lists(ws)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = _within(self.at)
        self.row = np.repeat(np.arange(len(units)), np.diff(self.at))
        self.often = np.bincount(self.ids, minlength=len(self.vocabulary))
        self.known: list[np.ndarray] = []  # the grams of two words and more, each as that of all words but the last, and the last
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        begin, gram = np.arange(len(self.ids)), self.ids
        for n in range(2, max(n for n, _ in kinds) + 1):
            on = begin + n - 1 < self.end[begin]
            begin, key = begin[on], gram[on] * len(self.vocabulary) + self.ids[begin[on] + n - 1]
            known, gram, many = np.unique(key, return_inverse=True, return_counts=True)
            self.known.append(known)
            if n in dict(kinds):
                self.places[n] = (begin[np.argsort(gram, kind="stable")], np.cumsum(many) - many, many)

    def best(self, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each n: the rows of both sides, the places of both sides and the length of the best run of each pair."""
        end, row = _within(at), np.repeat(np.arange(len(at) - 1), np.diff(at))
        begin = np.flatnonzero(ids >= 0)
        gram = ids[begin]
        for n, known in enumerate(self.known, 2):
            on = begin + n - 1 < end[begin]
            begin, gram = begin[on], gram[on]
            last = ids[begin + n - 1]
            on = last >= 0
            begin, key = begin[on], gram[on] * len(self.vocabulary) + last[on]
            gram = np.searchsorted(known, key)
            on = known[np.minimum(gram, len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
            begin, gram = begin[on], gram[on]
            if n in self.places:
                yield n, *self._runs(n, begin, gram, ids, row, end)

    def _runs(self, n: int, begin: np.ndarray, gram: np.ndarray, ids: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        order, first, many = self.places[n]
        few = many[gram] <= dict(self.kinds)[n]
        begin, gram = begin[few], gram[few]
        times = many[gram]
        p = np.repeat(begin, times)
        q = order[np.arange(len(p)) + np.repeat(first[gram] - np.cumsum(times) + times, times)]
        # hits of one diagonal one after the other; neighbours are one stretch
        r, b, diag = row[p], self.row[q], q - p
        sort = np.lexsort((p, diag, b, r))
        p, r, b, diag = p[sort], r[sort], b[sort], diag[sort]
        apart = np.ones(len(p), bool)
        apart[1:] = (r[1:] != r[:-1]) | (b[1:] != b[:-1]) | (diag[1:] != diag[:-1])
        heads = np.flatnonzero(apart | (np.diff(p, prepend=-2) != 1))
        tails = np.append(heads[1:], len(p))[: len(heads)] - 1
        start, to, r, b, diag, apart = p[heads], p[tails] + n, r[heads], b[heads], diag[heads], apart[heads]
        # each goes on through equal words, up to the next on its diagonal, with which it is one run then
        stop = np.minimum(end[start], self.end[start + diag] - diag)
        alike = np.flatnonzero(~apart[1:])
        stop[alike] = start[alike + 1]
        on = np.flatnonzero(to < stop)
        while len(on := on[ids[to[on]] == self.ids[to[on] + diag[on]]]):
            to[on] += 1
            on = on[to[on] < stop[on]]
        apart[1:] |= to[:-1] < start[1:]
        heads = np.flatnonzero(apart)
        tails = np.append(heads[1:], len(start))[: len(heads)] - 1
        start, to, r, b, diag = start[heads], to[tails], r[heads], b[heads], diag[heads]
        # the longest of each pair, of equal ones the first, then that on the lowest diagonal
        sort = np.lexsort((diag, start, start - to, b, r))
        r, b = r[sort], b[sort]
        one = np.ones(len(r), bool)
        one[1:] = (r[1:] != r[:-1]) | (b[1:] != b[:-1])
        sort = sort[one]
        return r[one], b[one], start[sort], start[sort] + diag[sort], (to - start)[sort]


def best_runs(held: Held) -> Callable[[Batches], Batches]:
    """Of batches of (unit, ws): (n, a, b, diag, start, len, words), the best run of each pair of units for each n, words being those of
    a run of n words. At the end, with n = 0, (start, len): words of the right vocabulary and how often they were read."""

    def work(batches: Batches) -> Batches:
        names, read, kind = ["n", "a", "b", "diag", "start", "len", "words"], np.zeros(len(held.vocabulary), np.int64), None
        for batch in batches:
            units, kind = batch.column("unit"), batch.column("unit").type
            at, words = _lists(batch.column("ws"))
            coded = words.dictionary_encode()
            of = pc.fill_null(pc.index_in(coded.dictionary, held.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = of[coded.indices.to_numpy(zero_copy_only=False)]
            read += np.bincount(ids[ids >= 0], minlength=len(read))
            i = 0
            while i < len(units):
                j = max(i + 1, int(np.searchsorted(at, at[i] + WORDS, "right")) - 1)
                part = at[i : j + 1] - at[i]
                for n, r, b, p, q, size in held.best(part, ids[at[i] : at[j]]):
                    start, told = p - part[r], size == n
                    each = held.ids[(q[told][:, None] + np.arange(n)).ravel()].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(told * n)).astype(np.int32)), pa.array(each))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), n, np.int32)), units.take(pa.array(i + r)), held.units.take(pa.array(b)), pa.array(q - held.at[b] - start), pa.array(start), pa.array(size), lists], names)
                i = j
        some = np.flatnonzero(read)
        if len(some):
            none = lambda t: pa.nulls(len(some), t)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int32)), none(kind), none(held.units.type), none(pa.int64()), pa.array(some), pa.array(read[some]), none(pa.list_(pa.int32()))], names)

    return work
