"""Token counts: greedy longest-match word pieces, counted by a trie with failure links, no piece being built.

The vocabulary is a trie over bytes. Each node knows its failure link, the node of the longest vocabulary suffix left
once the longest match of its string has been popped (repeatedly, if needed), and how many tokens that pops. A word is
read once from left to right; when no edge fits, the count grows by the pops of the node and the walk goes on at its
failure link. All distinct words of a batch walk at once, and the few longest, once the others have ended, one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.kernels import lean, segment_sum, span_hashes, split_batches, text_bytes, word_spans
from corpusloom.llm.shared import pick

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Stands for the end of a word; byte 10 never occurs inside one.
END = 10
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Words of more bytes walk apart from the rest; so few that step alone, at some tenths of a microsecond a byte; most steps remembered.
_WIDE, _FEW, _STEPS = 48, 256, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = TOKENIZER) -> list[bytes]:
    """The pieces of a tokenizer file whose word-final pieces end in </w>, as bytes with END for that mark."""
    alphabet = byte_alphabet()
    model = json.load(open(path, encoding="utf-8"))["model"]
    out = set()
    for piece in model["vocab"]:
        body = piece.removesuffix("</w>")
        if body and all(c in alphabet for c in body):
            out.add(bytes(alphabet[c] for c in body) + bytes([END]) * (body != piece))
    return sorted(out)


@dataclass
class Automaton:
    """keys: sorted node * 256 + byte; child: the node at that edge; pops, link: of each node; link -1 if nothing fits."""

    keys: np.ndarray
    child: np.ndarray
    link: np.ndarray
    pops: np.ndarray

    @staticmethod
    def build(vocabulary: list[bytes]) -> Automaton:
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                if b not in edges[node]:
                    edges[node][b] = len(edges)
                    edges.append({})
                    final.append(False)
                node = edges[node][b]
            final[node] = node != 0
        link, pops = [-1] * len(edges), [0] * len(edges)
        queue = [0]
        for node in queue:
            for b, kid in edges[node].items():
                queue.append(kid)
                if final[kid]:
                    link[kid], pops[kid] = 0, 1
                    continue
                at, n = link[node], pops[node]
                while at >= 0 and b not in edges[at]:
                    n += pops[at]
                    at = link[at]
                if at >= 0:
                    link[kid], pops[kid] = edges[at][b], n
        pairs = sorted((node * 256 + b, kid) for node, e in enumerate(edges) for b, kid in e.items())
        return Automaton(np.array([k for k, _ in pairs]), np.array([c for _, c in pairs]), np.array(link), np.array(pops))

    def edge(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        want = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.child[at], -1)

    @cached_property
    def _edges(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.child.tolist()))

    def _walk(self, word: bytes, node: int) -> tuple[int, int]:
        """The node, or -1, after the word's bytes, and the tokens popped on the way."""
        total, known, edges = 0, self.__dict__.setdefault("_known", {}), self._edges
        for byte in word:
            if (step := known.get(node << 8 | byte)) is None:
                to, n = node, 0
                while to >= 0 and to << 8 | byte not in edges:
                    n += int(self.pops[to])
                    to = int(self.link[to])
                if len(known) >= _STEPS:
                    known.clear()
                step = known[node << 8 | byte] = edges[to << 8 | byte] if to >= 0 else -1, n
            node, n = step
            total += n
            if node < 0:
                break
        return node, total

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each span with END after it; 1, an unknown word, where the vocabulary can't spell it."""
        order = np.argsort(start - end, kind="stable")  # longest first, so the words still being read are a prefix
        s, size = start[order], (end - start)[order]
        n = len(order)
        node, total, bad = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(int(size[0]) + 1 if n else 0):
            m = int(np.searchsorted(-size, -j, "right"))  # words with a byte, or the end mark, at place j
            if m <= _FEW and j > _WIDE:
                for i in np.flatnonzero(~bad[:m]).tolist():
                    node[i], more = self._walk(data[s[i] + j : s[i] + size[i]].tobytes() + bytes([END]), int(node[i]))
                    total[i] += more
                    bad[i] = node[i] < 0
                break
            byte = np.where(j < size[:m], data[np.minimum(s[:m] + j, len(data) - 1)], END).astype(np.int64)
            self._step(np.flatnonzero(~bad[:m]), byte, node, total, bad)
        live = np.flatnonzero(~bad & (node != 0))
        while len(live):
            total[live] += self.pops[node[live]]
            node[live] = self.link[node[live]]
            bad[live[node[live] < 0]] = True
            live = live[node[live] > 0]
        total[bad] = 1
        out = np.empty(n, np.int64)
        out[order] = total
        return out

    def _step(self, rows: np.ndarray, byte: np.ndarray, node: np.ndarray, total: np.ndarray, bad: np.ndarray) -> None:
        while len(rows):
            to = self.edge(node[rows], byte[rows])
            ok = to >= 0
            node[rows[ok]] = to[ok]
            rows = rows[~ok]
            total[rows] += self.pops[node[rows]]
            node[rows] = self.link[node[rows]]
            bad[rows[node[rows] < 0]] = True
            rows = rows[node[rows] >= 0]


def pre_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of word runs, and of each other byte that isn't white space."""
    s, e = word_spans(data)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    alone = np.flatnonzero((np.cumsum(inside[:-1]) == 0) & ~_SPACE[data])
    start, end = np.concatenate((s, alone)), np.concatenate((e, alone + 1))
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def count_texts(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    data, off = text_bytes(texts)
    start, end = pre_tokens(data)
    at = np.searchsorted(start, off)
    _, first, place = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    pieces = np.zeros(len(first), np.int64)
    size = end[first] - start[first]
    for rows in (np.flatnonzero(size <= _WIDE), np.flatnonzero(size > _WIDE)):
        pieces[rows] = automaton.count(data, start[first[rows]], end[first[rows]])
    return np.diff(at), segment_sum(pieces[place], at)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs, over the whole lower-cased text.

    Words are runs of letters, digits, underscores and non-ASCII characters; every other character but white space is a
    word of its own. Where the pieces matched don't end in a word-final one, the end mark is a token of its own: the
    vocabulary's newline, which no word holds, stands for it. A word that the vocabulary cannot spell is one token. A null text has null counts, an empty one 0. A
    very long text without blanks is one word, read to its end; its time is in proportion to its length.
    Rows with a null doc_id and repeated rows are counted row by row. Only doc_id and text are read.
    """
    spark: SparkSession = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton.build(read_vocabulary(tokenizer)))  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for b in split_batches(batches):
            null = np.array(b.column(1).is_null())
            words, tokens = count_texts(own, b.column(1))
            yield pa.record_batch([b.column(0), pa.array(words, mask=null), pa.array(tokens, mask=null)], ["doc_id", "n_words", "n_tokens"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long")


def oracle(tokenizer: str = TOKENIZER) -> str:
    """The same rows in DuckDB SQL: the longest piece at every place of every distinct word, then a walk from piece to piece."""
    return f"""
WITH RECURSIVE alphabet AS (SELECT b, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN chr(b) ELSE chr((256 + count(*) FILTER (WHERE NOT (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174)) OVER (ORDER BY b) - 1)::INT) END AS c
  FROM (SELECT unnest(range(256))::INT AS b)),
stand AS (SELECT map(list(printf('%02X', b) ORDER BY b), list(c ORDER BY b)) AS m, string_agg(c, '' ORDER BY b) AS letters FROM alphabet),
pieces AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS piece FROM read_text('{tokenizer}')),
vocabulary AS (SELECT DISTINCT CASE WHEN ends_with(piece, '</w>') THEN left(piece, length(piece) - 4) || chr(10) ELSE piece END AS whole, replace(whole, 'Ċ', chr(10)) AS v FROM pieces, stand
  WHERE piece <> '</w>' AND translate(CASE WHEN ends_with(piece, '</w>') THEN left(piece, length(piece) - 4) ELSE piece END, letters, '') = ''),
d AS (SELECT row_number() OVER () AS row, doc_id, text IS NULL AS bare, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+|[^ \\t\\n\\r\\x0B\\x0C]') AS k FROM documents),
each AS (SELECT row, unnest(k) AS w FROM d),
words AS (SELECT w, list_reduce(list_transform(range(octet_length(encode(w))), lambda i: m[substr(hex(encode(w)), 2 * i + 1, 2)]), lambda a, b: a || b) || chr(10) AS s FROM (SELECT DISTINCT w FROM each), stand),
places AS (SELECT w, p, length(s) AS n, substr(s, p, (SELECT max(length(v)) FROM vocabulary)) AS rest FROM (SELECT w, s, unnest(range(1, length(s) + 1)) AS p FROM words)),
tails AS (SELECT w, p, l, left(rest, l) AS v FROM (SELECT w, p, rest, unnest(range(1, length(rest) + 1)) AS l FROM places)),
longest AS (SELECT w, p, max(l) AS l FROM tails SEMI JOIN vocabulary USING (v) GROUP BY w, p),
walk AS (SELECT w, 1::BIGINT AS p, 0 AS n FROM words UNION ALL SELECT w, p + l, n + 1 FROM walk JOIN longest USING (w, p)),
counts AS (SELECT w, CASE WHEN max(p) = (SELECT length(s) + 1 FROM words o WHERE o.w = walk.w) THEN max(n) ELSE 1 END AS n FROM walk GROUP BY w),
sums AS (SELECT row, count(*) AS n_words, sum(n) AS n_tokens FROM each JOIN counts USING (w) GROUP BY row)
SELECT doc_id, CASE WHEN NOT bare THEN coalesce(n_words, 0) END::BIGINT AS n_words, CASE WHEN NOT bare THEN coalesce(n_tokens, 0) END::BIGINT AS n_tokens FROM d LEFT JOIN sums USING (row)"""
