"""Secret scans: a trigram inverted index over each block of texts, Boolean trigram queries from the rules, verification.

Every rule's regular expression is parsed into a Boolean query over the trigrams that any match must hold. Each block of
texts is indexed under the trigrams that occur in some query; postings are intersected and united, and the expression
itself runs only on the candidates. A rule without mandatory trigrams runs on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C  # noqa: N812
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.kernels import lean, split_batches, text_bytes
from corpusloom.llm.shared import pick

#: Rule names and expressions, in the syntax that Python (with re.ASCII) and RE2 share.
RULES = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "password": r"(?i)\b(?:password|passwd|pwd)[ \t]*[=:][ \t]*[\"']?[0-9A-Za-z!#$%&*+./?@^_~-]{8,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[rs]k_live_[0-9A-Za-z]{16,}",
    "token": r"(?i)\b(?:api_?key|secret|token)[ \t]*[=:][ \t]*[\"'][0-9A-Za-z_-]{16,}[\"']",
    "url_credentials": r"\b[a-z][0-9a-z+.-]{1,20}://[0-9A-Za-z._~-]+:[0-9A-Za-z._~!$*+-]+@",
    "hex_key": r"\b[0-9a-f]{40}\b",
}
#: Sets of strings beyond this size count as unknown text.
_MOST = 64

Query = bool | int | tuple  # True, a trigram, or ("and" | "or", [queries])


def _combine(kind: str, parts: list[Query]) -> Query:
    """AND or OR of queries; True is the query that every text meets."""
    if kind == "or" and any(p is True for p in parts):
        return True
    flat = list(dict.fromkeys(x for p in parts if p is not True for x in (p[1] if isinstance(p, tuple) and p[0] == kind else (p,))))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[bytes]) -> Query:
    grams = [_combine("and", [int.from_bytes(s[i : i + 3], "big") for i in range(len(s) - 2)]) for s in sorted(strings)]
    return _combine("or", grams)


def _analyse(items) -> tuple[set[bytes] | None, Query]:
    """The strings a parsed expression stands for, if they are few, and else None with what any match must hold."""
    exact: set[bytes] = {b""}
    broken, musts = False, []

    def stop() -> None:
        nonlocal exact, broken
        musts.append(_of_strings(exact))
        exact, broken = {b""}, True

    def add(strings: set[bytes]) -> None:
        nonlocal exact
        if len(exact) * len(strings) > _MOST:
            stop()
        exact = {a + b for a in exact for b in strings}

    for op, arg in items:
        some: set[bytes] | None = None
        must: Query = True
        if op is C.LITERAL:
            some = {chr(arg).encode().lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            some = {chr(a).encode().lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            some, must = _analyse(arg[-1])
        elif op is C.BRANCH:
            each = [_analyse(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                some = set().union(*(s for s, _ in each))
            else:
                must = _combine("or", [_of_strings(s) if s is not None else m for s, m in each])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = arg
            inner, need = _analyse(body)
            if inner is not None and most == 1:
                some = inner | {b""} if least == 0 else inner
            elif least:
                must = need if inner is None else _of_strings(inner)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            some = {b""}
        if some is not None and len(some) <= _MOST:
            add(some)
        else:
            stop()
            musts.append(must if some is None else _of_strings(some))
    if not broken:
        return exact, True
    musts.append(_of_strings(exact))
    return None, _combine("and", musts)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-cased trigrams that every match of pattern meets; True if there is none."""
    strings, must = _analyse(_parser.parse(pattern, re.ASCII))
    return must if strings is None else _of_strings(strings)


def _grams(query: Query) -> set[int]:
    if isinstance(query, tuple):
        return set().union(*(_grams(q) for q in query[1]))
    return set() if query is True else {query}


class Index:
    """Postings of a block of texts, for the trigrams in `vocabulary` (sorted)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray, member: np.ndarray) -> None:
        low = data.astype(np.uint32)
        low += ((low >= 65) & (low <= 90)).astype(np.uint32) * 32
        code = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(member[code])
        gram = np.searchsorted(vocabulary, code[at])
        doc = np.searchsorted(off, at, "right") - 1
        pairs = np.unique(gram * np.int64(1 << 32) + doc)
        self.vocabulary, self.size = vocabulary, len(off) - 1
        self.doc = pairs & ((1 << 32) - 1)
        self.cut = np.searchsorted(pairs >> 32, np.arange(len(vocabulary) + 1))

    def candidates(self, query: Query) -> np.ndarray:
        """Sorted texts that meet the query."""
        if query is True:
            return np.arange(self.size)
        if not isinstance(query, tuple):
            i = int(np.searchsorted(self.vocabulary, query))
            return self.doc[self.cut[i] : self.cut[i + 1]]
        parts = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, n_matches, first_prefix, first_length) for each row of docs and each rule that matches its text.

    n_matches counts matches that don't overlap, over the whole text; the first is shown by its first four characters
    and its length only. Null and empty texts match nothing. Rows with a null doc_id and repeated rows are scanned row by
    row. Only doc_id and text are read. No rows in, no rows out.
    """
    rules = RULES if rules is None else rules
    queries = {name: trigram_query(p) for name, p in rules.items()}
    grams = sorted(set().union(*(_grams(q) for q in queries.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.array(grams, np.uint32)
        member = np.zeros(1 << 24, bool)
        member[vocabulary] = True
        compiled = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        for b in split_batches(batches):
            index = Index(*text_bytes(b.column(1), lower=False), vocabulary, member)
            rows, texts = [], {}
            for name, query in queries.items():
                for i in index.candidates(query).tolist():
                    if i not in texts:
                        texts[i] = b.column(1)[i].as_py() or ""
                    if found := [m.group() for m in compiled[name].finditer(texts[i])]:
                        rows.append((i, name, len(found), found[0][:4], len(found[0])))
            i, name, n, prefix, length = zip(*rows) if rows else ((),) * 5
            ids = b.column(0).take(pa.array(i, pa.int64()))
            yield pa.record_batch([ids, pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(prefix, pa.string()), pa.array(length, pa.int64())], ["doc_id", "rule", "n_matches", "first_prefix", "first_length"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(run), "doc_id long, rule string, n_matches long, first_prefix string, first_length long")


def oracle(rules: dict[str, str] | None = None) -> str:
    """The same rows in DuckDB SQL."""
    each = (f"SELECT doc_id, '{n}' AS rule, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}') AS m FROM documents" for n, p in (rules or RULES).items())
    return f"SELECT doc_id, rule, len(m)::BIGINT AS n_matches, left(m[1], 4) AS first_prefix, length(m[1])::BIGINT AS first_length FROM ({' UNION ALL '.join(each)}) WHERE len(m) > 0"
