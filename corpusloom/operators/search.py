"""Full-text search over token text: Boolean expressions, phrases, prefixes, proximity, stems, snippets.

Queries follow the usual grammar: words side by side mean AND; OR, NOT, parentheses, "phrases", prefix*, ^first and
NEAR(a b, n) are understood. A verse's tokens are one string, each between blanks, so every test is a substring or a
regular expression on it; the whole query reads that string once, as the argument of one lambda. The search is a filter
that needs no index and no shuffle; at scale the token text is a stored column.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits, apostrophe and hyphen make a token; the curly apostrophe separates.
TOKEN = r"[\p{L}\p{N}'\-]+"
_OPERATORS = re.compile(r'["*()^]|\b(?:AND|OR|NOT|NEAR)\b')
_LEX = re.compile(r'\s*(NEAR\(|"[^"]*"\s*\*?|[()]|\^?[^\s()"]+)')


def token_array(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_text(text: str) -> Column:
    """The tokens of a text, each between blanks."""
    return F.concat(F.lit(" "), F.array_join(token_array(text), " "), F.lit(" "))


def parse_words(text: str) -> list[str]:
    """Tokens of a query word: the indexer's letters, so that both sides agree."""
    return re.findall(r"[^\W_]+(?:['\-]+[^\W_]+)*|['\-]+", text.lower())


def phrase(tokens: Column, words: list[str], prefix: bool = False, first: bool = False) -> Column:
    """Whether the words occur in a row; the last may be a prefix; `first` wants them at the start."""
    if not words:
        return F.lit(False)
    want = F.lit(" " + " ".join(words) + " " * (not prefix))
    return F.startswith(tokens, want) if first else F.contains(tokens, want)


def near(tokens: Column, a: list[str], b: list[str], gap: int = 10) -> Column:
    """Whether a and b occur with at most `gap` tokens between them, in either order."""
    x, y = (re.escape(" ".join(w)) for w in (a, b))
    return tokens.rlike(f" {x} (?:[^ ]+ ){{0,{gap}}}{y} | {y} (?:[^ ]+ ){{0,{gap}}}{x} ")


def compile_query(text: str, tokens: Column, as_phrase: bool = False) -> Column:
    """The query as a Boolean column over a column of token text. Bad syntax raises ValueError."""
    if as_phrase:
        return phrase(tokens, parse_words(text))
    if not _OPERATORS.search(text):
        return reduce(lambda a, b: a & b, [phrase(tokens, parse_words(w)) for w in text.split()] or [F.lit(False)])
    parts, pos = [], 0
    while pos < len(text.rstrip()):
        if not (m := _LEX.match(text, pos)):
            raise ValueError(f"can't read the query at {text[pos:]!r}")
        parts.append(m[1])
        pos = m.end()
    out, rest = _either(parts, tokens)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r}")
    return out


def _either(parts: list[str], tokens: Column) -> tuple[Column, list[str]]:
    left, parts = _both(parts, tokens)
    while parts and parts[0] == "OR":
        right, parts = _both(parts[1:], tokens)
        left = left | right
    return left, parts


def _both(parts: list[str], tokens: Column) -> tuple[Column, list[str]]:
    left, parts = _one(parts, tokens)
    while parts and parts[0] not in ("OR", ")"):
        negative = parts[0] == "NOT"
        right, parts = _one(parts[1:] if parts[0] in ("AND", "NOT") else parts, tokens)
        left = left & (~right if negative else right)
    return left, parts


def _one(parts: list[str], tokens: Column) -> tuple[Column, list[str]]:
    if not parts or parts[0] in ("AND", "OR", "NOT", ")"):
        raise ValueError("a word is missing")
    head, rest = parts[0], parts[1:]
    if head == "(":
        inner, rest = _either(rest, tokens)
        if rest[:1] != [")"]:
            raise ValueError("a parenthesis isn't closed")
        return inner, rest[1:]
    if head == "NEAR(":
        if ")" not in rest:
            raise ValueError("NEAR isn't closed")
        end = rest.index(")")
        inside, gap = rest[:end], 10
        if len(inside) > 1 and inside[-2].endswith(","):
            gap, inside = int(inside[-1]), [*inside[:-2], inside[-2][:-1]]
        groups = [parse_words(x) for x in inside]
        if len(groups) < 2:
            raise ValueError("NEAR wants two words")
        return reduce(lambda a, b: a & b, [near(tokens, a, b, gap) for a, b in zip(groups, groups[1:])]), rest[end + 1 :]
    return phrase(tokens, parse_words(head), prefix=head.endswith("*"), first=head.startswith("^")), rest


def search(verses: DataFrame, text: str, as_phrase: bool = False, stemmed: bool = False, column: str = "text") -> DataFrame:
    """Verses that the query matches in one column, by exact tokens or by stems."""
    if not stemmed:
        return verses.where(F.exists(F.array(token_text(column)), lambda tokens: compile_query(text, tokens, as_phrase)))
    words = [stem(w) for w in parse_words(text)]
    # stemming changes no more than the end of a word and the last letter of its stem, so few rows get to it
    likely = F.exists(F.array(token_text(column)), lambda tokens: reduce(lambda a, b: a & b, [F.contains(tokens, F.lit(" " + w[:-1])) for w in words] or [F.lit(False)]))
    rows = verses.where(likely).withColumn("stems", stem_arrays(token_array(column)))
    return rows.where(reduce(lambda a, b: a & b, [F.array_contains("stems", w) for w in words] or [F.lit(False)])).drop("stems")


def snippet(text: str, words: str, around: int | None = None, size: int = 32, prefix: bool = False) -> Column:
    """The text around the first match of a word or phrase; every match shown is marked >>so<<, and '…' stands for what is
    left out.

    The last word may be a prefix. With `around` as many tokens are shown on either side of the first match and only that
    one is marked; else `size` tokens that begin with it, or earlier if the text ends before.
    """
    wanted = parse_words(words)
    n = len(wanted)
    clean = lambda x: F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}'\-]+|[^\p{L}\p{N}'\-]+$", "")

    def starts(c: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1)))
        last = (lambda x: F.startswith(x, F.lit(wanted[-1]))) if prefix else (lambda x: x == wanted[-1])
        every = lambda i: reduce(lambda a, b: a & b, [F.get(c, i + (k - 1)) == w for k, w in enumerate(wanted[:-1])] + [last(F.get(c, i + (n - 2)))])
        return F.filter(at, lambda i: F.coalesce(every(i), F.lit(False)))

    def shown(x: Column) -> Column:
        tokens, hits = x["t"], x["hits"]
        first, end = F.get(hits, F.lit(0)), F.size(tokens)
        if around is not None:
            low, high, marked = F.greatest(first - around, F.lit(1)), F.least(first + n - 1 + around, end), F.slice(hits, 1, 1)
        else:
            low = F.greatest(F.least(first, end - size + 1), F.lit(1))
            high, marked = F.least(low + size - 1, end), hits
        opened = lambda w, i: F.when(F.array_contains(marked, i), F.concat(F.lit(">>"), w)).otherwise(w)
        closed = lambda w, i: F.when(F.array_contains(marked, i - (n - 1)), F.concat(w, F.lit("<<"))).otherwise(w)
        part = F.transform(F.slice(tokens, low, high - low + 1), lambda w, i: closed(opened(w, i + low), i + low))
        return F.concat(F.when(low > 1, F.lit("…")).otherwise(""), F.array_join(part, " "), F.when(high < end, F.lit("…")).otherwise(""))

    # tokens, their clean forms and the matches are found once each, as the argument of the next lambda
    rows = F.transform(F.array(F.split(F.trim(text), r"\s+")), lambda t: F.struct(t.alias("t"), F.transform(t, clean).alias("k")))
    found = F.transform(rows, lambda x: F.struct(x["t"].alias("t"), starts(x["k"]).alias("hits")))
    return F.get(F.transform(found, lambda x: F.when(F.size(x["hits"]) > 0, shown(x))), F.lit(0))


def snippets(rows: DataFrame, key: str, text: str, words: str, **how: int | bool | None) -> DataFrame:
    """(key, shown): the snippets of the rows that have one. Exploded, as a filter on it would be pushed down and find it twice."""
    return rows.select(key, F.explode(F.array(snippet(text, words, **how))).alias("shown")).where("shown is not null")


def _measure(w: str) -> int:
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" else "c" for i, c in enumerate(w))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(c in "aeiou" or c == "y" and i for i, c in enumerate(w))


def _short(w: str) -> bool:
    if len(w) < 3:
        return False
    k = ["v" if c in "aeiou" or c == "y" and i and w[i - 1] not in "aeiou" else "c" for i, c in enumerate(w)]
    return k[-3:] == ["c", "v", "c"] and w[-1] not in "wxy"


_STEP2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split()))
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def stem(w: str) -> str:
    """Porter's algorithm (1980), for lower-case ASCII words; others stay as they are."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" and w[-1] not in "aeiou":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stem_arrays(tokens: str | Column) -> Column:
    """Stems of token arrays; each distinct token of a batch is stemmed once."""
    return F.pandas_udf(_stem_rows, T.ArrayType(T.StringType()))(tokens)


def _stem_rows(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return tokens.map(lambda row: None if row is None else [known.setdefault(t, "") or known.update({t: stem(t)}) or known[t] for t in row])
