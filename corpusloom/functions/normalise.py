"""Search forms of Hebrew and Greek words, and codes of dictionary entries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINTS = re.compile("[֑-ֽֿ-ׇ]")
_NOT_HEBREW = re.compile("[^א-תװ-ײ ]")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def hebrew(text: str) -> str:
    """Consonants only; the hyphen-like maqaf separates words."""
    bare = _POINTS.sub("", unicodedata.normalize("NFC", text)).replace("־", " ")
    return squeeze(_NOT_HEBREW.sub("", bare))


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def greek(text: str) -> str:
    """Letters and blanks, without accents, in lower case, every sigma alike."""
    letters = "".join(c for c in unaccented(text) if c == " " or unicodedata.category(c)[0] == "L")
    return squeeze(unicodedata.normalize("NFC", letters.lower().replace("ς", "σ")))


def query_lemma(text: str) -> str:
    """The query side: by script, but keeping what isn't a letter in Greek."""
    if re.search("[֐-׿]", text):
        return hebrew(text)
    return squeeze(unicodedata.normalize("NFC", unaccented(text).lower().replace("ς", "σ")))


def loose_translit(text: str) -> str:
    return re.sub("[^a-z]", "", unaccented(text).lower())


def strongs(text: str) -> tuple[str, int, str | None] | None:
    """('H0430', 430, None) of H430, h0430 or G2316a; None for anything else."""
    code = text.strip()
    letter, digits = code[:1].upper(), code[1:].rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    suffix = code[1 + len(digits) :]
    if letter not in ("H", "G") or not (digits.isascii() and digits.isdecimal()) or len(digits) > 4 or len(suffix) > 1:
        return None
    return f"{letter}{int(digits):04d}{suffix}", int(digits), suffix or None


def treebank_strongs(text: str | None, lang: str) -> tuple[str, int, bool] | None:
    """('H1886a', 1886, True) of '1886a|0725': the first of several numbers, and whether there were several."""
    first = re.split(r"[|+]", text or "")[0].strip()
    code = strongs(f"{lang}{first}") if first else None
    return code and (code[0], code[1], text != first)


def strongs_number(col: str) -> Column:
    return F.nullif(F.regexp_extract(col, "^[HG]([0-9]{1,4})[A-Za-z]?$", 1), F.lit("")).cast("int")


def normalised(texts: str | Column, langs: str | Column) -> Column:
    """Search form by language: H and A as Hebrew, G as Greek, others without accents in lower case."""
    return F.pandas_udf(_normalise, T.StringType())(texts, langs)


def _normalise(texts: pd.Series, langs: pd.Series) -> pd.Series:
    def one(t: str | None, lang: str | None) -> str | None:
        return None if t is None else hebrew(t) if lang in ("H", "A") else greek(t) if lang == "G" else squeeze(unaccented(t).lower())

    return pd.Series([one(t, x) for t, x in zip(texts, langs)], dtype=object)
