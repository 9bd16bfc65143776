"""References to books, chapters and verses: plain functions for the driver, and expressions over spine keys.

A spine key is book * 1,000,000 + chapter * 1,000 + verse. Verse 0 is a chapter's title and 999 its open end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name/chapters/codes and short names, in canon order; an underscore stands for a blank.
_CANON = """
Genesis/50/gen,gn Exodus/40/exo,exod,ex Leviticus/27/lev,lv Numbers/36/num,nm Deuteronomy/34/deu,deut,dt Joshua/24/jos,josh Judges/21/jdg,judg Ruth/4/rut,ru
1_Samuel/31/1sa,1sam,1sm 2_Samuel/24/2sa,2sam,2sm 1_Kings/22/1ki,1kgs,1kgs 2_Kings/25/2ki,2kgs 1_Chronicles/29/1ch,1chr,1chron 2_Chronicles/36/2ch,2chr,2chron
Ezra/10/ezr Nehemiah/13/neh Esther/10/est,esth Job/42/jb Psalms/150/psa,ps,psalm,pss Proverbs/31/pro,prov,prv Ecclesiastes/12/ecc,eccl,qoheleth
Song_of_Songs/8/sng,song,songofsolomon,canticles,sos Isaiah/66/isa,is Jeremiah/52/jer Lamentations/5/lam Ezekiel/48/ezk,ezek,eze Daniel/12/dan,dn Hosea/14/hos Joel/3/jol
Amos/9/amo,am Obadiah/1/oba,obad Jonah/4/jon,jnh Micah/7/mic Nahum/3/nam,nah Habakkuk/3/hab Zephaniah/3/zep,zeph Haggai/2/hag Zechariah/14/zec,zech Malachi/4/mal
Matthew/28/mat,matt,mt Mark/16/mrk,mk,mar Luke/24/luk,lk John/21/jhn,jn,joh Acts/28/act Romans/16/rom,rm 1_Corinthians/16/1co,1cor 2_Corinthians/13/2co,2cor
Galatians/6/gal Ephesians/6/eph Philippians/4/php,phil Colossians/4/col 1_Thessalonians/5/1th,1thess 2_Thessalonians/3/2th,2thess 1_Timothy/6/1ti,1tim 2_Timothy/4/2ti,2tim
Titus/3/tit Philemon/1/phm,phlm Hebrews/13/heb James/5/jas,jms 1_Peter/5/1pe,1pet 2_Peter/3/2pe,2pet 1_John/5/1jn,1jhn 2_John/1/2jn,2jhn 3_John/1/3jn,3jhn Jude/1/jud Revelation/22/rev,apocalypse
"""
ORDINALS = {"1": ("first", "i"), "2": ("second", "ii"), "3": ("third", "iii")}
DASHES = str.maketrans({"–": "-", "—": "-"})


@dataclass(frozen=True)
class Book:
    num: int
    name: str
    chapters: int
    codes: tuple[str, ...]


BOOKS = tuple(Book(i, name.replace("_", " "), int(n), tuple(codes.split(","))) for i, (name, n, codes) in enumerate((entry.split("/") for entry in _CANON.split()), 1))


def alias_key(text: str) -> str:
    return re.sub(r"[\s.'’]", "", text.lower())


def _aliases() -> dict[str, Book]:
    out: dict[str, Book] = {}
    for book in BOOKS:
        number, _, rest = book.name.partition(" ")
        spelled = [f"{word} {rest}" for word in ORDINALS.get(number, ())]
        for name in (*book.codes, book.name, *spelled):
            out.setdefault(alias_key(name), book)
    return out


ALIASES = _aliases()


class ReferenceError_(ValueError):
    """A reference that can't be read; suggestions names the nearest books."""

    def __init__(self, message: str, suggestions: tuple[str, ...] = ()) -> None:
        super().__init__(message)
        self.suggestions = suggestions


@dataclass(frozen=True)
class Reference:
    book: Book
    start: int
    end: int
    kind: str


def key_of(book: int, chapter: int, verse: int) -> int:
    return (book * 1000 + chapter) * 1000 + verse


def parts_of(key: int) -> tuple[int, int, int]:
    return key // 1_000_000, key // 1000 % 1000, key % 1000


def format_key(key: int) -> str:
    book, chapter, verse = parts_of(key)
    name = BOOKS[book - 1].name if 0 < book <= len(BOOKS) else f"book{book}"
    return f"{name} {chapter}:{verse or 'title'}"


def book_named(text: str) -> Book | None:
    return ALIASES.get(alias_key(text))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggest(text: str, most: int = 3) -> tuple[str, ...]:
    """The books whose names, cut to the text's length, are nearest; canon order settles ties."""
    key = alias_key(text)
    near = sorted(BOOKS, key=lambda b: edit_distance(key, alias_key(b.name)[: max(len(key), 3)]))
    return tuple(b.name for b in near[:most])


_UNIT = "([0-9]+|end|title)"
_POINT = f"{_UNIT}(?:[.:\\s]+{_UNIT})?"
_TAIL = re.compile(rf"{_POINT}\s*(?:-\s*(?:{_POINT})?)?")
_EDGE = re.compile(r"[.:;,\s]+|(?<=[^\W\d_])(?=[0-9])")


def _number(text: str) -> int:
    return {"title": 0, "end": 999}.get(text) if text in ("title", "end") else int(text)


def parse_reference(text: str) -> Reference:
    """Read 'John 3:16-18', 'jn3.16', 'Gen 1:1-2:3', 'Psalm 23', 'psa 51:title', 'Jude 5' and the like."""
    whole = " ".join(text.split()).translate(DASHES)
    if not whole:
        raise ReferenceError_("the reference is empty")
    cuts = sorted({m.start() for m in _EDGE.finditer(whole)} | {len(whole)}, reverse=True)
    found = next(((b, whole[c:].lstrip(" .:,;").lower()) for c in cuts if (b := book_named(whole[:c]))), None)
    if not found:
        guess = re.split(r"[\d:.,;-]", whole)[0].strip() or whole
        near = suggest(guess)
        raise ReferenceError_(f"no book is called '{guess}'; the nearest are {', '.join(near)}", near)
    book, tail = found
    if not tail:
        return Reference(book, key_of(book.num, 1, 0), key_of(book.num, book.chapters, 999), "book")
    if not (m := _TAIL.fullmatch(tail)):
        raise ReferenceError_(f"can't read '{text}'; forms like 'John 3:16-18' are understood")
    one, two, three, four = m.groups()
    if two is None and book.chapters == 1:
        one, two = "1", one  # a lone number is a verse there
    chapter, verse = _number(one), None if two is None else _number(two)
    if three is None:
        last, stop = chapter, 999 if verse is None else verse
    elif four is not None:
        last, stop = _number(three), _number(four)
    else:
        last, stop = (_number(three), 999) if verse is None else (chapter, _number(three))
    for c in (chapter, last):
        if not 1 <= c <= book.chapters:
            raise ReferenceError_(f"{book.name} has {book.chapters} chapter{'s' * (book.chapters > 1)}, not {c}")
    start, end = key_of(book.num, chapter, verse or 0), key_of(book.num, last, stop)
    if end < start:
        raise ReferenceError_(f"'{text}' ends before it starts")
    return Reference(book, start, end, "range" if three else "chapter" if verse is None else "verse")


def parse_word_reference(text: str) -> tuple[int, int, int, int] | None:
    """(book, chapter, verse, word) of 'GEN 1:1!5'; None for anything else."""
    m = re.fullmatch(r"([1-9A-Z]{3}) ([0-9]+):([0-9]+)!([0-9]+)", text)
    book = book_named(m[1]) if m else None
    return (book.num, *map(int, m.groups()[1:])) if book else None


def parse_scope(text: str) -> list[tuple[int, int]]:
    """Intervals of 'ot', 'nt', 'Gen-Deu' or any reference."""
    low = text.strip().lower()
    halves = {"ot": (1, 39), "nt": (40, 66)}
    if low in halves:
        a, z = halves[low]
        return [(a * 1_000_000, z * 1_000_000 + 999_999)]
    ends = [book_named(p) for p in low.split("-")] if low.count("-") == 1 else []
    if len(ends) == 2 and all(ends) and ends[0].num <= ends[1].num:
        return [(ends[0].num * 1_000_000, ends[1].num * 1_000_000 + 999_999)]
    ref = parse_reference(text)
    return [(ref.start, ref.end)]


REFERENCE = T.StructType().add("book", T.IntegerType()).add("start", T.LongType()).add("end", T.LongType()).add("kind", T.StringType())


def reference_struct(texts: str | Column) -> Column:
    """References of a column as REFERENCE; unreadable ones give nulls. Made anew at each call: a used function object can't travel to workers."""
    return F.pandas_udf(_read_references, REFERENCE)(texts)


def _read_references(texts: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple] = {}
    for t in texts.dropna().unique():
        try:
            r = parse_reference(t)
            known[t] = (r.book.num, r.start, r.end, r.kind)
        except ReferenceError_:
            known[t] = (None,) * 4
    rows = pd.DataFrame([known.get(t, (None,) * 4) for t in texts], columns=["book", "start", "end", "kind"])
    return rows.astype({"book": "Int32", "start": "Int64", "end": "Int64"})


def key_column(book: str, chapter: str, verse: str) -> Column:
    return ((F.col(book).cast("long") * 1000 + F.col(chapter)) * 1000 + F.col(verse)).cast("long")


def book_column(key: str) -> Column:
    return F.expr(f"{key} div 1000000").cast("int")


def chapter_column(key: str) -> Column:
    return F.expr(f"({key} % 1000000) div 1000").cast("int")


def psalm_number(lxx: Column) -> Column:
    """Greek psalm numbers to Hebrew ones where a whole psalm maps: the joins and splits of 9, 114 and 147 need the verse."""
    return F.when(lxx <= 8, lxx).when(lxx.between(10, 112), lxx + 1).when(lxx.between(116, 145), lxx + 1).when(lxx >= 148, lxx)
