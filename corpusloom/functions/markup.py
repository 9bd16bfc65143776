"""Markup to plain text: HTML as column expressions, USFM as a line scanner."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_to_text(col: str) -> Column:
    """Line ends for breaks and block ends, no tags, four entities decoded, blanks and line ends squeezed."""
    out = F.regexp_replace(F.regexp_replace(F.col(col), "(?i)<br */?>|</p>|</div>|</li>", "\n"), "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.trim(out, F.lit(" \n"))


_NOTES = re.compile(r"\\(f|fe|x|ef|ex)\b.*?\\\1\*", re.S)
_WORD_TAG = re.compile(r"[\\][+]?w\b ?(?P<word>[^\\|]*)(?:[|][^\\]*)?[\\][+]?w[*]")
_PAIRED = re.compile(r"\\\+?[a-z]+\d*\*")
_OPENING = re.compile(r"\\\+?[a-z]+\d*\s?")
_SKIPPED = ("id", "ide", "h", "toc1", "toc2", "toc3", "mt", "mt1", "mt2", "mt3", "s", "s1", "s2", "s3", "r", "ms", "ms1", "mr", "rem", "sts", "usfm", "cl", "cp", "sr", "sp")


def clean_usfm(text: str) -> str:
    """Plain text of a USFM fragment: no notes, words without their attributes, markers gone, white space squeezed and none before punctuation."""
    text = _NOTES.sub("", text)
    while (shorter := _WORD_TAG.sub(r"\g<word>", text)) != text:
        text = shorter
    text = _OPENING.sub("", _PAIRED.sub("", text))
    return re.sub(r" +([,.;:!?’”)\]])", r"\1", " ".join(text.replace("~", " ").split()))


@dataclass
class UsfmVerse:
    chapter: int
    verse: int
    end_verse: int | None
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return clean_usfm(" ".join(self.parts))


def parse_usfm(content: str) -> tuple[str | None, list[UsfmVerse]]:
    """Book id and verses: \\c sets the chapter, \\v n or n-m, with a part letter or not, opens a verse, \\d is the title and becomes verse 0.

    Heading lines are left out; other lines go on with the verse before them. Verses without text are dropped.
    """
    book, chapter, current, out = None, 0, None, []
    for raw in content.lstrip("\ufeff").splitlines():
        line = raw.strip()
        marker, _, rest = line.partition(" ")
        name = marker[1:] if marker.startswith("\\") else ""
        if name == "id":
            book = rest.split()[0].upper() if rest.split() else None
        elif name == "c":
            chapter, current = int(re.match(r"\d+", rest)[0]), None
        elif name == "d":
            current = UsfmVerse(chapter, 0, None, [rest])
            out.append(current)
        elif name in _SKIPPED:
            if name.startswith(("s", "ms", "r")):
                continue
            current = None
        else:
            pieces = re.split(r"[\\]v +([0-9]+)(?:-([0-9]+))?(?:[ab]\b)? ?", line)
            if pieces[0].strip() and current:
                current.parts.append(pieces[0])
            for number, end, text in zip(pieces[1::3], pieces[2::3], pieces[3::3]):
                current = UsfmVerse(chapter, int(number), int(end) if end else None, [text])
                out.append(current)
    return book, [v for v in out if v.text]
