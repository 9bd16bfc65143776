"""Ordered formulas over word slots, with slack, and their observed-versus-expected concentration."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.normalise import query_lemma, strongs

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Item:
    """One place of a formula: a dictionary number with its language and maybe a suffix, or a lemma."""

    raw: str
    lang: str | None = None
    number: int | None = None
    suffix: str | None = None
    lemma: str | None = None

    def test(self, slot: Column) -> Column:
        """Whether some part (lang, number, suffix, lemma, form) of a slot is meant; H also means Aramaic."""
        if self.number is None:
            return F.exists(slot, lambda p: (p["form"] == self.lemma) | (p["lemma"] == self.raw))
        langs = ("H", "A") if self.lang == "H" else ("G",)
        return F.exists(slot, lambda p: (p["number"] == self.number) & p["lang"].isin(*langs) & (p["suffix"] == self.suffix if self.suffix else F.lit(True)))


def parse_formula(text: str) -> list[Item]:
    """Dictionary numbers (H430, g26, H2617a) and original-script lemmas, two at least. English words raise ValueError."""
    words = text.split()
    if len(words) < 2:
        raise ValueError("a formula has at least two items")
    out = []
    for word in words:
        if code := strongs(word):
            out.append(Item(word, code[0][0], code[1], code[2]))
        elif re.fullmatch(r"[A-Za-z'’-]+", word):
            raise ValueError(f"{word!r} is English; a formula has dictionary numbers and original-script lemmas")
        else:
            out.append(Item(word, lemma=query_lemma(word)))
    return out


def slots_of(words: DataFrame) -> DataFrame:
    """(verse_id, slots): the parts of each word in order, as arrays of (lang, number, suffix, lemma, form, surface)."""
    part = F.struct("part_num", "lang", F.col("strongs_num").alias("number"), F.col("strongs_suffix").alias("suffix"), "lemma", F.col("lemma_norm").alias("form"), "surface")
    slots = words.groupBy("verse_id", "word_num").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    listed = F.array_sort(F.collect_list(F.struct("word_num", "parts")))
    return slots.groupBy("verse_id").agg(F.transform(listed, lambda s: s["parts"]).alias("slots"))


def word_is(lemma: str) -> Test:
    """The test of plain slots, each one lemma."""
    return lambda slot: slot == lemma


def _before(slots: Column, test: Test, ends: Column, slack: int) -> Column:
    """The ends of a formula whose first item is `test`, from those of the rest."""

    def at(rest: Column) -> Column:
        return F.transform(slots, lambda x, i: F.when(test(x), F.get(F.array_compact(F.slice(rest, i + 2, slack + 1)), F.lit(0))))

    # the rest is the argument of one lambda, so that it is found once and not for each slot
    return F.get(F.transform(F.array(ends), at), F.lit(0))


def _reach(slots: Column, tests: list[Test], slack: int) -> Column:
    """For each slot the last slot (from 0) of the earliest completion of the formula that begins there, or null."""
    ends = F.transform(slots, lambda x, i: F.when(tests[-1](x), i))
    for test in reversed(tests[:-1]):
        ends = _before(slots, test, ends, slack)
    return ends


def pattern_starts(lines: DataFrame, tests: list[Test], slack: int = 0) -> DataFrame:
    """Each row of lines, but its slots, with (start, end): slots, from 1, of every place where the items follow in order,
    at most `slack` slots between neighbours.

    lines has slots, an array in order. A start counts once however many completions it has; end is that of the one whose
    items come earliest. All happens inside the row of a verse.
    """
    found = F.transform(_reach(F.col("slots"), tests, slack), lambda e, i: F.when(e.isNotNull(), F.struct((i + 1).cast("long").alias("start"), (e + 1).cast("long").alias("end"))))
    keep = [c for c in lines.columns if c != "slots"]
    return lines.select(*keep, F.explode(F.array_compact(found)).alias("m")).select(*keep, "m.start", "m.end")


def matched_text(slots: str, start: str, end: str) -> Column:
    """The words from start to end: all parts of a slot joined, of Greek only the first."""
    shown = F.transform(F.slice(slots, F.col(start).cast("int"), (F.col(end) - F.col(start) + 1).cast("int")), lambda s: F.when(F.get(s, F.lit(0))["lang"] == "G", F.get(s, F.lit(0))["surface"]).otherwise(F.array_join(F.transform(s, lambda p: p["surface"]), "")))
    return F.array_join(shown, " ")


def concentration(starts: DataFrame, slots: DataFrame) -> DataFrame:
    """Per book: observed starts, those expected from its share of slots, and their ratio, rounded half up to one decimal.

    starts has book_num, slots has (book_num, slots).
    """
    seen = starts.groupBy("book_num").agg(F.count("*").alias("observed"))
    sized = slots.groupBy("book_num").agg(F.sum("slots").alias("slots"))
    both = sized.join(seen, "book_num", "left").agg(F.collect_list(F.struct("book_num", "slots", "observed")).alias("rows"), F.sum("slots").alias("all_slots"), F.sum("observed").alias("total"))  # a row for each book
    out = both.select(F.explode("rows").alias("r"), "all_slots", "total").where("r.observed is not null").select("r.*", "all_slots", "total")
    expected = F.col("total") * F.col("slots") / F.col("all_slots")
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    return out.select("book_num", "observed", tenth(expected).alias("expected"), F.when(expected > 0, tenth(F.col("observed") / expected)).alias("ratio"))
