"""Decomposition of morphology codes: Hebrew and Aramaic positional codes, Greek hyphenated codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("pos", "person", "gender", "number", "gcase", "tense", "voice", "mood", "stem", "state", "degree")


def _table(text: str) -> dict[str, str]:
    return dict(pair.split("=") for pair in text.split())


SEMITIC_POS = _table("V=verb N=noun A=adjective P=pronoun S=suffix D=adverb R=preposition C=conjunction T=particle")
STEMS = {
    "H": _table("q=qal Q=qal-passive N=niphal D=nithpael p=piel P=pual t=hithpael h=hiphil H=hophal c=tiphil u=hothpaal v=hishtaphel o=polel O=polal r=hithpolel m=poel M=poal k=palel K=pulal l=pilpel L=polpal f=hithpalpel j=pealal i=pilel w=nithpalel y=nithpoel z=hithpoel"),
    "A": _table("q=peal Q=peil u=hithpeel i=ithpeel p=pael P=ithpaal M=hithpaal a=aphel h=haphel b=hephal w=hithaphel G=ittaphal s=saphel e=shaphel v=ishtaphel t=hishtaphel H=hophal o=polel r=hithpolel O=ithpolel m=poel z=ithpoel l=palpel f=hithpalpel L=ithpalpel c=tiphel"),
}
CONJUGATION = _table("p=perfect i=imperfect n=imperfect q=sequential-perfect w=wayyiqtol u=weyiqtol v=imperative h=cohortative j=jussive r=participle s=participle-passive a=infinitive-absolute c=infinitive-construct")
SEMITIC = {
    "person": _table("1=1 2=2 3=3"),
    "gender": _table("m=masculine f=feminine c=common b=both"),
    "number": _table("s=singular d=dual p=plural"),
    "state": _table("a=absolute c=construct d=determined"),
}

GREEK_POS = {x: name for x, name in _table("V=verb N=noun A=adjective T=article ADV=adverb PREP=preposition CONJ=conjunction COND=conditional PRT=particle INJ=interjection HEB=hebrew-word ARAM=aramaic-word").items()} | {c: "pronoun" for c in "PRCDKIXQFS"}
FIXED = {"N-PRI": "noun", "N-LI": "noun", "N-OI": "noun", "A-NUI": "adjective"}
FINITE_PLACES = (
    ("tense", _table("P=present I=imperfect F=future A=aorist R=perfect L=pluperfect X=unstated")),
    ("voice", _table("A=active Q=active M=middle D=middle P=passive O=passive E=middle-passive N=middle-passive X=unstated")),
    ("mood", _table("I=indicative S=subjunctive O=optative M=imperative N=infinitive P=participle R=imperative-participle")),
)
NOMINAL_PLACES = (
    ("person", _table("1=1 2=2 3=3")),
    ("gcase", _table("N=nominative G=genitive D=dative A=accusative V=vocative")),
    ("number", _table("S=singular P=plural")),
    ("gender", _table("M=masculine F=feminine N=neuter")),
)
FLAGS = frozenset("P T L G PG ATT N K ABB C S I M ARAM HEB".split())


class MorphError(ValueError):
    """A code with an unknown letter where one is mandatory."""


def _must(table: dict[str, str], letter: str, what: str, code: str) -> str:
    if letter not in table:
        raise MorphError(f"{what} {letter!r} of {code!r} is unknown")
    return table[letter]


def semitic(code: str, lang: str) -> dict[str, str | None]:
    """Attributes of one Hebrew ('H') or Aramaic ('A') morpheme code without its language letter."""
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    if not code:
        return out
    kind = code[0]
    out["pos"] = _must(SEMITIC_POS, kind, "part of speech", code)
    if kind == "V":
        if code[1:2]:
            out["stem"] = _must(STEMS["A" if lang == "A" else "H"], code[1], "stem", code)
        if code[2:3]:
            out["tense"] = _must(CONJUGATION, code[2], "conjugation", code)
        order = ("gender", "number", "state") if str(out["tense"]).startswith("participle") else ("person", "gender", "number")
        tail = code[3:]
    elif kind in "NA":
        order, tail = ("gender", "number", "state"), code[2:]
    elif kind == "S":
        order, tail = ("person", "gender", "number"), code[2:]
    elif kind == "P":
        tail = code[2:]
        order = ("person", "gender", "number") if tail[:1] in SEMITIC["person"] or len(tail) > 2 else ("gender", "number")
    else:
        return out
    for name, letter in zip(order, tail):
        out[name] = SEMITIC[name].get(letter)
    return out


def _nominal(out: dict[str, str | None], text: str) -> None:
    for name, table in NOMINAL_PLACES:
        if text[:1] in table:
            out[name], text = table[text[0]], text[1:]


def greek(code: str) -> dict[str, str | None]:
    """Attributes of a Greek code such as V-2AAI-3S, N-GSM-P or ADV."""
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    first, *rest = [p for p in code.strip().split("-") if p] or [""]
    if fixed := FIXED.get("-".join([first, *rest[:1]])):
        return out | {"pos": fixed}
    out["pos"] = _must(GREEK_POS, first, "part of speech", code)
    degree = {"C": "comparative", "S": "superlative"}
    if len(first) > 1:
        return out | {"degree": degree.get(rest[0]) if rest else None}
    if first == "V":
        letters = rest[0].removeprefix("2") if rest else ""
        for (name, table), letter in zip(FINITE_PLACES, letters):
            out[name] = _must(table, letter, name, code)
        end = rest[1] if len(rest) > 1 and rest[1] not in FLAGS else ""
        if str(out["mood"]).endswith("participle"):
            _nominal(out, end)
        else:
            out["person"] = end[0] if end[:1] in set("123") else None
            out["number"] = dict(NOMINAL_PLACES)["number"].get(end[1:2])
        return out
    if rest and rest[0] not in FLAGS:
        if first == "S" and rest[0][:1] in set("123") and rest[0][1:2] in set("SP"):  # the possessor comes first
            out["person"] = rest[0][0]
            _nominal(out, rest[0][2:])
        else:
            _nominal(out, rest[0])
    if "C" in rest:
        out["degree"] = degree["C"]
    if "S" in rest and first == "A":
        out["degree"] = degree["S"]
    return out


ATTRIBUTES = T.StructType([T.StructField(f, T.StringType()) for f in (*FIELDS, "error")])


def morph_struct(codes: str | Column, langs: str | Column) -> Column:
    """Attributes of code columns by language (H, A, G); errors are reported in `error`."""
    return F.pandas_udf(_read_codes, ATTRIBUTES)(codes, langs)


def _read_codes(codes: pd.Series, langs: pd.Series) -> pd.DataFrame:
    known: dict[tuple, dict] = {}
    for pair in set(zip(codes, langs)):
        try:
            known[pair] = (greek(pair[0]) if pair[1] == "G" else semitic(pair[0], pair[1])) | {"error": None} if pair[0] is not None else {}
        except MorphError as e:
            known[pair] = {"error": str(e)}
    return pd.DataFrame([known[p] for p in zip(codes, langs)], columns=[*FIELDS, "error"]).astype(object).where(lambda d: d.notna(), None)


ROLES = frozenset("s v vc o io o2 p pp adv aux".split())


def clause_role(text: str | None) -> str | None:
    """A role code of a treebank; error notes and unknown codes are none."""
    return text if text in ROLES else None


def negator(lang: str, type_: str | None = None, code: str | None = None, class_: str | None = None) -> str | None:
    """How a treebank word negates: a 'particle' its own clause from the predicate's places, a 'nominal' from any place.

    Semitic words are marked by type; Greek ones by a code that ends in -N, names and what stands for them being nominal.
    """
    if lang != "G":
        return "particle" if type_ == "negative" else None
    if not (code or "").endswith("-N"):
        return None
    return "nominal" if class_ in ("adj", "pron", "noun", "det") else "particle"
