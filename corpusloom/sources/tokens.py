"""Token ingest: tagged Hebrew and Greek rows to the words table, the Greek psalter onto the spine, the lexicon post-pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import morph, normalise, refs

EDITIONS = {name: 1 << i for i, name in enumerate("NA27 NA28 SBL TR Byz WH Treg Tyn".split())}
#: A build with more unreadable codes than this is given up.
MOST_ERRORS = 500
_PLACE = r"(?P<{0}c>[0-9]+)[.](?P<{0}v>[0-9]+)[a-d]?"
_CELL = re.compile(r"(?P<book>[123]?[^\W\d_]+)[.]" + _PLACE.format("") + r"(?P<other>[^#]*)#(?P<num>[0-9]+)\s*=(?P<meta>.*)")
_OTHER = re.compile(r"[(\[]" + _PLACE.format("o") + r"[)\]]")
_CODE = r"(?P<code>G[0-9]+\w?)=(?P<tag>\S+)"
_VARIANT = re.compile(r"(?P<surface>[^(]+)\((?P<translit>[^()]*)\)(?P<gloss>.*?)\s*-\s*" + _CODE + r"\s+in:\s*(?P<editions>\S+)")
_SURFACE = re.compile(r"(?P<surface>.*?)\((?P<translit>[^()]*)\)")
WORD_FIELDS = ["verse_id", "word_num", "part_num", "lang", "surface", "surface_norm", "translit", "lemma", "lemma_norm", "strongs", "strongs_num", "strongs_suffix", "gloss", "morph_raw", *morph.FIELDS, "text_type", "editions", "is_default", "native_id", "error"]
_LONGS = {"verse_id", "native_id"}
_INTS = {"word_num", "part_num", "strongs_num", "editions", "is_default"}
WORDS_SCHEMA = ", ".join(f"{f} {'long' if f in _LONGS else 'int' if f in _INTS else 'string'}" for f in WORD_FIELDS)


def step_cell(cell: str) -> tuple[int, int, str, int | None] | None:
    """Spine key, word number, meta and key in the other numbering of a cell like Gen.32.1(32.2)#03=L; None if unreadable."""
    m = _CELL.fullmatch(cell.strip())
    book = m and refs.book_named(m["book"])
    if not book:
        return None
    other = _OTHER.search(m["other"])
    return refs.key_of(book.num, int(m["c"]), int(m["v"])), int(m["num"]), m["meta"].strip(), other and refs.key_of(book.num, int(other["oc"]), int(other["ov"]))


def mask_of(cell: str) -> int:
    return sum({EDITIONS.get(x.strip(), 0) for x in cell.split("+")})


def _row(**values: object) -> dict[str, object]:
    return dict.fromkeys(WORD_FIELDS) | values


def _entry(code: str) -> dict[str, object]:
    s = normalise.strongs(code)
    return {"strongs": s[0], "strongs_num": s[1], "strongs_suffix": s[2]} if s else {}


def _attributes(code: str, lang: str) -> dict[str, object]:
    try:
        return morph.greek(code) if lang == "G" else morph.semitic(code, lang)
    except morph.MorphError as e:
        return {"error": str(e)}


def _bare(text: str) -> str:
    return re.sub(r"[\\׃׀]", "", text).strip()


def hebrew_row(cells: list[str]) -> list[dict[str, object]]:
    """One word row for each morpheme; reconstructed additions (type X) stay out of the default stream, before the verse's words."""
    get = lambda i: cells[i] if i < len(cells) else ""
    if not (ref := step_cell(get(0))):
        return [_row(error=f"reference {get(0)[:30]}")]
    key, num, meta, native = ref
    lang = "A" if get(5)[:1] == "A" else "H"
    kind = re.sub(r"\(.*\)", "", meta).strip() or "L"
    added = kind.startswith("X")
    split = {n: [_bare(x) for x in get(i).split("/")] for n, i in (("surface", 1), ("gloss", 3), ("code", 4), ("full", 11))}
    tags = get(5)[1:].split("/")
    at = lambda xs, i, default="": xs[i] if i < len(xs) else default
    out = []
    for i in range(max(len(split["surface"]), len(split["code"]), len(tags))):
        surface = at(split["surface"], i, split["surface"][-1])
        code, tag = re.sub("[{}+]", "", at(split["code"], i)).strip(), at(tags, i).strip()
        if not (surface or code or tag):
            continue
        parts = re.sub("[{}]", "", at(split["full"], i)).split("=")
        lemma = parts[1].strip() or None if len(parts) > 1 else None
        out.append(_row(
            verse_id=key, word_num=num - 500 * added, part_num=i + 1, lang=lang, surface=surface, surface_norm=normalise.hebrew(surface), translit=get(2) if i == 0 else None,
            lemma=lemma, lemma_norm=lemma and normalise.hebrew(lemma), gloss=at(split["gloss"], i) or None, morph_raw=tag or None, text_type=kind, editions=0, is_default=int(not added), native_id=native,
            **_entry(code), **_attributes(tag.upper() if len(tag) == 1 else tag, lang),
        ))
    return out


def greek_row(cells: list[str]) -> list[dict[str, object]]:
    """One row for each component of a contracted word, then one for each reading of the apparatus cell."""
    get = lambda i: cells[i].strip() if i < len(cells) else ""
    ref = step_cell(get(0))
    tags = [m.groups() for part in get(3).split(" + ") if (m := re.fullmatch(_CODE, part.strip()))]
    if not ref or not tags:
        return [_row(error=f"row {get(0)[:30]} {get(3)[:20]}")]
    key, num, meta, native = ref
    m = _SURFACE.fullmatch(get(1))
    surface, translit = (m["surface"].strip(), m["translit"].strip()) if m else (get(1), None)
    lemma = get(4).split("=")[0].strip() or None if len(tags) == 1 else None  # a combined lemma belongs to no component
    base = {"verse_id": key, "word_num": num, "lang": "G", "native_id": native}
    default = int("n" in re.sub(r"\(.*?\)", "", meta).lower())
    out = [
        _row(**base, part_num=i, surface=surface, surface_norm=normalise.greek(surface), translit=translit, lemma=lemma, lemma_norm=lemma and normalise.greek(lemma), gloss=get(2) or None, morph_raw=tag, text_type=meta, editions=mask_of(get(5)), is_default=default, **_entry(code), **_attributes(tag.strip(), "G"))
        for i, (code, tag) in enumerate(tags, 1)
    ]
    nth = len(tags)
    for piece in re.split(r";(?![^(]*\))", get(6)):
        if v := _VARIANT.match(piece.strip()):
            nth += 1
            if v["surface"].strip() and mask_of(v["editions"]):
                out.append(_row(**base, part_num=nth, surface=v["surface"].strip(), surface_norm=normalise.greek(v["surface"]), translit=re.sub("^[A-Za-z]+=", "", v["translit"]).strip() or None, gloss=v["gloss"].strip() or None, morph_raw=v["tag"], text_type="variant", editions=mask_of(v["editions"]), is_default=0, **_entry(v["code"]), **_attributes(v["tag"], "G")))
    return out


def word_rows(rows: DataFrame, lang: str) -> DataFrame:
    """The words of a table of cells (see readers.tsv_rows), by Arrow batches: a row's morphemes must stay aligned."""
    parse = greek_row if lang == "G" else hebrew_row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([r for cells in pdf["cells"] for r in parse(list(cells))], columns=WORD_FIELDS)
            yield out.astype({**{f: "Int64" for f in _LONGS}, **{f: "Int32" for f in _INTS}}).astype({f: object for f in WORD_FIELDS if f not in _LONGS | _INTS})

    return rows.select("cells").mapInPandas(run, WORDS_SCHEMA)


def settle(words: DataFrame, spine: DataFrame) -> DataFrame:
    """Greek words whose verse is off the spine go to their other numbering, before or after its own words; then of several
    default rows in a slot the first stays default. spine has verse_id, one row a verse."""
    on = words.join(spine.select(F.col("verse_id").alias("spine_id")), F.col("verse_id") == F.col("spine_id"), "left")
    moved = F.col("spine_id").isNull() & F.col("native_id").isNotNull() & (F.col("lang") == "G")
    shifted = F.when(F.col("verse_id") < F.col("native_id"), F.col("word_num") - 500).otherwise((F.col("word_num") + 200 + F.col("verse_id") % 1000).cast("int"))
    placed = on.withColumn("at", F.when(moved, F.col("native_id")).otherwise(F.col("verse_id"))).withColumn("slot", F.when(moved, shifted).otherwise(F.col("word_num")))
    group = Window.partitionBy("at", "slot", "part_num", "is_default").orderBy("verse_id", "word_num", "surface")
    first = F.when(F.col("lang") != "G", F.col("is_default")).otherwise(F.when(F.row_number().over(group) == 1, F.col("is_default")).otherwise(0))
    placed = placed.withColumn("is_default", first)
    return placed.withColumn("verse_id", F.col("at")).withColumn("word_num", F.col("slot")).select(*words.columns)


def check_errors(words: DataFrame) -> None:
    """Raise if more rows than MOST_ERRORS couldn't be read."""
    if (n := words.where("error is not null").limit(MOST_ERRORS + 1).count()) > MOST_ERRORS:
        raise AssertionError(f"more than {MOST_ERRORS} unreadable rows ({n} counted)")


def masoretic_psalm(chapter: Column, verse: Column) -> Column:
    """struct(chapter, verse) in Hebrew numbering of a Greek psalm verse; null for psalm 151."""
    rules = [(chapter <= 8, chapter, verse), ((chapter == 9) & (verse <= 21), chapter, verse), (chapter == 9, F.lit(10), verse - 21), ((chapter == 113) & (verse <= 8), F.lit(114), verse), (chapter == 113, F.lit(115), verse - 8),
             (chapter == 114, F.lit(116), verse), (chapter == 115, F.lit(116), verse + 9), (chapter <= 145, chapter + 1, verse), (chapter == 146, F.lit(147), verse), (chapter == 147, F.lit(147), verse + 11), (chapter <= 150, chapter, verse)]
    out = F
    for test, c, v in rules:
        out = out.when(test, F.struct(c.cast("int").alias("chapter"), v.cast("int").alias("verse")))
    return out


def greek_on_spine(verses: DataFrame, spine: DataFrame, mapping: DataFrame) -> DataFrame:
    """(book_num, chapter, verse, spine_verse_id) of Greek verses.

    Ezra past chapter 10 is Nehemiah. A psalm whose verses outnumber the spine's counts its title, so its verses resolve
    through the Hebrew mapping (chapter, verse, spine_verse_id) first; verse numbers over three beyond the spine's are
    taken for errors of the source and ignored in that comparison. What isn't on the spine stays null.
    """
    ps = masoretic_psalm(F.col("chapter"), F.col("verse"))
    ezra = (F.col("book_num") == 15) & (F.col("chapter") > 10)
    to = F.when(F.col("book_num") == 19, ps).otherwise(F.struct(F.when(ezra, F.col("chapter") - 10).otherwise(F.col("chapter")).cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse")))
    v = verses.withColumn("b", F.when(ezra, 16).otherwise(F.col("book_num"))).withColumn("to", to)
    ends = spine.where("book_num = 19").groupBy("chapter").agg(F.max("verse").alias("most")).select(F.col("chapter").alias("psalm"), "most")
    own = verses.where("book_num = 19").withColumn("psalm", masoretic_psalm(F.col("chapter"), F.lit(1))["chapter"]).join(ends, "psalm")
    titled = own.where(F.col("verse") <= F.col("most") + 3).groupBy("chapter").agg((F.max("verse") > F.max("most")).alias("titled")).select(F.col("chapter").alias("lc"), "titled")
    v = v.join(titled, (F.col("book_num") == 19) & (F.col("chapter") == F.col("lc")), "left").drop("lc")
    m = mapping.select(F.col("chapter").alias("mc"), F.col("verse").alias("mv"), F.col("spine_verse_id").alias("mapped"))
    v = v.join(m, (F.col("book_num") == 19) & F.col("titled") & (F.col("to.chapter") == F.col("mc")) & (F.col("to.verse") == F.col("mv")), "left")
    direct = (F.col("b").cast("long") * 1000 + F.col("to.chapter")) * 1000 + F.col("to.verse")
    v = v.withColumn("direct", direct).join(spine.select(F.col("verse_id").alias("on_spine")), F.col("direct") == F.col("on_spine"), "left")
    return v.select("book_num", "chapter", "verse", F.coalesce("mapped", "on_spine").alias("spine_verse_id"))


def _majority(words: DataFrame, key: str, value: str) -> DataFrame:
    n = words.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return n.withColumn("k", k).where("k = 1").select(key, value)


def tallies(words: DataFrame) -> DataFrame:
    """(strongs, strongs_num, lang, n, lemma, gloss, pos, translit): occurrences and majority values of each key."""
    plain = F.lower(F.regexp_replace("translit", "[.·'’/-]", ""))
    w = words.where("strongs is not null").withColumn("translit", F.when(F.col("surface_norm") == F.col("lemma_norm"), plain))
    out = w.groupBy("strongs").agg(F.min("strongs_num").alias("strongs_num"), F.substring(F.min("strongs"), 1, 1).alias("lang"), F.count("*").alias("n"))
    for value in ("lemma", "gloss", "pos", "translit"):
        out = out.join(_majority(w, "strongs", value), "strongs", "left")
    return out


def lexicon_post_pass(words: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with affix entries (numbers from 9000), entries for used keys that nothing resolves, and transliterations.

    A key resolves exactly or by language and number. Hebrew entries without a transliteration take the majority one of
    their key, else that of all keys of their number.
    """
    t = tallies(words)
    have = entries.select("strongs").distinct()
    loose = entries.select(F.substring("strongs", 1, 1).alias("lang"), "strongs_num").distinct()
    affixes = t.where("strongs_num >= 9000").join(have, "strongs", "left_anti").withColumn("lexicon_id", F.lit("affixes"))
    missing = t.where("strongs_num < 9000").join(have, "strongs", "left_anti").join(loose, ["lang", "strongs_num"], "left_anti").withColumn("lexicon_id", F.lit("tagged"))
    new = affixes.unionByName(missing).select("lexicon_id", "strongs", "strongs_num", "lemma", F.when(F.col("lexicon_id") == "tagged", F.col("translit")).alias("translit"), "pos", F.coalesce("gloss", F.lit("-")).alias("short_gloss"), F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times in the tagged text")).alias("definition"))
    plain = F.lower(F.regexp_replace("translit", "[.·'’/-]", ""))
    hebrew = words.where("strongs like 'H%' and surface_norm = lemma_norm").select("strongs_num", plain.alias("of_number"))
    by_number = _majority(hebrew, "strongs_num", "of_number")
    filled = entries.join(t.select("strongs", F.col("translit").alias("of_key"), F.lit(1).alias("used")), "strongs", "left").join(by_number, "strongs_num", "left")
    value = F.when(F.col("translit").isNull() & F.col("strongs").startswith("H"), F.when(F.col("used") == 1, F.col("of_key")).otherwise(F.col("of_number"))).otherwise(F.col("translit"))
    return filled.withColumn("translit", value).select(*entries.columns).unionByName(new.select(*entries.columns))


def crasis_lemmas(words: DataFrame, entries: DataFrame) -> DataFrame:
    """Greek words without a lemma take the first one of their entry, exact before by number."""
    e = entries.where("strongs like 'G%' and lemma is not null").withColumn("first", F.trim(F.get(F.split("lemma", ","), F.lit(0))))
    exact = e.groupBy("strongs").agg(F.min("first").alias("exact"))
    number = e.groupBy("strongs_num").agg(F.min("first").alias("number"))
    w = words.join(exact, "strongs", "left").join(number, "strongs_num", "left")
    need = (F.col("lang") == "G") & F.col("lemma").isNull()
    w = w.withColumn("found", F.when(need, F.coalesce("exact", "number")))
    w = w.withColumn("lemma_norm", F.coalesce("lemma_norm", normalise.normalised("found", F.lit("G")))).withColumn("lemma", F.coalesce("lemma", "found"))
    return w.select(*words.columns)
