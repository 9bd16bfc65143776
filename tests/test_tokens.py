"""Token ingest on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tokens


def test_step_cells():
    assert tokens.step_cell("Psa.51.0(51.1)#02=L") == (19051000, 2, "L", 19051001)
    assert tokens.step_cell("Rev.12.18[13.1]#04=NKO") == (66012018, 4, "NKO", 66013001) and tokens.step_cell("Gen.1.1a#01=L") == (1001001, 1, "L", None)
    assert tokens.step_cell("prose") is None and tokens.mask_of("NA27+TR+Byz+?") == 1 + 8 + 16


def test_hebrew_rows():
    cells = ["Gen.1.1#01=L", "בְּ/רֵאשִׁ֖ית", "be./re.Shit", "in/ beginning", "H9003/{H7225G}", "HR/Ncfsa", "", "", "", "", "", "H9003=ב=in/{H7225G=רֵאשִׁית=beginning}"]
    a, b = tokens.hebrew_row(cells)
    assert (a["strongs_num"], a["part_num"], a["pos"], a["translit"]) == (9003, 1, "preposition", "be./re.Shit") and (b["strongs"], b["strongs_suffix"], b["gender"], b["lemma_norm"], b["is_default"]) == ("H7225G", "G", "feminine", "ראשית", 1)
    added = tokens.hebrew_row(["Gen.4.8#0501=X", "נלכה", "", "", "H3212", "HVqh1cp"])[0]
    assert (added["word_num"], added["is_default"], added["text_type"]) == (1, 0, "X")
    assert tokens.hebrew_row(["bad"])[0]["error"] and tokens.hebrew_row(["Gen.1.1#01=L", "x", "", "", "H1", "HZx"])[0]["error"]


def test_greek_rows():
    cells = ["Mat.1.1#01=NKO", "κἀκεῖ (kakei)", "and there", "G2532=CONJ + G1563=ADV", "κἀκεῖ=and there", "NA28+TR", "λόγος (T=logos) word - G3056=N-NSM in: Tyn+TR; junk"]
    one, two, variant = tokens.greek_row(cells)
    assert (one["strongs"], two["strongs"], one["lemma"], two["part_num"], one["editions"]) == ("G2532", "G1563", None, 2, 10)
    assert (variant["text_type"], variant["editions"], variant["translit"], variant["part_num"], variant["gcase"], variant["is_default"]) == ("variant", 136, "logos", 3, "nominative", 0)


def test_settle_moves_and_demotes(spark):
    rows = [["Rev.12.18[13.1]#01=NKO", "a (a)", "", "G1=CONJ", "", "NA28"], ["Rev.13.1#01=NKO", "b (b)", "", "G2=CONJ", "", "NA28"], ["Rev.13.1#01=N", "c (c)", "", "G3=CONJ", "", "NA28"]]
    words = tokens.word_rows(spark.createDataFrame([(r,) for r in rows], "cells array<string>"), "G")
    out = {r.surface: (r.verse_id, r.word_num, r.is_default) for r in tokens.settle(words, spark.createDataFrame([(66013001,)], "verse_id long")).collect()}
    assert out == {"a": (66013001, -499, 1), "b": (66013001, 1, 1), "c": (66013001, 1, 0)}
    tokens.check_errors(words)
    with pytest.raises(AssertionError, match="unreadable"):
        tokens.check_errors(spark.range(600).withColumn("error", F.lit("x")))


def test_greek_psalms(spark):
    spine = spark.createDataFrame([(19000000 + c * 1000 + v, 19, c, v) for c in (3, 10, 51) for v in range(1, 9)] + [(16001001, 16, 1, 1)], "verse_id long, book_num int, chapter int, verse int")
    mapping = spark.createDataFrame([(51, v, 19051000 + v - 1) for v in range(1, 10)], "chapter int, verse int, spine_verse_id long")
    verses = spark.createDataFrame([(19, 50, v) for v in (1, 2, 9, 40)] + [(19, 3, 4), (19, 9, 22), (19, 151, 1), (15, 11, 1)], "book_num int, chapter int, verse int")
    got = {(r.chapter, r.verse): r.spine_verse_id for r in tokens.greek_on_spine(verses, spine, mapping).collect()}
    assert got == {(50, 1): 19051000, (50, 2): 19051001, (50, 9): 19051008, (50, 40): None, (3, 4): 19003004, (9, 22): 19010001, (151, 1): None, (11, 1): 16001001}


def test_lexicon_post_pass(spark):
    word = "strongs string, strongs_num int, lang string, surface_norm string, lemma_norm string, lemma string, gloss string, pos string, translit string"
    rows = [("H1", 1, "H", "x", "x", "X", "father", "noun", "'av"), ("H1", 1, "H", "x", "x", "X", "father", "noun", "'av"), ("H1", 1, "H", "x", "y", "X", "dad", "noun", "no"), ("H9003", 9003, "H", "b", "b", "B", "in", "prep", None), ("H77", 77, "H", "q", "q", "Q", None, "noun", "qu"), ("G5", 5, "G", "g", None, None, "and", "conj", None)]
    words = spark.createDataFrame(rows, word)
    entry = "lexicon_id string, strongs string, strongs_num int, lemma string, translit string, pos string, short_gloss string, definition string"
    entries = spark.createDataFrame([("bdb", "H1", 1, "X", None, "n", "father", "d"), ("bdb", "H1A", 1, "X", None, "n", "f", "d"), ("t", "G5", 5, "kai, kago", None, "c", "and", "d")], entry)
    got = {r.strongs: r for r in tokens.lexicon_post_pass(words, entries).collect()}
    assert set(got) == {"H1", "H1A", "G5", "H9003", "H77"} and got["H1"].translit == "av" and got["H1A"].translit == "av"
    assert (got["H9003"].lexicon_id, got["H9003"].short_gloss, got["H77"].lexicon_id, got["H77"].translit, got["H77"].short_gloss) == ("affixes", "in", "tagged", "qu", "-")
    assert [r.lemma for r in tokens.crasis_lemmas(words, entries).where("lang = 'G'").collect()] == ["kai"]
