"""Pure functions: references, codes, search forms, markup, stems, queries."""

import pytest

from corpusloom.functions import markup, morph, normalise, refs
from corpusloom.operators import search


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [("john 3:16", 43003016, 43003016), ("jn 3 16", 43003016, 43003016), ("JHN 3:16", 43003016, 43003016), ("jn3.16", 43003016, 43003016), ("John 3:16—18", 43003016, 43003018), ("Gen 1:1-2:3", 1001001, 1002003),
     ("Genesis 1-3", 1001000, 1003999), ("Psalm 23", 19023000, 19023999), ("psa 51:title", 19051000, 19051000), ("1jn2:5", 62002005, 62002005), ("I John 2:5", 62002005, 62002005), ("First John 2:5", 62002005, 62002005),
     ("Obadiah 15", 31001015, 31001015), ("Philemon 6", 57001006, 57001006), ("song 2:1", 22002001, 22002001), ("Canticles 2:1", 22002001, 22002001), ("2 Sam 7:12-16", 10007012, 10007016), ("Rev 22:21", 66022021, 66022021),
     ("Romans", 45001000, 45016999), ("John 3:16-end", 43003016, 43003999), ("Jude 1:5-7", 65001005, 65001007)],
)
def test_references(text, start, end):
    r = refs.parse_reference(text)
    assert (r.start, r.end) == (start, end)


@pytest.mark.parametrize("text", ["", "John 99", "John 3:18-16", "John 3:16:18:20", "Gen 0:1"])
def test_bad_references(text):
    with pytest.raises(refs.ReferenceError_):
        refs.parse_reference(text)


def test_suggestions_scopes_and_keys():
    with pytest.raises(refs.ReferenceError_) as e:
        refs.parse_reference("Pslams 23")
    assert "Psalms" in e.value.suggestions
    assert refs.parse_scope("OT") == [(1000000, 39999999)] and refs.parse_scope("Gen-Deu") == [(1000000, 5999999)] and refs.parse_scope("Isaiah") == [(23001000, 23066999)]
    assert refs.format_key(19051000) == "Psalms 51:title" and refs.format_key(43003016) == "John 3:16" and refs.parts_of(refs.key_of(2, 3, 4)) == (2, 3, 4)
    assert len(refs.BOOKS) == 66 and sum(b.chapters for b in refs.BOOKS) == 1189


def attributes(d):
    return {k: v for k, v in d.items() if v}


def test_semitic_codes():
    assert attributes(morph.semitic("Vqp3ms", "H")) == {"pos": "verb", "stem": "qal", "tense": "perfect", "person": "3", "gender": "masculine", "number": "singular"}
    assert morph.semitic("Vqu3mp", "H")["tense"] == "weyiqtol" and morph.semitic("VNrmsa", "H")["state"] == "absolute"
    assert (morph.semitic("Vhp3ms", "A")["stem"], morph.semitic("Vhp3ms", "H")["stem"], morph.semitic("Vqp3ms", "A")["stem"]) == ("haphel", "hiphil", "peal")
    assert attributes(morph.semitic("Ncmsc", "H")) == {"pos": "noun", "gender": "masculine", "number": "singular", "state": "construct"} and morph.semitic("Sp2ms", "H")["person"] == "2"
    assert morph.semitic("", "H")["pos"] is None
    for bad in ("Zxx", "V?", "Vq?"):
        with pytest.raises(morph.MorphError):
            morph.semitic(bad, "H")


def test_greek_codes():
    assert attributes(morph.greek("V-PAI-3S")) == {"pos": "verb", "tense": "present", "voice": "active", "mood": "indicative", "person": "3", "number": "singular"}
    assert morph.greek("V-2AAI-3S")["tense"] == "aorist" and attributes(morph.greek("V-PAP-NSM"))["gcase"] == "nominative" and morph.greek("V-APM-2S")["person"] == "2"
    assert morph.greek("N-GSM-P")["gender"] == "masculine" and morph.greek("P-1GS")["person"] == "1" and morph.greek("S-1SGSM")["gcase"] == "genitive" and morph.greek("A-NSM-S")["degree"] == "superlative"
    assert [morph.greek(c)["pos"] for c in ("ADV", "CONJ", "PREP", "N-PRI", "T-NPM")] == ["adverb", "conjunction", "preposition", "noun", "article"]
    with pytest.raises(morph.MorphError):
        morph.greek("ZZZ-9")


def test_search_forms():
    assert normalise.hebrew("בְּרֵאשִׁ֖ית") == "בראשית" and normalise.hebrew("כָל־הָאָרֶץ") == "כל הארץ"
    assert normalise.greek("Λόγος,") == "λογοσ" and normalise.loose_translit("chésed!") == "chesed"
    assert normalise.strongs("g976") == ("G0976", 976, None) and normalise.strongs("H1234a") == ("H1234a", 1234, "a") and normalise.strongs("X1") is None


def test_usfm():
    assert markup.clean_usfm(r'\w In the|strong="H1"\w* beginning\f + \ft note\f* \nd God\nd*  made') == "In the beginning God made"
    book, verses = markup.parse_usfm("﻿\\id GEN x\n\\c 1\n\\s head\n\\d A song\n\\p\n\\v 1 one\n\\q two\n\\v 2-3 three \\v 4 four\n\\c 2\n\\v 1 five")
    assert book == "GEN" and [(v.chapter, v.verse, v.end_verse, v.text) for v in verses] == [(1, 0, None, "A song"), (1, 1, None, "one two"), (1, 2, 3, "three"), (1, 4, None, "four"), (2, 1, None, "five")]


def test_usfm_parts_and_punctuation():
    _, verses = markup.parse_usfm("\\id GEN\n\\c 1\n\\v 3a In the beginning , yes\n\\v 4 a start (or so )\n\\v 5-6b end\n\\v 7 amen ; .")
    assert [(v.verse, v.end_verse, v.text) for v in verses] == [(3, None, "In the beginning, yes"), (4, None, "a start (or so)"), (5, 6, "end"), (7, None, "amen;.")]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("rate", "rate"), ("été", "été")])
def test_porter(word, stem):
    assert search.stem(word) == stem


def test_query_grammar(spark):
    texts = {1: "the quick brown fox", 2: "quick foxes the brown", 3: "Baal-zebub's fox", 4: "brown the"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    found = lambda q, **k: {r.id for r in search.search(df, q, **k).collect()}
    assert found("quick brown") == {1, 2} and found('"quick brown"') == {1} and found("quick brown", as_phrase=True) == {1}
    assert found("fox*") == {1, 2, 3} and found("fox NOT quick") == {3} and found("(fox OR foxes) AND the") == {1, 2} and found("^brown") == {4}
    assert found("NEAR(quick fox, 1)") == {1} and found("NEAR(the brown, 0)") == {2, 4} and found("baal-zebub's") == {3} and found("foxes", stemmed=True) == {1, 2, 3}
    for bad in ("AND", "(a OR b", "a OR"):
        with pytest.raises(ValueError, match="missing|closed"):
            found(bad)


def test_treebank_codes():
    assert refs.parse_word_reference("GEN 1:1!5") == (1, 1, 1, 5) and refs.parse_word_reference("2CH 36:23!10") == (14, 36, 23, 10) and refs.parse_word_reference("1SA 17:4!1")[0] == 9
    assert all(refs.parse_word_reference(t) is None for t in ("GEN 1:1", "XYZ 1:1!1", ""))
    assert normalise.treebank_strongs("430", "H") == ("H0430", 430, False) and normalise.treebank_strongs("0871a", "H") == ("H0871a", 871, False)
    assert normalise.treebank_strongs("1886a|0725", "H") == ("H1886a", 1886, True) and normalise.treebank_strongs("1537+4053", "G") == ("G1537", 1537, True)
    assert normalise.treebank_strongs(None, "H") is None and normalise.treebank_strongs("abc", "G") is None
    assert morph.clause_role("io") == "io" and morph.clause_role("err__x") is None and morph.clause_role(None) is None
    assert morph.negator("H", "negative", "Tn") == "particle" and morph.negator("H", "affirmation") is None
    assert [morph.negator("G", None, c, k) for c, k in (("PRT-N", "adv"), ("CONJ-N", "conj"), ("A-NSM-N", "adj"), ("N-NSM", "noun"), ("V-PAI-3S", "verb"), (None, None))] == ["particle", "particle", "nominal", None, None, None]
