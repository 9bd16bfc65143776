"""Operators on hand-made tables, and the readers on small files."""

import collections
import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.operators import lexical, positional, retrieval, reuse, session, structure
from corpusloom.session import read_only_sql, truncated
from corpusloom.sources import artifacts, readers

SF = "/root/testdata/sf0.001"


def test_pattern_cases(spark):
    lines = lambda ws: spark.createDataFrame([(1, ws.split())], "verse_id long, slots array<string>")
    found = lambda ws, items, slack: sorted((r.start, r.end) for r in positional.pattern_starts(lines(ws), [positional.word_is(i) for i in items], slack).collect())
    assert found("a b a x b", ["a", "b"], 0) == [(1, 2)] and found("a x b", ["a", "b"], 1) == [(1, 3)] and found("a x b", ["a", "b"], 0) == []
    assert found("a b b x c", ["a", "b", "c"], 1) == [(1, 5)] and found("b a", ["a", "b"], 5) == [] and found("a a a", ["a", "a"], 1) == [(1, 2), (2, 3)]


def test_formulas(spark):
    one = positional.parse_formula("h2142 G0026 H2617a ἀγάπης בְּרִית")
    assert [(i.lang, i.number, i.suffix) for i in one[:3]] == [("H", 2142, None), ("G", 26, None), ("H", 2617, "a")] and [i.lemma for i in one[3:]] == ["αγαπησ", "ברית"]
    for bad in ("remember covenant", "H2142", ""):
        with pytest.raises(ValueError, match="English|two"):
            positional.parse_formula(bad)
    kind = "verse_id long, word_num int, part_num int, lang string, strongs_num int, strongs_suffix string, lemma string, lemma_norm string, surface string"
    words = spark.createDataFrame([(1, 1, 1, "H", 9, None, "w", "w", "u"), (1, 1, 2, "A", 2617, "a", "x", "x", "x"), (1, 2, 1, "H", 1, None, "y", "y", "y"), (1, 3, 1, "G", 26, None, "ἀγάπης", "αγαπησ", "A"), (1, 3, 2, "G", 26, None, "z", "z", "B")], kind)
    rows = positional.slots_of(words).withColumn("all_", F.col("slots"))
    for formula in ("H2617a ἀγάπης", "H2617 G26"):
        got = positional.pattern_starts(rows, [i.test for i in positional.parse_formula(formula)], 1)
        assert [(r.start, r.end, r.text) for r in got.withColumn("text", positional.matched_text("all_", "start", "end")).collect()] == [(1, 3, "ux y A")]
    assert positional.pattern_starts(rows, [i.test for i in positional.parse_formula("H2617b G26")], 1).count() == 0


def test_concentration_golden(spark):
    slots = spark.createDataFrame([(1, 100), (19, 300), (23, 600)], "book_num int, slots int")
    starts = spark.createDataFrame([(1,)] * 8 + [(19,)] * 2, "book_num int")
    assert {(r.book_num, r.observed, r.expected, r.ratio) for r in positional.concentration(starts, slots).collect()} == {(1, 8, 1.0, 8.0), (19, 2, 3.0, 0.7)}


def test_chunks_pack_greedily(spark):
    rows = [("g", i, 5000) for i in range(1, 5)] + [("x", 1, 50_000), ("x", 2, 10)]
    got = retrieval.chunks(spark.createDataFrame(rows, "book string, ch long, size long"), "book", "ch", "size", 12_000).collect()
    assert {(r.book, r.chunk, r.first, r.last) for r in got} == {("g", 1, 1, 2), ("g", 2, 3, 4), ("x", 1, 1, 1), ("x", 2, 2, 2)}


def test_glob(spark):
    df = spark.createDataFrame([(s,) for s in ("abc", "aBc", "a.c", "ac", "a\nc", "[x]")], "s string")
    hit = lambda p: {r.s for r in df.where(lexical.glob("s", p)).collect()}
    assert hit("a?c") == {"abc", "aBc", "a.c", "a\nc"} and hit("a*c") == {"abc", "aBc", "a.c", "ac", "a\nc"} and hit("a[!b]c") == {"aBc", "a.c", "a\nc"} and hit("a[a-c]c") == {"abc"} and hit("a.c") == {"a.c"} and hit("[[]x]") == {"[x]"}


def brute_runs(left, right, n, cap):
    """Longest run of each pair by direct extension to the right from every live gram."""
    places = {}
    for b, ws in right.items():
        for j in range(len(ws) - n + 1):
            places.setdefault(tuple(ws[j : j + n]), []).append((b, j))
    best = {}
    for a, ws in left.items():
        for i in range(len(ws) - n + 1):
            live = places.get(tuple(ws[i : i + n]), [])
            for b, j in live if len(live) <= cap else []:
                k = 0
                while i + k < len(ws) and j + k < len(right[b]) and ws[i + k] == right[b][j + k]:
                    k += 1
                best[a, b] = max(best.get((a, b), 0), k)
    return best


def units_df(spark, texts):
    return spark.createDataFrame(list(texts.items()), "unit long, ws array<string>")


def test_cross_runs_equal_direct_extension(spark):
    r = random.Random(8)
    for cap in (1, 3):
        left, right = ({u: [r.choice("abc") for _ in range(14)] for u in range(6)} for _ in range(2))
        got = {(x.a, x.b): x.len for x in reuse.best_per_pair(reuse.cross_runs(units_df(spark, left), units_df(spark, right), 3, cap)).collect()}
        assert got == brute_runs(left, right, 3, cap)


def plain_best_runs(left, right, n, cap, freq):
    """(a, b): (diag, start, len, least) by trying every diagonal of every pair."""
    places = collections.Counter(tuple(ws[j : j + n]) for ws in right.values() for j in range(len(ws) - n + 1))
    best = {}
    for (a, x), (b, y) in itertools.product(left.items(), right.items()):
        for diag in range(-len(x), len(y)):
            same = [i for i in range(len(x)) if 0 <= i + diag < len(y) and x[i] == y[i + diag]]
            for _, isle in itertools.groupby(enumerate(same), lambda e: e[1] - e[0]):
                isle = [i for _, i in isle]
                live = [i for i in isle[: max(0, len(isle) - n + 1)] if places[tuple(x[i : i + n])] <= cap]
                if live:
                    size = isle[-1] + 1 - live[0]
                    best[a, b] = min(best.get((a, b), (0, 0, 0)), (-size, live[0], diag))
    return {k: (diag, start, -size, min(freq[w] for w in left[k[0]][start : start + n]) if size == -n else None) for k, (size, start, diag) in best.items()}


@pytest.mark.parametrize("held", [reuse.HELD, 0])
def test_best_runs_equal_all_diagonals(spark, monkeypatch, held):
    """The left corpus is read once for all kinds of runs, in parts; a long right corpus is joined, to the same end."""
    monkeypatch.setattr(reuse, "HELD", held)
    r = random.Random(5)
    text = lambda letters, least: [r.choice(letters) for _ in range(r.randrange(least, 30))]
    left, right = {u: text("abcx", 0) for u in range(12)} | {90: ["a"]}, {u: text("abcy", 0) for u in range(9)} | {91: []}
    left[7][3:3] = right[2][:9] = list("abcabcabc")
    freq = collections.Counter(w for ws in [*left.values(), *right.values()] for w in ws)
    kinds = [(4, 1), (3, 2), (2, 30)]
    extra = spark.createDataFrame([(99, None)], "unit long, ws array<string>")
    for (n, cap), made in zip(kinds, reuse.best_runs(units_df(spark, left).union(extra), units_df(spark, right).union(extra), *kinds)):
        got = {(x.a, x.b): (x.diag, x.start, x.len, x.least) for x in made.collect()}
        assert got == plain_best_runs(left, right, n, cap, freq) and len(got) > 5


def test_best_runs_without_a_right_side(spark):
    none = spark.createDataFrame([(1, [])], "unit long, ws array<string>")
    assert [d.count() for d in reuse.best_runs(units_df(spark, {1: list("abc")}), none, (4, 9), (3, 9))] == [0, 0]


def written_by(spark, monkeypatch, name):
    """The rows of a query, and the tables that it writes on the way."""
    met, plain = [], reuse.cut
    monkeypatch.setattr(reuse, "cut", lambda d, name: (met.append(d), plain(d, name))[1])
    return plans.QUERIES[name](spark, SF).count(), met


def test_merged_quotes_move_no_text(spark, monkeypatch):
    """Every document went through a shuffle for each kind of run, and its words through another count."""
    rows, met = written_by(spark, monkeypatch, "quotes_merged")
    assert rows and len(met) == 1 and not any("Exchange" in d._jdf.queryExecution().executedPlan().toString() for d in met)


@pytest.mark.parametrize("name", ["quotes_lemma_pass", "quotes_majority_lemmas", "quotes_runs", "quotes_tiers"])
def test_quotes_write_only_runs(spark, monkeypatch, name):
    """The words of all documents were written, and went through a shuffle to those of the runs."""
    rows, met = written_by(spark, monkeypatch, name)
    assert rows and [d.columns for d in met] == [["n", "a", "b", "diag", "start", "len", "words"]]
    assert "Exchange" not in met[0]._jdf.queryExecution().executedPlan().toString()


def test_lemmas_without_a_shuffle(spark):
    """Every word went through two shuffles; with a long dictionary they still do, to the same end."""
    seqs = spark.createDataFrame([(1, ["as", "b", "as", "cs"]), (2, []), (3, ["x"]), (4, None)], "unit long, ws array<string>")
    tagged = spark.createDataFrame([("as", "a"), ("as", "a"), ("as", "as"), ("b", "b"), ("cs", "d"), ("cs", "c")], "surface string, lemma string")
    want = [(1, ["a", "b", "a", "c"]), (3, ["x"])]
    made = reuse.lemmatised(seqs, tagged)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.unit, r.ws) for r in made.collect()) == want
    most = reuse.LEMMAS
    try:
        reuse.LEMMAS = 1
        assert sorted((r.unit, r.ws) for r in reuse.lemmatised(seqs, tagged).collect()) == want
    finally:
        reuse.LEMMAS = most


def test_tiers_replace_each_other(spark):
    kind = "a int, b int, len long, tier string"
    first = spark.createDataFrame([(1, 1, 5, "quotation"), (1, 2, 0, "echo"), (1, 3, 4, "allusion")], kind)
    second = spark.createDataFrame([(1, 1, 9, "allusion"), (1, 2, 3, "echo"), (1, 3, 4, "allusion"), (1, 4, 4, "allusion")], kind)
    assert {(r.b, r.tier, r.len) for r in reuse.merge_tiers(first, second).collect()} == {(1, "quotation", 5), (2, "echo", 3), (3, "allusion", 4), (4, "allusion", 4)}


def test_parallels_gate(spark):
    rare, common = "p q r s".split(), "x y z".split()
    texts = {1: rare + common, 2: ["k"] + rare, 5: common + ["m"], 1001: rare[:3]}
    df = spark.createDataFrame([(u, u // 1000, u % 1000, ws) for u, ws in texts.items()], "unit long, chapter long, line long, ws array<string>")
    got = {(r.a, r.b): (r.len, r.tier) for r in reuse.parallels(df, rare=2, phrase=1, echo=1).collect()}
    assert got == {(1, 5): (3, "echo")}
    assert reuse.parallels(df, rare=3).where("a = 1 and b = 1001").first().tier == "echo" and (1, 2) not in got


def brute_parallels(texts, near, distinctive, cap, rare, phrase, echo):
    """All diagonals of all pairs, run by run; texts has (chapter, line) -> words."""
    units = list(texts)
    grams = lambda ws: [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    df, gdf = {}, {}
    for ws in texts.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
        for g in set(grams(ws)):
            gdf[g] = gdf.get(g, 0) + 1
    out = {}
    for a, b in itertools.combinations(units, 2):
        if a[0] == b[0] and abs(a[1] - b[1]) <= near:
            continue
        x, y, best = texts[a], texts[b], None
        for diag in range(-len(x), len(y)):
            i = 0
            while i < len(x):
                n = 0
                while i + n < len(x) and 0 <= i + n + diag < len(y) and x[i + n] == y[i + n + diag]:
                    n += 1
                if n >= 3:
                    words, inside = [df[w] for w in x[i : i + n]], [gdf[g] for g in grams(x[i : i + n])]
                    if min(inside) <= cap:
                        widest = min(max(inside), cap + 1)
                        fits = (n >= 4 and (min(words) <= distinctive or min(words) <= 2 * distinctive and widest <= phrase)) or (n == 3 and (max(words) <= rare or min(words) <= rare and widest <= echo))
                        if fits and (best is None or (-n, i, diag) < best):
                            best = (-n, i, diag)
                i += max(n, 1)
        if best:
            out[a, b] = (best[1] + 1, best[1] + 1 + best[2], -best[0])
    return out


def test_parallels_equal_a_search_of_all_diagonals(spark):
    r = random.Random(13)
    for limits in ({"near": 1, "distinctive": 6, "cap": 4, "rare": 5, "phrase": 3, "echo": 2}, {"near": 0, "distinctive": 12, "cap": 2, "rare": 8, "phrase": 2, "echo": 1}):
        texts = {(c, line): [r.choice("abcde") for _ in range(r.randint(0, 14))] for c in range(3) for line in range(5)}
        rows = [(1000 * c + line, c, line, ws) for (c, line), ws in texts.items()]
        got = {((x.a // 1000, x.a % 1000), (x.b // 1000, x.b % 1000)): (x.start_a, x.start_b, x.len) for x in reuse.parallels(spark.createDataFrame(rows, "unit long, chapter long, line long, ws array<string>"), **limits).collect()}
        assert got == brute_parallels(texts, **limits) and got


def test_parallels_of_copies_and_long_lines(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randint(20, 45))] for _ in range(4)]
    texts = {}
    for c in range(3):
        for line in range(4):
            ws = list(base[(c + line) % 4])
            if c and line % 2:
                ws[r.randrange(len(ws))] = "z"
            texts[c, line] = ws
    rows = [(1000 * c + line, c, line, ws) for (c, line), ws in texts.items()]
    for limits in ({"near": 1, "distinctive": 6, "cap": 3, "rare": 5, "phrase": 3, "echo": 2}, {"near": 0, "distinctive": 5, "cap": 4, "rare": 5, "phrase": 2, "echo": 2}, {"near": 0, "distinctive": 11, "cap": 4, "rare": 5, "phrase": 4, "echo": 3}):
        got = {((x.a // 1000, x.a % 1000), (x.b // 1000, x.b % 1000)): (x.start_a, x.start_b, x.len) for x in reuse.parallels(spark.createDataFrame(rows, "unit long, chapter long, line long, ws array<string>"), **limits).collect()}
        assert got == brute_parallels(texts, **limits) and got


def test_parallels_meet_at_grams_with_a_rare_word_only(spark):
    """Lines that share only grams of common words were paired, with the words of both, before the gate refused them all."""
    rows = [(u, u, 1, ["x", "y", "z", f"w{u}"]) for u in range(40)] + [(100 + u, 100 + u, 1, ["p", "q", "r", "s"]) for u in range(2)]
    df = spark.createDataFrame(rows, "unit long, chapter long, line long, ws array<string>")
    met = []
    plain = reuse.cut
    try:
        reuse.cut = lambda d, name: (met.append((name, plain(d, name))), met[-1][1])[1]
        found = reuse.parallels(df, distinctive=5, rare=5).select("a", "b", "len").collect()
    finally:
        reuse.cut = plain
    assert list(map(tuple, found)) == [(100, 101, 4)]
    assert sum(d.count() for name, d in met if name in ("grams", "met")) == 0  # the two copies are one class


def test_chains_query_covers_every_source(spark):
    from corpusloom import plans
    from corpusloom.tables import words

    sf = "/root/testdata/sf0.001"
    sources = {r.book_num for r in words(spark, sf).select("book_num").distinct().collect()}
    found = {b for r in plans.QUERIES["parallels_chains"](spark, sf).select("book_a", "book_b").distinct().collect() for b in r}
    assert len(sources) == 20 and found == sources


def test_chains(spark):
    rows = [(1, 2, 10, 50, 5), (1, 2, 11, 51, 7), (1, 2, 13, 52, 4), (1, 2, 16, 60, 3), (1, 3, 14, 53, 9)]
    got = reuse.chains(spark.createDataFrame(rows, "book_a int, book_b int, oa long, ob long, len long")).collect()
    assert {(r.book_b, r.a_start, r.a_end, r.b_start, r.b_end, r["len"], r.n_pairs, r.tier) for r in got} == {(2, 10, 13, 50, 52, 7, 3, "parallel"), (2, 16, 16, 60, 60, 3, 1, "echo"), (3, 14, 14, 53, 53, 9, 1, "parallel")}


def test_chains_equal_a_plain_fold(spark):
    r = random.Random(4)
    rows = sorted({(1, r.randint(1, 3), r.randint(0, 15), r.randint(0, 15)) for _ in range(160)})
    rows = [(*x, r.randint(3, 9)) for x in rows]
    chains = []
    for a, b, oa, ob, n in rows:
        for i, j in ((1, 1), (1, 2), (2, 1), (2, 2)):
            if found := [c for c in chains if c[:2] == [a, b] and (c[3], c[5]) == (oa - i, ob - j)]:
                found[0][3], found[0][5], found[0][6], found[0][7] = oa, ob, max(found[0][6], n), found[0][7] + 1
                break
        else:
            chains.append([a, b, oa, oa, ob, ob, n, 1])
    got = reuse.chains(spark.createDataFrame(r.sample(rows, len(rows)), "book_a int, book_b int, oa long, ob long, len long")).drop("tier").collect()
    assert sorted(map(list, got)) == sorted(chains) and any(c[7] > 3 for c in chains)


def test_session_folds(spark):
    units = spark.createDataFrame([("s", i) for i in range(90)], "session string, unit int")
    reads = spark.createDataFrame([("s", u) for u in (0, 1, 2, 52, 2)], "session string, unit int")
    c = session.coverage(units, reads, ["session"]).first()
    assert (c.units_read, c.percent, c.gaps, c.longest_gap) == (4, 4, 2, 49)
    assert {(r.first, r.last, r.size) for r in session.gap_runs(units.select("unit"), reads).collect()} == {(3, 51, 49), (53, 89, 37)}
    log = spark.createDataFrame([("s", i, None, k, u, *[None] * 6) for i, (k, u) in enumerate([("next", None)] * 3 + [("prev", None), ("goto", 7), ("next", None)])], session.LOG_SCHEMA)
    assert session.cursor(log, 90).first().cursor == 9
    notes = session.add_note(spark, "s", 9, 1, "pattern", "t", [5]).union(spark.createDataFrame([("s", 10, None, "resolve", None, 1, None, None, None, None, "supported")], session.LOG_SCHEMA))
    assert session.notes(notes).first().status == "supported"
    for bad in (("idea", [1], None), ("pattern", [], None), ("counterexample", [1], None), ("pattern", [1], 3)):
        with pytest.raises(ValueError, match="must|needs|names"):
            session.add_note(spark, "s", 1, 1, bad[0], "t", bad[1], bad[2])


def test_session_export_delete_and_chunk_units(spark):
    log = spark.createDataFrame([("s", 2, None, "read", 1, *[None] * 6), ("s", 1, None, "next", None, *[None] * 6), ("t", 1, None, "read", 0, *[None] * 6)], session.LOG_SCHEMA)
    assert [(r.seq, r.event) for r in session.exported(log, "s").collect()] == [(1, '{"seq":1,"kind":"next"}'), (2, '{"seq":2,"kind":"read","unit":1}')]
    assert [r.session for r in session.deleted(log, "s").collect()] == ["t"]
    chunks = spark.createDataFrame([("b", 1, 9, 9), ("a", 2, 4, 6), ("a", 1, 1, 3)], "book string, chunk long, first long, last long")
    assert [(r.unit, r.start, r.end) for r in session.chunk_units(chunks, "book").orderBy("unit").collect()] == [(0, 1, 3), (1, 4, 6), (2, 9, 9)]


def test_snippets(spark):
    from corpusloom.operators.search import snippet

    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)) + " of The, end of them",), ("of the",), ("nothing",)], "text string")
    shown = [r.s for r in df.select(snippet("text", "of the", size=6, prefix=True).alias("s")).collect()]
    assert shown == ["…w49 >>of The,<< end >>of them<<", ">>of the<<", None]
    assert [r.s for r in df.select(snippet("text", "of the", size=5).alias("s")).collect()][0] == "…>>of The,<< end of them"


def test_snippets_of_long_lines_take_linear_time(spark):
    """Each place of a phrase was tried on the tokens of the whole line, made anew for each."""
    import time

    from corpusloom.operators.search import snippets

    df = spark.createDataFrame([(i, " ".join(["a"] * 20_000) + f" of the, w{i}") for i in range(8)], "id long, text string")
    found = snippets(df, "id", "text", "of th", size=4, prefix=True)
    began = time.time()
    assert [r.shown for r in found.orderBy("id").collect()] == [f"…a >>of the,<< w{i}" for i in range(8)]
    assert time.time() - began < 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_outline_joins_uncommon_lemmas_only(spark):
    """All lemmas of all chapters were joined to their frequencies and ranked after a shuffle."""
    said = [(1, w) for w in "a a a b b c".split()] + [(2, w) for w in "a b b d".split()] + [(3, "a"), (3, "a")]
    words = spark.createDataFrame(said, "doc_id long, lemma string")
    verses = spark.createDataFrame([(d, 1, "x y") for d in (1, 2, 3, 4)], "doc_id long, verse long, text string")
    for most in (0, 2, 9):
        made = retrieval.outline(verses, words, most=most)
        assert {r.doc_id: r.rarest for r in made.collect()} == {1: "c,b", 2: "d,b", 3: "a", 4: None}
    assert "WindowGroupLimit" in made._jdf.queryExecution().optimizedPlan().toString()


def test_structure(spark):
    words = spark.createDataFrame([(1, 1, 1, "ab", "H", 7), (1, 1, 2, "cd", "H", 7), (1, 2, 1, "x", "G", 7), (1, 2, 2, "y", "G", 7)], "v long, word_num long, part_num int, surface string, lang string, editions int")
    assert structure.reconstruct(words, "v").first().text == "abcd x"
    ed = spark.createDataFrame([(1, 1, "a", 3), (1, 2, "b", 1), (1, 2, "c", 3)], "v long, word_num long, surface string, editions int")
    assert {(r.text, r.editions) for r in structure.edition_texts(ed, "v", 2).collect()} == {("a b", "0"), ("a c", "1")}
    assert {(r.text, r.editions) for r in structure.edition_texts(ed, "v", 3).collect()} == {("a b", "0"), ("a c", "1"), ("", "2")}
    none = spark.createDataFrame([(1, 1, "a", 0)], "v long, word_num long, surface string, editions int")
    assert [(r.text, r.editions) for r in structure.edition_texts(none, "v", 2).collect()] == [("", "0,1")]
    roles = spark.createDataFrame([(1, "s", 0, "w"), (1, "s", 1, "e"), (1, "o", 1, "f")], "c int, role string, embedded int, word string")
    assert {r.word for r in structure.display_roles(roles, "c", "role").collect()} == {"w", "f"}
    with pytest.raises(AssertionError, match="orphans"):
        structure.check(roles, "orphans")


def test_read_only_sql(spark):
    assert read_only_sql(spark, SF, "-- x\nSELECT count(*) AS n FROM region;").first().n == 5
    for bad in ("DROP TABLE region", "INSERT INTO region SELECT 1", "", "WITH x AS (SELECT 1) INSERT INTO region SELECT * FROM x"):
        with pytest.raises(ValueError, match="queries"):
            read_only_sql(spark, SF, bad)
    assert truncated(spark.range(5), 3)[1] and not truncated(spark.range(3), 3)[1]


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    tsv = put("a.tsv", "﻿# note\n\nJohn 3:16\tFor\nJohn 3\tx\nNowhere 1:1\ty\nJohn 3:17\t\n")
    assert {(r.verse_id, r.problem) for r in readers.reference_tsv(spark, tsv).collect()} == {(43003016, None), (43003000, "not a single verse"), (None, "unreadable reference"), (43003017, "no text")}
    assert readers.tsv_rows(spark, put("b.tsv", "prose here\nGen.1.1#01\tx\n"), r"^\w+\.\d+\.\d+").first().cells == ["Gen.1.1#01", "x"]
    assert readers.usfm(spark, put("c.usfm", "\\id GEN\n\\c 1\n\\v 1-2 one\n")).first()[:5] == ("GEN", 1, 1, 2, "one")
    assert [r.text for r in readers.word_lines(spark, put("d.txt", "Gen.1.1 in\nGen.1.1 the\nGen.1.2 b\n")).orderBy("verse").collect()] == ["in the", "b"]
    assert readers.chapter_verse_text(spark, put("e.txt", "Genesis 1:2\tAnd\nhead\n")).first()[:4] == ("Genesis", 1, 2, "And")
    assert [r.k for r in readers.mapping_csv(spark, put("f.csv", "k,v\nH0000,a\nH0001,b\n")).collect()] == ["H0001"]
    assert readers.quoted_tsv(spark, put("g.tsv", 'a\tb\n1\t"x ""y"""\n')).first().b == 'x "y"'
    assert readers.html_entries(spark, put("h.html", "<h1>T&amp;<br>U</h1>"), {"title": "<h1>(.*?)</h1>"}).first()[:2] == ("h", "T&\nU")
    books = spark.createDataFrame([("Gen", 1), ("Joh", 43)], "code string, book_num int")
    assert [tuple(r) for r in readers.edges_tsv(spark, put("i.tsv", "From\tTo\tVotes\nGen.1.1\tJoh.1.1-Joh.1.3\t9\nXxx.1.1\tJoh.1.1\t2\n"), books).collect()] == [(1001001, 43001001, 43001003, 9)]
    assert readers.name_blocks(spark, put("j.txt", "head\nno block\n")).count() == 0
    assert [tuple(r) for r in readers.name_blocks(spark, put("k.txt", "$====PERSON\nAaron\tz\n–Named\tH0175\n")).collect()] == [("PERSON", "Aaron", "Named", "H0175")]
    xml = '<bank id="b"><sentence id="1"><c><g role="s"><w v="1" s="H1">a</w></g><w v="1" role="adv" neg="1">not</w><c role="o"><w v="2" role="v">go</w></c></c></sentence></bank>'
    rows = [tuple(r) for r in readers.treebank(spark, put("l.xml", xml)).collect()]
    assert {(r[0], r[4], r[5], r[7], r[8]) for r in rows} == {("b.1.0", "s", "a", 0, 1), ("b.1.0", "adv", "not", 0, 1), ("b.1.0", "o", "go", 1, 1), ("b.1.1", "v", "go", 0, 0)} and {r[2:4] for r in rows} == {(1, 2), (2, 2)}
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("x/a.usfm", "﻿hi")
        z.writestr("a/b/c/d/e.txt", "deep")
    assert [tuple(r) for r in readers.zip_members(spark, f"file://{tmp_path}/m.zip").select("name", "text").collect()] == [("x/a.usfm", "hi")]


def test_artifacts(spark, tmp_path):
    path = f"file://{tmp_path}/core"
    verses = spark.createDataFrame([(2, "b"), (1, "a")], "verse_id long, text string")
    for _ in range(2):
        artifacts.write_artifact(spark, path, {"verses": verses}, {"verses": ["verse_id"]})
    assert artifacts.open_artifact(spark, path, ["verses"], "core_")["verses"].count() == 2 and spark.table("core_verses").count() == 2
    assert artifacts.attach_optional(spark, path, "none", "x int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"PAR1 this is no table PAR1")
    spark.createDataFrame([(7,)], "x int").write.mode("append").parquet(f"file://{tmp_path}/bad")
    own = artifacts.attach_optional(spark, f"file://{tmp_path}", "bad", "x int")
    assert [r.x for r in own.collect()] == [7]
    assert {(r.x, r.y) for r in artifacts.union_texts(own, spark.createDataFrame([(1, 2)], "x int, y int")).collect()} == {(7, None), (1, 2)}
    artifacts.write_artifact(spark, path, {"verses": verses, "words": spark.range(4)})
    artifacts.rebuild_tables(spark, path, {"verses": spark.read.parquet(f"{path}/verses").where("verse_id = 2")})
    again = artifacts.open_artifact(spark, path, ["verses", "words"])
    assert [r.text for r in again["verses"].collect()] == ["b"] and again["words"].count() == 4 and sorted(p.name for p in (tmp_path / "core").iterdir()) == ["meta", "verses", "words"]
    artifacts.write_artifact(spark, path, {"verses": verses}, meta={"schema_version": "99"})
    with pytest.raises(ValueError, match="newer"):
        artifacts.open_artifact(spark, path, ["verses"])
    assert artifacts.valid_id(" kjv2 ", {"KJV"}) == "KJV2"
    for bad in ("x", "KJV", "toolongid1", "a-b"):
        with pytest.raises(ValueError, match="id|shipped"):
            artifacts.valid_id(bad, {"KJV"})
    own = spark.createDataFrame([("A", 1), ("B", 2)], "id string, v int")
    assert {tuple(r) for r in artifacts.replace_by_id(own, spark.createDataFrame([(9,)], "v int"), "id", "B").collect()} == {("A", 1), ("B", 9)}


def test_streamed_coverage(spark, tmp_path):
    from corpusloom.streaming.session_log import coverage_stream, read_log

    rows = [("s", i, None, "read", u, *[None] * 6) for i, u in enumerate([0, 1, 1, 5])]
    log = spark.createDataFrame(rows, session.LOG_SCHEMA)
    log.withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/log")
    log.withColumn("ts", F.current_timestamp() - F.expr("interval 3 days")).write.mode("append").parquet(f"{tmp_path}/log")  # the same units, much later
    q = coverage_stream(read_log(spark, f"{tmp_path}/log"), 10).writeStream.outputMode("update").format("memory").queryName("cov").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cov").first().percent == 30


def test_documents_of_too_many_lines_are_refused(spark, monkeypatch):
    from corpusloom import tables

    monkeypatch.setattr(tables, "LINES", 4)
    docs = lambda n: spark.createDataFrame([(1, "src001", "en", "\n".join("abcdefg"[:n]))], "doc_id long, source string, lang string, text string")
    assert [r.verse_id for r in tables.lines_of(docs(3)).collect()] == [5, 6, 7]
    with pytest.raises(Exception, match="4 lines or more"):
        tables.lines_of(docs(4)).collect()


def test_scopes_prune_documents(spark):
    from corpusloom import plans

    for name in ("passage_range", "passage_scopes", "interlinear_rows", "morph_parse"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(doc_id," in plan and "LessThanOrEqual(doc_id," in plan


def test_combined_filters(spark):
    df = spark.createDataFrame(list(itertools.product(range(3), "ab")), "n int, s string")
    assert df.where(lexical.conjunction([])).count() == 6 and df.where(lexical.conjunction([F.col("n") == 1, F.col("s") == "a"])).count() == 1
    assert df.where(retrieval.in_scope("n", [(0, 0), (2, 5)])).count() == 4 and df.where(retrieval.in_scope("n", [])).count() == 6


def test_spine_checks_and_flow(spark):
    spine = spark.createDataFrame([(1001001, 1, 1, "a"), (1001002, 1, 2, "b"), (1001000, 1, 0, "T")], "verse_id long, doc_id int, verse int, text string")
    retrieval.check_on_spine(spine, [1001001, 1001999, 1001000])
    for key, what in ((1001009, "ends at 1001002"), (1009001, "no verses")):
        with pytest.raises(ValueError, match=what):
            retrieval.check_on_spine(spine, [key])
    retrieval.guard_size(spine, 1001000, 1001999, 3)
    with pytest.raises(ValueError, match="more than 2"):
        retrieval.guard_size(spine, 1001000, 1001999, 2)
    assert retrieval.flow(spine).first().text == "T [1] a [2] b"


def test_sinks(spark, tmp_path):
    from corpusloom.sources import sinks

    df = spark.createDataFrame([(1, "x"), (22, None)], "n int, s string")
    assert sinks.aligned(df) == "n   s\n1   x\n22" and sinks.aligned(df, 1).endswith("…")
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    for _ in range(2):
        sinks.append_log(df, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    words = spark.createDataFrame([(1, "a"), (2, "b")], "verse_id long, lemma string")
    sinks.clustered_tokens(words, "tokens_test", 4)
    t = spark.table("tokens_test")
    assert "Exchange" not in t.groupBy("lemma").count()._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
