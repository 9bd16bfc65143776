"""The registered queries and the pipeline on the smallest tables, against brute force or SQL."""

import bisect
import hashlib
import itertools
import os
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from corpusloom import staging
from corpusloom.llm import decontaminate, language_id, mixing, quality_classifier, queries, sharding, simhash, token_counts
from tests.llm.test_operators import greedy, groups_of

SF = "/root/testdata/sf0.001"


def rows_of(t):
    names = sorted(t.column_names)
    return sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names]))) if t.num_rows else []


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet")


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    assert rows_of(queries.QUERIES[name](spark, SF).toArrow()) == rows_of(con.execute(queries.ORACLES[name]).to_arrow_table())


def test_language_query(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    right = [got[i].predicted == lang for i, lang in zip(docs["doc_id"].to_pylist(), docs["lang"].to_pylist())]
    assert len(got) == docs.num_rows and np.mean(right) > 0.97


def test_language_query_against_plain_python(spark, docs):
    """Scores summed gram by gram with whole numbers of Python, under the model that the query trains."""
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    mask = (1 << 32) - 1
    close = 0
    for i, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
        raw = text.lower().encode() + b"\n"
        if len(raw) > 4000:  # Python is slow; the sums of long texts have a test of their own
            continue
        rows = []
        for j in range(len(raw) - 3):
            three = (raw[j] * 0x9E3779B1 & mask) ^ (raw[j + 1] * 0x85EBCA77 & mask) ^ (raw[j + 2] * 0xC2B2AE3D & mask)
            four = (three * 0x27D4EB2F & mask) ^ (raw[j + 3] * 0x165667B1 & mask) ^ 0x5BD1E995
            rows += [((x ^ x >> 15) * 0x2C1B3C6D & mask) >> 17 for x in (three, four)]
        if not rows:
            assert (got[i].predicted, got[i].confidence, got[i].accepted) == ("und", 0.0, False)
            continue
        z = (model.table[rows].astype(float).mean(0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got[i].confidence - p.max()) < 1e-4
        if abs(p.max() - model.threshold) > 1e-4 and np.sort(p)[-1] - np.sort(p)[-2] > 1e-4:
            assert got[i].predicted == model.languages[int(p.argmax())] and got[i].accepted == (p.max() >= model.threshold)
            close += 1
    assert close > 100


def brute_duplicates(ids, texts):
    sig = simhash.signatures_of(pa.array(texts))
    near = lambda i: np.flatnonzero(np.bitwise_count(sig[:i] ^ sig[i]).sum(1) <= simhash.MAX_DISTANCE)
    return groups_of([(ids[j], ids[i]) for i in range(len(ids)) for j in near(i)])


def test_dedup_query(spark, docs):
    want = brute_duplicates(docs["doc_id"].to_pylist(), docs["text"].to_pylist())
    got = {r.doc_id: r.keep_id for r in queries.QUERIES["op2_simhash_near_dedup"](spark, SF).collect()}
    assert got == want and len(want) > 0  # the search misses one pair in thousands, none of this table


def test_classifier_query(spark):
    got = {r.doc_id: r.keep for r in queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    right = [got[r["doc_id"]] == (r["quality"] == 1) for r in labels]
    assert np.mean(right) > 0.97


def plain_statistics(text):
    """The features of one text, a loop for each."""
    raw = text.encode()
    size = len(raw)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z_\x80-\xff]+", raw)]
    low = [raw[a:b].lower() for a, b in words]
    tokens = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw)
    blanks = sum(c in b" \t\n\r\x0b\x0c" for c in raw)
    count = lambda chars: sum(c in chars for c in raw)
    symbols = b"#$%&*@^~+=<>{}[]|\\"
    lines = [x for x in raw.split(b"\n") if x]
    copied = [x for i, x in enumerate(lines) if x in lines[:i]]
    share = lambda a, b: a / max(b, 1)
    stop = {w.encode() for w in quality_classifier.STOP_WORDS}
    n, t, k = len(words), len(tokens), len(lines)
    upper = lambda c: 65 <= c <= 90
    return [
        size, n, share(sum(map(len, low)), n), t, share(size - blanks, t), share(sum(map(upper, raw)), size), share(count(b"0123456789"), size), share(count(b"."), n), share(count(b","), n), share(count(b"!"), n),
        share(count(symbols), size), share(count(b"|"), t), share(blanks, size), share(sum(c >= 128 for c in raw), size), k, share(size, k), share(len(copied), k), share(sum(map(len, copied)), size),
        share(len(set(low)), n), share(max((low.count(w) for w in set(low)), default=0), n), share(sum(w in stop for w in low), n), share(sum(len(w) <= 3 for w in low), n), share(sum(len(w) >= 12 for w in low), n),
        share(sum(x[-1] in symbols for x in tokens), t), share(sum(upper(raw[a]) and upper(raw[b - 1]) and b - a > 1 for a, b in words), n), share(sum(x[-1] in b'.!?:;"' for x in lines), k), max(map(len, tokens), default=0),
    ]


def test_classifier_query_against_plain_python(spark, docs):
    """Features counted in loops and trees walked node by node, under the forest that the query trains."""
    forest = quality_classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality_classifier"](spark, SF).collect()}
    checked = 0
    for i, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
        if len(text) > 20_000:
            continue
        row, total = plain_statistics(text), forest.base
        for feature, split, value in zip(forest.feature, forest.split, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > split[node])
            total += value[node - len(feature)]
        want = 1 / (1 + np.exp(-total))
        assert abs(got[i].score - want) < 1e-6 and got[i].keep == (got[i].score >= forest.threshold)
        checked += 1
    assert checked > 150


def brute_contaminated(ids, texts, bench):
    """Every region of every document against every passage, without the latent space."""
    words, off = decontaminate.words_of(pa.array(texts))
    start, first = decontaminate._blocks(off, decontaminate.PASSAGE)
    unit = np.repeat(np.arange(len(start) - 1), np.diff(start))
    held = np.bincount(np.unique(unit * decontaminate.BUCKETS + decontaminate.bucket_of(words)) % decontaminate.BUCKETS, minlength=decontaminate.BUCKETS)
    passages = decontaminate.passages_of(bench, decontaminate.inverse_frequencies(held, int(first[-1])))
    out = set()
    for d, i in enumerate(ids):
        own = words[off[d] : off[d + 1]].tolist()
        for p in passages:
            half = p.window // 2
            for lo in range(0, max(len(own), 1), half):
                near = own[max(0, lo - half) : lo + p.window + half]
                answer = len(set(near) & set(p.answer)) >= decontaminate.ANSWER * len(p.answer)
                if decontaminate.lcs_length(p.masks, len(p.words), near) >= (decontaminate.COMMON if answer else decontaminate.STRONG) * len(p.words):
                    out.add((i, p.item_id))
    return out


def bench_rows():
    t = pq.read_table(f"{SF}/benchmark.parquet")
    return list(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))


def test_decontamination_query(spark, docs):
    want = brute_contaminated(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), bench_rows())
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontaminate"](spark, SF).collect()}
    assert got == want and len(want) > 0  # no match of this table lies beyond the cosine


def test_token_query(spark, docs):
    vocabulary = set(token_counts.read_vocabulary())
    known = {}
    want = {}
    for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
        data, _ = token_counts.text_bytes(pa.array([t]))
        words = [data[a:b].tobytes() for a, b in zip(*token_counts.pre_tokens(data))]
        want[i] = (len(words), sum(known[w] if w in known else known.setdefault(w, greedy(vocabulary, w)) for w in words))
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in queries.QUERIES["op9_token_counts"](spark, SF).collect()} == want


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_shards(rows, target):
    """The shard of each (doc_id, text): bounds from the sorted draws, then running sums in ranges that are too large."""
    digest = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed=seed)
    records = [(-(1 << 63) if i is None else i, 42 if t is None else signed(digest(t.encode(), 42)), len((t or "").encode()) + 1) for i, t in rows]
    draws = {}
    for key, tie, size in records:
        h = digest(struct.pack("<q", tie), digest(struct.pack("<q", key), digest(struct.pack("<i", sharding.SEED), 42)))
        times = size * (sharding.PER_SHARD / target)
        n = int(times) + ((signed(h) % (1 << 30)) / (1 << 30) < times - int(times))
        if n:
            draws[key, tie] = draws.get((key, tie), 0) + n
    bounds, run = [], 0
    for place, n in sorted(draws.items()):
        run += n
        if run // sharding.PER_SHARD > (run - n) // sharding.PER_SHARD:
            bounds.append(place)
    held = {}
    for key, tie, size in sorted(records):
        held.setdefault(bisect.bisect_left(bounds, (key, tie)), []).append((key, tie, size))
    more = []
    for own in held.values():
        total, run = sum(size for *_, size in own), 0
        if total > sharding.SLACK * target:
            part = total / -(-total // target)
            for place, same in itertools.groupby(own, lambda r: r[:2]):
                size = sum(r[2] for r in same)
                run += size
                if run < total and run // part > (run - size) // part:
                    more.append(place)
    bounds = sorted(set(bounds + more))
    return [bisect.bisect_left(bounds, r[:2]) for r in records]


def test_shard_query(spark, docs):
    rows = list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()))
    got = queries.QUERIES["op10_shard"](spark, SF)
    assert rows_of(got.drop("shard").toArrow()) == rows_of(docs)
    assert sorted((r.doc_id, r.shard) for r in got.collect()) == sorted((i, s) for (i, _), s in zip(rows, brute_shards(rows, sharding.TARGET_BYTES)))
    odd = [(None, "x" * 900), (None, None), (5, ""), (5, "y" * 5000), (5, "y" * 5000), (-3, "z" * 100)]
    for target in (7_000, 40_000):
        small = sharding.shard(spark.createDataFrame(rows + odd, "doc_id long, text string"), target=target).collect()
        want = brute_shards(rows + odd, target)
        assert sorted(map(repr, small)) == sorted(repr(type(small[0])(doc_id=i, text=t, shard=s)) for (i, t), s in zip(rows + odd, want))
        size = {}
        for r in small:
            size[r.shard] = size.get(r.shard, 0) + len((r.text or "").encode()) + 1
        longest = max(len(t.encode()) for t in docs["text"].to_pylist())
        assert max(size.values()) <= 1.25 * target + longest and len(size) >= 5


def test_pipeline_against_brute_force(spark, docs):
    """Each stage anew in plain Python, over what the stages before it kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality_classifier.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.to_pylist()
    score = forest.score(quality_classifier.statistics(docs["text"].combine_chunks()))
    rows = [r for r, s in zip(rows, score) if s >= forest.threshold]
    gone = brute_duplicates([r["doc_id"] for r in rows], [r["text"] for r in rows])
    rows = [r for r in rows if r["doc_id"] not in gone]
    leaks = {d for d, _ in brute_contaminated([r["doc_id"] for r in rows], [r["text"] for r in rows], bench_rows())}
    rows = [r for r in rows if r["doc_id"] not in leaks]
    sources = sorted({r["source"] for r in rows})
    size = np.array([sum(len(r["text"]) for r in rows if r["source"] == s) for s in sources], float)
    epochs = dict(zip(sources, mixing.water_fill(size, np.sqrt(size), size.sum(), mixing.MAX_EPOCHS)))
    want = []
    for r in rows:
        e = epochs[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        want += [r["doc_id"]] * (int(e) + (u < e - int(e)))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.column_names, "shard"]
    got = sorted(r.doc_id for r in out.collect())
    # both searches are exact on this table
    assert got == sorted(want)


def test_pipeline_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SF)
    assert [p.name.rpartition("-")[0] for p in (tmp_path / "corpusloom").iterdir()] == ["mixing-to-target-weights"]
    assert out.count() > 0


def test_every_stage_takes_odd_rows(spark):
    from tests.llm.test_operators import DOCS, clash, odd_rows

    odd = clash(spark.createDataFrame(odd_rows(), DOCS), "keep", "copies", "key", "range", "digest", "gone_digest", "part", "root", "member")
    for kept in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == odd.columns
            kept.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).columns == [*odd.columns, "shard"]
