import random

import numpy as np
import pytest

from haze.llm import ngram_join
from haze.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id bigint, text string"


def got(spark, rows, n, p, q):
    out = ngram_join.join_components(spark.createDataFrame(rows, SCHEMA), n, p, q)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share:
            out.append(f"x{rng.randrange(10 ** 6)}")
        elif r >= share * 1.2:
            out.append(w)
    return out


def corpus(seed, n_docs, near, passage=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(passage)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = []
    for i in range(n_docs):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 9, 30, 80, 200]))]
        docs.append(" ".join(own + (common if rng.random() < .4 else [])))
        if rng.random() < .3:
            docs.append(" ".join(edited(rng, own, rng.choice([0, .005, .02, .05]))))
    docs += [" ".join(edited(rng, base, rng.choice([0, .005, .01, .02, .05, .1]))) for _ in range(near)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("n,p,q", [(4, 85, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, n, p, q):
    rows = corpus(n, 250, 150)
    assert got(spark, rows, n, p, q) == brute.jaccard_components(rows, n, p, q)


@pytest.mark.parametrize("large,n,p", [(3, 4, 85), (40, 4, 85), (5000, 5, 80), (10, 5, 80)])
def test_large_buckets_lose_no_link(spark, monkeypatch, large, n, p):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rows = corpus(9, 120, 160)
    assert got(spark, rows, n, p, 100) == brute.jaccard_components(rows, n, p, 100)


def test_registered_rows_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spark, rows, 4, 85, 100) == brute.jaccard_components(rows, 4, 85, 100)


def test_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(4)
    for size in [1, 3, 40, 500]:
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 3:], rng.integers(0, 1 << 63, size // 3).astype(np.uint64)]))
        u, v = ngram_join.sketch(a).view(np.uint64), ngram_join.sketch(b).view(np.uint64)
        assert len(u) == len(v) and np.bitwise_count(u ^ v).sum() <= len(np.setxor1d(a, b))


def test_keep_one_of_each_component(spark):
    rows = corpus(5, 100, 60) + [(900, None), (901, None), (902, ""), (903, "same text here"), (903, "same text here"), (904, "same text here"), (None, "same text here")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], SCHEMA + ", d int, TEXT2 string")
    out = ngram_join.keep_one(df, 4, 85, 100)
    assert out.columns == df.columns
    want = {v[1] for v in brute.jaccard_components([r for r in rows if r[0] is not None], 4, 85, 100).values()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_defined_cases(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "a b"), (9, "A  B"), (3, "a b"), (3, "a b"), (None, "a b"), (11, "c")]
    out = ngram_join.join_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()
    by = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(rows)
    assert by == {(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (9, 1, 3), (3, 1, 3), (None, 1, 3), (11, 1, 11)}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, d string, SIG int, n_shingles int")
    assert ngram_join.join_components(empty).collect() == []
    rows = [(1, "a b c d e f", "x", 1, 2), (2, "a b c d e f", "y", 3, 4)]
    out = ngram_join.join_components(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(1, 2, 1), (2, 2, 1)]


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9973}" for i in range(300_000))
    out = got(spark, [(1, long), (2, long + " end"), (3, "w1 w2")], 4, 85, 100)
    assert out[1][1] == out[2][1] == 1 and out[3][1] == 3


@pytest.mark.parametrize("p", [80, 85, 90])
def test_linked_sets_share_a_signature(p):
    rng = np.random.default_rng(3)
    for size in [3, 7, 8, 13, 20, 31, 50, 100, 400, 1500]:
        for _ in range(40):
            items = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = rng.integers(0, max(1, size * 11 // 100) + 1)
            other = np.unique(np.concatenate([items[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
            i = len(np.intersect1d(items, other))
            if i < len(items) and 100 * i >= p * (len(items) + len(other) - i):
                assert set(ngram_join.signatures(items, p, 100)) & set(ngram_join.signatures(other, p, 100))


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(201, 202), (202, 203), (203, 201)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(50))
    assert out[201] == out[202] == out[203] == 201


def test_word_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 40)
    monkeypatch.setattr(ngram_join, "LONG", 9)
    rng = random.Random(8)
    seen = {}
    for _ in range(2000):
        text = "".join(rng.choice("aAbB\u00e9\u00c9z \t\n\x0b\x0c\r\x1c\x85") for _ in range(rng.choice([0, 1, 5, 60, 90]))).encode()
        words = brute.BLANK_WORD.findall(brute.lower(text.decode()))
        hashes = ngram_join.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(seen) > 2500 and len(set(seen.values())) == len(seen)


def test_one_bucket_of_those_with_the_same_members(spark):
    rows = [(s, d) for s, ds in {5: (1, 2, 3), 4: (3, 1, 2), 9: (1, 2), 7: (2, 1), 8: (1, 3), 6: (4,)}.items() for d in ds]
    out = ngram_join._unlike(spark.createDataFrame(rows, "sig bigint, d bigint"), "sig").collect()
    assert sorted((r.sig, r.m) for r in out) == [(4, 3), (7, 2), (8, 2)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_only_sets_of_pairs_are_moved(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few, raising=False)
    sets = spark.createDataFrame([(i, [*range(i, i + 20)]) for i in range(200)], "d bigint, items array<bigint>")
    pairs = spark.createDataFrame([(5, 6), (5, 7), (30, 31), (40, 60)], "x bigint, y bigint")
    links = ngram_join._check(pairs, sets, 85, 100)
    assert sorted(map(tuple, links.collect())) == [(5, 6), (30, 31)]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2  # both sides of the pairs
    assert plan.count("rightHint=(strategy=broadcast)") == (2 if few else 0)


@pytest.mark.parametrize("few", [0, 100_000])
def test_hot_sets_are_picked_without_moving_the_others(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    sets = spark.createDataFrame([(i, [*range(i, i + 4)]) for i in range(50)], "d bigint, items array<bigint>")
    hot = spark.createDataFrame([(5,), (6,), (40,)], "d bigint")
    rare = ngram_join._rarest(sets, hot, 75, 100)
    assert sorted((r.d, r["item"]) for r in rare.collect()) == [(5, 5), (5, 6), (6, 6), (6, 9), (40, 40), (40, 41)]
    plan = rare._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") and ("rightHint=(strategy=broadcast)" in plan) == bool(few)


def test_rounds_move_light_rows_of_keys_that_had_something_left(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    kept = []

    def step(df, name, of=ngram_join.step):
        out = of(df, name)
        if name == "keys":
            kept.append((out.columns, {(r.item, r.d) for r in out.collect()}))
        elif name == "left":
            kept.append(("left", {r.item for r in out.collect()}))
        return out

    monkeypatch.setattr(ngram_join, "step", step)
    rows = corpus(9, 120, 160)
    assert got(spark, rows, 4, 85, 100) == brute.jaccard_components(rows, 4, 85, 100)
    assert all(columns in ("left", ["item", "d", "m"]) for columns, _ in kept)
    rounds = [(a[1], b[1]) for a, b in zip(kept, kept[1:]) if a[0] == "left"]
    assert rounds and all({item for item, _ in after} <= left for left, after in rounds)
