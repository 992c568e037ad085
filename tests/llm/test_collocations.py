import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from haze.llm import collocations
from tests.llm.brute import lower

SCHEMA = "text string, lang string"


def plain(rows, least=30, most=4, covered=80, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    cand = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], a)
    scored = {}
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] >= covered * a:
            continue
        cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    out = []
    for lang, found in scored.items():
        for rank, (score, a, phrase, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, le, r, total[lang], -score))
    return sorted(out)


def got(spark, rows, parts=3, **params):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, **params).collect())


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"{c}{k}" for c in ("a", "É", "B", "日") for k in range(6)]
    fixed = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4, 5, 7]))] for _ in range(8)]
    rows = []
    for _ in range(size):
        words = []
        for _ in range(rng.randrange(12)):
            words += rng.choice(fixed) if rng.random() < .5 else [rng.choice(vocabulary)]
            words.append(rng.choice(["", "", "", ".", "\n", "\t", "; x"]))
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("seed,params", [(1, {}), (2, {"least": 5}), (3, {"least": 3, "most": 5}), (4, {"least": 4, "top": 7, "covered": 50})])
def test_matches_brute_force(spark, seed, params):
    rows = corpus(seed, 300)
    expected = plain(rows, **params)
    assert expected and got(spark, rows, **params) == expected


@pytest.mark.parametrize("tokens,bits", [(50, 64), (1, 1 << 20)])
def test_small_parts_and_a_full_table(spark, tokens, bits):
    """Many flushes of a task, and a table of bits that lets everything through."""
    rows = corpus(5, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(tuple(r) for r in collocations.phrase_counts(df, 6).collect())
    assert one and sorted(tuple(r) for r in collocations.phrase_counts(df, 6, tokens=tokens, bits=bits).collect()) == one


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 10)
    text = b"One two. three, four five six seven!eight nine. ten"
    got = [[w for w in part if w] for part in collocations._pieces(text)]
    assert len(got) > 2
    assert [w for part in got for w in part] == text.lower().translate(bytes.maketrans(b".,!", b"\xff" * 3)).replace(b"\xff", b" \xff ").split()
    assert all(part[-1] == b"\xff" for part in got[:-1])


def test_what_is_open_is_carried_over_partitions():
    a, ab, abc = ("en", "a"), ("en", "a", "b"), ("en", "a", "b", "c")
    ends = [(0, a, 9), (0, ab, 5), (2, abc, 3), (3, ("en", "b"), 7)]
    carried = collocations._carried(ends)
    assert carried[0] == []
    assert carried[2] == [(a, 9), (ab, 5)]
    assert carried[3] == [(a, 9), (ab, 5), (abc, 3)]
    assert collocations._opened(carried[3], ("en", "a", "b", "d")) == [(a, 9), (ab, 5)]
    assert collocations._opened(carried[3], ("en", "b")) == []


def test_hot_first_word_over_many_ranges(spark):
    """A third of all phrases start with one word: its range is cut."""
    rng = random.Random(8)
    rows = [(f"hot w{rng.randrange(40)} hot x{rng.randrange(5)}", "en") for _ in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows, least=10) == plain(rows, least=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    rows = [(None, "en"), ("", "en"), (" \t\n..", None), *[("One two THREE", None)] * 40, *[("two three", "und")] * 7, ("a b " * 50_000, "x")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(None, None)]) == []
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_and_extra_columns(spark):
    rows = spark.createDataFrame([("a b", "en", "q", 1)] * 30, "Text string, LANG string, phrase string, n int")
    assert [tuple(r) for r in collocations.collocations(rows).collect()] == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_a_task_holds_numbers_of_its_phrases_only():
    """Hundreds of thousands of unlike phrases: their texts are spelled out some at once."""
    rng = random.Random(9)
    words = [f"word{rng.randrange(3000):06d}".encode() for _ in range(200_000)]
    everything = np.full(1 << 10, np.uint64(2 ** 64 - 1))
    for count in (collocations._hash_counts, lambda g: collocations._phrases(g, everything, 4)):
        g = collocations.Gathered("en")
        g.add(words)
        g.add([collocations._END])
        tracemalloc.start()
        rows = sum(batch.num_rows for batch in count(g))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows > 190_000 and peak < 100 * len(words)


def test_a_place_gives_one_row():
    everything = np.full(1 << 10, ~np.uint64(0))
    held = collocations.Gathered("en")
    words = [b"w%d" % i for i in range(300)]  # every phrase occurs once
    held.add(words)
    held.add([b"\xff"])
    rows = [r for batch in collocations._phrases(held, everything, 4) for r in batch.to_pylist() if r["k"] > 1]
    assert len(rows) == 299 and sum(r["n"] for r in rows) == 299  # there were 896: all pairs, threes and fours
    assert [r["phrase"] for r in rows if r["k"] < 4] == ["w298 w299", "w297 w298 w299"]


def test_counts_of_phrases_that_longer_ones_begin_with(spark):
    rows = [("a b c d", "en")] * 3 + [("a b c", "en"), ("a b\x01 c", "en"), ("a b", "en"), ("a b. c d", "en")]
    got_ = {r.phrase: r.n for r in collocations.phrase_counts(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got_ == {"": 24, "a": 7, "b": 6, "c": 6, "d": 4, "b\x01": 1, "a b": 6, "b c": 4, "c d": 4, "a b\x01": 1, "b\x01 c": 1,
                    "a b c": 4, "b c d": 3, "a b\x01 c": 1, "a b c d": 3}
