import random

import pytest

from haze.llm import queries, substring_dedup
from tests.llm.brute import BLANK_WORD

SCHEMA = "doc_id bigint, text string"


def plain(rows, n):
    """(doc_id, n_words, n_removed, longest, text) of every row, by all windows of every length."""
    docs = [(i, BLANK_WORD.findall(t or ""), t) for i, t in rows]

    def least(length):
        out = {}
        for i, w, _ in docs:
            if i is not None:
                for k in range(len(w) - length + 1):
                    key = tuple(w[k:k + length])
                    out[key] = min(out.get(key, i), i)
        return out

    result, tables, length = [], [], n
    while any(len(w) >= length for _, w, _ in docs):
        tables.append((length, least(length)))
        length *= 2
    for i, w, t in docs:
        gone, longest = set(), 0
        for length, table in tables:
            for k in range(len(w) - length + 1):
                if i is not None and table[tuple(w[k:k + length])] < i:
                    longest = max(longest, length)
                    if length == n:
                        gone.update(range(k, k + n))
        kept = None if t is None else " ".join(x for k, x in enumerate(w) if k not in gone)
        result.append((i, len(w), len(gone), longest, kept))
    return sorted(result, key=repr)


def got(spark, rows, n):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), n, longest=True).collect()), key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 13, 14, 27, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(size):
        words = []
        for _ in range(rng.choice([0, 1, 2, 5])):
            words += [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 6, 30]))]
            if rng.random() < .6:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a:] if rng.random() < .5 else p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(size + k, rows[rng.randrange(size)][1]) for k in range(size // 4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,seed", [(13, 1), (13, 2), (5, 3), (2, 4), (1, 5)])
def test_matches_brute_force(spark, n, seed):
    rows = corpus(seed, 60)
    out = got(spark, rows, n)
    assert out == plain(rows, n)
    assert any(r[2] for r in out) and any(not r[2] for r in out)


def test_edges(spark):
    a = " ".join(f"a{k}" for k in range(20))
    rows = [(3, a), (3, a), (3, f"x {a}"), (5, a), (None, a), (None, None), (7, None), (8, ""), (9, " \n "), (10, "a0 a1"),
            (11, a.upper()), (12, f"{a} {a}"), (-4, "b " * 40), (2, "b " * 13)]
    assert got(spark, rows, 13) == plain(rows, 13)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text_and_a_group_of_copies(spark):
    rng = random.Random(6)
    long = [str(rng.randrange(10 ** 9)) for _ in range(30_000)]
    shared = " ".join(long[500:620])
    rows = [(0, " ".join(long)), (1, " ".join(long[7:])), *((k, f"{k} {shared}") for k in range(2, 400)), (400, "own words only")]
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), longest=True).collect()}
    assert out[0].n_removed == 0 and out[0].longest == 0
    assert out[1].n_removed == 30_000 - 7 and out[1].longest == 13 << 11 and out[1].text == ""
    assert all((out[k].n_removed, out[k].text, out[k].longest) == (120, str(k), 104) for k in range(2, 400))
    assert out[400].n_removed == 0


def test_clashing_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 7, "z"), (2, "x a b c", 8, "z")], "DOC_ID int, Text string, key int, h string")
    out = substring_dedup.remove_repeats(rows, 3).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in out) == [(1, 0, "a b c"), (2, 3, "x")]


def test_query_doubles_until_no_candidate_is_left(spark, tmp_path, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage), (2, f"a {passage} b"), (3, " ".join(f"p{k}" for k in range(13, 33)) + " c")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    lengths, covered, ended = [], {}, substring_dedup._ended

    def watched(repeats, length):
        lengths.append(length)
        out = ended(repeats, length)
        covered[length] = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in out.where("size(spans) > 0").collect())
        return out

    monkeypatch.setattr(substring_dedup, "_ended", watched)
    out = {r.doc_id: (r.n_words, r.n_removed) for r in queries.QUERIES["op13_substring_dedup"](spark, str(tmp_path)).collect()}
    assert lengths == [13, 26, 52]
    # no level covers all: words go with the windows that the next level doesn't join
    assert covered == {13: [(3, [(0, 20)])], 26: [(2, [(10, 52)])], 52: [(2, [(1, 61)])]}
    assert out == {1: (60, 0), 2: (62, 60), 3: (21, 20)}


def test_words_of_a_slice_are_hashed_at_once():
    texts = ["a B  b", "", " \n", "É x" * 2, "tail " + "y" * 5000]
    words, ends = substring_dedup._words([t.encode() for t in texts])
    own = [t.split() for t in texts]
    assert [int(j - i) for i, j in zip(ends[:-1], ends[1:])] == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    assert all((words[i] == words[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    at, row = substring_dedup._whole(ends, 2)
    assert [(int(a - ends[r]), int(r)) for a, r in zip(at, row)] == [(k, r) for r, w in enumerate(own) for k in range(len(w) - 1)]
    assert len(substring_dedup._whole(ends, 50)[0]) == 0
