import random

from haze.llm import decontaminate
from tests.llm import brute

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def got(spark, docs, items, **kw):
    rows = decontaminate.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw).collect()
    return [(r._row[0], r._n_words, sum(h.stop - h.first for h in r._hits), set(r._items)) for r in rows]


def fixture(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "x9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(77, None), (78, ""), (79, "!?"), (3, items[3][1])]
    docs = []
    for i in range(120):
        text = [rng.choice(vocabulary + ["other", "Thing"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = (items[rng.randrange(25)][1]).split()
            a = rng.randrange(len(w))
            text[rng.randrange(len(text) + 1):0] = w[a:] if rng.random() < .5 else w
        docs.append((i, "; ".join(text).upper() if i % 3 else " ".join(text)))
    return docs + [(500, None), (501, ""), (501, "")], items


def test_matches_brute_force(spark):
    docs, items = fixture()
    want = [(d, *brute.contaminated(t, items)) for d, t in docs]
    assert got(spark, docs, items) == want
    assert any(x[2] for x in want)


def test_blocks_of_items_give_the_same(spark):
    docs, items = fixture(3)
    want = [(d, *brute.contaminated(t, items)) for d, t in docs]
    assert got(spark, docs, items, block_chars=150) == want


def test_registered_rows_match_brute_force(spark):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").collect()]
    docs, items = [r[:2] for r in read("documents")], read("benchmark")
    assert got(spark, docs, items) == [(d, *brute.contaminated(t, items)) for d, t in docs]


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Start. {item.upper()}, end"), (2, "clean text"), (3, None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", _hits int")
    items = spark.createDataFrame([(1, item), (None, "two words")], ITEMS)
    assert [r[0] for r in decontaminate.remove_documents(df, items).collect()] == [2, 3]
    assert [r.text for r in decontaminate.remove_spans(df, items).collect()] == ["Start. , end", "clean text", None]
    assert decontaminate.remove_documents(df, items).columns == df.columns


def test_empty_tables_long_texts_and_null_items(spark):
    docs = spark.createDataFrame([(1, "a " * 300_000 + "b c d"), (2, "b c d")], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert [len(r._hits) for r in decontaminate.scan(docs, none).collect()] == [0, 0]
    assert decontaminate.scan(docs.limit(0), none).collect() == []
    out = decontaminate.scan(docs, spark.createDataFrame([(None, "b c d")], ITEMS)).collect()
    assert [(r._n_words, len(r._hits), r._items) for r in out] == [(300_003, 1, []), (3, 1, [])]


def test_query_matches_brute_force(spark):
    import hashlib

    from haze.llm.queries import QUERIES

    read = lambda n: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet").collect()]
    docs, items = {r[0]: r[1] for r in read("documents")}, read("benchmark")
    out = QUERIES["op3_decontaminate"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs) and any(r.contaminated for r in out)
    for r in out:
        n, hit, found = brute.contaminated(docs[r.doc_id], items)
        listed = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(listed.encode()).hexdigest()
