import random

from pyspark.sql import functions as F

from haze.llm import language_id

SF = "/root/testdata/sf0.1/documents.parquet"
SCHEMA = "doc_id bigint, text string, lang string, source string"


def test_held_out_accuracy_without_declarations(spark):
    docs = spark.read.parquet(SF)
    train = docs.where("doc_id % 2 = 0")
    held = docs.where("doc_id % 2 = 1").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    out = language_id.identify(held, train).select(
        (F.col("_language") == F.col("_row._c5")).cast("int").alias("right"), "_kept")
    n, right, kept = out.agg(F.count("*"), F.avg("right"), F.avg(F.col("_kept").cast("int"))).first()
    assert n == held.count() and right > 0.98 and kept > 0.99


def test_scores_match_a_plain_version(spark):
    import math
    from collections import Counter

    model = language_id.fit_text(spark.read.parquet(SF).limit(0).union(spark.createDataFrame(
        [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das Haus und der Garten", "de")] * 6)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")))
    assert model.languages == ["de", "en"]

    def grams(t):
        b = [0x20, *(x if x >= 0x80 or 0x61 <= x <= 0x7A else 0x20 for x in t.lower().encode()), 0x20]
        return [((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435761 % 2 ** 32) >> 17 for i in range(1, len(b) - 1)
                if b[i] != 0x20 or (b[i - 1] != 0x20 and b[i + 1] != 0x20)]

    counts = {"en": Counter(), "de": Counter()}
    for t, lang in [("the house and the garden", "en"), ("das Haus und der Garten", "de")]:
        for _ in range(6):
            counts[lang].update(grams(t))
    text = "Über das Haus, and so on: 12!"
    for i, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + 0.05 * language_id.FEATURES
        want = 0.3 * sum(math.log((counts[lang][g] + 0.05) / total) for g in grams(text))
        assert abs(model.text_scores(text)[0][i] - want) < 1e-3
    assert model.text_scores(text)[1] == 18


def test_host_and_declaration_decide_where_the_text_does_not(spark):
    rows = [(i, "the house and the garden of the king", "en", "a.example.com") for i in range(30)]
    rows += [(100 + i, "das Haus und der Garten von dem Herrn", "de", "b.example.de") for i in range(30)]
    rows += [(200, "xq", None, "b.example.de"), (201, "xq", None, "a.example.com"), (202, "xq", "de-AT", None)]
    out = {r.i: r.l for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).select(
        F.col("_row._c0").alias("i"), F.col("_language").alias("l")).collect()}
    assert out[200] == "de" and out[201] == "en" and out[202] == "de"


def test_defined_cases(spark):
    rows = [(i, "the house and the garden", "en", "s") for i in range(8)] + [
        (10, None, "en", "s"), (11, "", None, None), (12, "12 !?", "en", "s"), (13, "the " * 200_000, None, None), (None, "the", "xx", "s")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", _row int, TEXT2 string")
    out = language_id.keep_identified(df)
    assert out.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in out.collect()) == [-1, *range(8), 13]
    assert language_id.keep_identified(df.limit(0)).collect() == []
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(none).count() == len(rows)


def test_every_declared_language_has_a_model_or_the_unknown_class(spark):
    rng = random.Random(3)
    names = [a + b for a in "abcdefgh" for b in "klmnopqr"]  # 64 languages, each of its own syllables
    words = {x: ["".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)] for x in [*names, "zz", "zy", "zx"]}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(30))
    n = {x: 6 if x < "c" else 12 for x in names}
    rows = [(text(x), x, f"h.{x}") for x in names for _ in range(n[x])]
    rare = [(text("zz").upper().replace("A", "ж").replace("E", "щ"), "zz", "h.zz") for _ in range(4)]
    rows += rare + [(rare[0][0], None, "h.zz"), (rare[1][0], None, "h.else")]
    rows += [(text("ak"), None, None), (text("hr"), None, None), (text("bm"), "bm-XX", "h.else")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    model = language_id.fit_text(df)
    assert model.languages == [*names, "und"]
    out = {r.i: (r.l, r.kept) for r in language_id.identify(df).select(
        F.col("_row._c0").alias("i"), F.col("_language").alias("l"), F.col("_kept").alias("kept")).collect()}
    assert len(out) == len(rows)
    want = [r[1] for r in rows[:-5]] + ["zz", "und", "ak", "hr", "bm"]
    assert [out[i] for i in range(len(rows))] == [(x, True) for x in want]


def test_rare_languages_only(spark):
    df = spark.createDataFrame([(1, "the house", "en", "a"), (2, "das Haus", "de", "b"), (3, "das", None, "b"), (4, "12", "en", "a")], SCHEMA)
    out = {r.i: (r.l, r.kept) for r in language_id.identify(df).select(
        F.col("_row._c0").alias("i"), F.col("_language").alias("l"), F.col("_kept").alias("kept")).collect()}
    assert out[1] == ("en", True) and out[2] == ("de", True) and out[3] == ("de", True) and not out[4][1]
