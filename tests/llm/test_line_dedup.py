import duckdb

from haze.llm import line_dedup

SCHEMA = "doc_id bigint, text string, source string"


def test_matches_duckdb(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(sf).select("doc_id", "source", "text")
    for ratio in (0.1, 0.02):
        out = line_dedup.dedup_lines(docs, ratio=ratio, with_counts=True)
        a = sorted((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}')")
        b = sorted(con.execute(line_dedup.oracle_sql(ratio)).fetchall())
        assert a == b and sum(x[3] for x in a) > 0


def test_boilerplate_of_a_site_only(spark):
    rows = [(i, f"menu \nown line {i}\n\nfoot", "a") for i in range(10)] + [(20 + i, f"menu\nother {i}" if i == 0 else f"other {i}", "b") for i in range(10)]
    rows += [(40, "menu\nfoot", None), (41, None, "a"), (42, "", "a")]
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", site int").withColumn("SITE2", line_dedup.F.lit(1))
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, ratio=0.3).collect()}
    assert out[3] == "own line 3\n" and out[20] == "menu\nother 0" and out[40] == "menu\nfoot"
    assert out[41] is None and out[42] == ""
    assert line_dedup.dedup_lines(df).columns == df.columns


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "same\npage", "a") for i in range(50)] + [(100 + i, f"page {i}", "a") for i in range(30)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), with_counts=True).collect()
    assert sum(r._n_dropped for r in out) == 0 and sum(r._n_lines for r in out) == 130


def test_empty_table_and_long_text(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "\n".join(f"line {i % 50_000}" for i in range(200_000))
    rows = [(1, long, "a"), (1, long, "a"), (2, "line 7", "a")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_pages=2, with_counts=True)
    got = sorted((r.doc_id, r._n_lines, r._n_dropped) for r in out.collect())
    assert got == [(1, 200_000, 4), (1, 200_000, 4), (2, 1, 1)]


def test_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_near_copies_vote_once_and_need_no_python(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [" ".join(word() for _ in range(12)) + "." for _ in range(20)]
    rows = [(i, "menu\n" + "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(4)), "a") for i in range(30)]
    for i in range(60):  # two of 240 words changed: a shingle similarity above 0.9
        own = [line.split(" ") for line in base]
        for _ in range(2):
            own[rng.randrange(20)][rng.randrange(11)] = word()
        rows.append((100 + i, "\n".join(["menu", *map(" ".join, own)]), "a"))
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, near=True).collect()}
    assert all(out[i] == text.removeprefix("menu\n") for i, text, _ in rows)
    alone = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert len(alone[100]) < len(out[100]) / 2
    plan = line_dedup.dedup_lines(df, near=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_votes_of_odd_texts(spark):
    rows = [(0, None, "a"), (1, "", "a"), (2, "a,b;c" * 200_000, "a"), (3, "x " * 300_000, None), *((10 + i, f"menu\nline {i}", "b") for i in range(5))]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), near=True).collect()}
    assert out[0] is None and out[1] == "" and len(out[2]) == 1_000_000 and len(out[3]) == 600_000 and out[10] == "line 0"
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA), near=True).collect() == []
