"""Line dedup by site-relative frequency: lines that too many pages of one site carry are dropped.

Pages are grouped by site (host). For each line of a site, the number of its
pages that contain the line is divided by the number of all its pages; a
line above the boilerplate ratio, on ``min_pages`` pages or more, goes from
every page of that site. Exact copies of a page count once, so that a group
of copies doesn't turn its own lines into boilerplate.

With ``near`` that holds for near copies too, by votes: a page's windows are the five words
after each sign of punctuation or line end, and its three keys are the least
hashes of its windows by three hash families (the hash of its text if it has none). Pages that share most
of their text share most keys. A line has as many votes in a family as its pages have
different keys, and must pass both bounds in two families of three: one alone
could be ruled by a window of the boilerplate itself, whose hash happens to be the least
on all pages. Of a group of near copies nearly all have the same keys, so they vote about once.

DataFrame functions only. Lines are counted trimmed, by two 64-bit hashes; the
counts are pre-aggregated before every shuffle, so that a site with a third
of all pages is spread by line. The dropped lines of a site are one array of
64-bit hashes, which is bounded: each is on more than ``ratio`` of the site's
pages, so there are fewer than (lines of a mean page / ratio). That table
is written to the shared folder, and the planner, who then knows its size,
broadcasts it if it is small or else joins by site, splitting skewed sites. A
page's own dropped lines are found by a hashed intersection, so that long pages
cost no more for each line than short ones.

Rows: one per input row. A null text stays null and has no lines; blank lines
are never dropped; a null site is a site of its own, the same as the empty
one; repeated rows are copies; an empty table gives an empty one; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haze.llm.common import packed, pick, positions, unpacked, written

#: A line on more than this share of a site's pages is boilerplate.
RATIO = 0.1
#: ... if at least so many pages carry it.
MIN_PAGES = 3
#: The five words after a sign or at the start of a line. Words past 40 characters part windows, so that the search is linear in the text.
WINDOW = r"(?:^|[.,;:!?\n])\s{0,8}+(\S{1,40}+(?:\s{1,8}+\S{1,40}+){4})"
#: Hash families of a page's keys; a line needs the votes of more than half of them.
FAMILIES = 3
#: What is trimmed from a line before it is compared.
BLANKS = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _voters(pages: DataFrame) -> DataFrame:
    """(site, k0, k1, ..., lines) of (site, text), written: a page's keys are found once, not for each line and family."""
    found = pages.withColumn("windows", F.regexp_extract_all("text", F.lit(WINDOW), F.lit(1)))
    none = F.struct(*[F.lit(None).cast("bigint").alias(f"k{k}") for k in range(FAMILIES)])
    least = F.aggregate("windows", none, lambda a, w: F.struct(
        *[F.least(a[f"k{k}"], F.xxhash64(F.lit(k), w)).alias(f"k{k}") for k in range(FAMILIES)]))
    keys = found.select("site", "text", least.alias("keys"))
    filled = F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != "")
    hashed = F.transform(filled, lambda x: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(F.lit(1), x).alias("line2")))
    return written(keys.select("site", *[F.coalesce(F.col(f"keys.k{k}"), F.xxhash64("text")).alias(f"k{k}") for k in range(FAMILIES)],
                               F.array_distinct(hashed).alias("lines")), "voters")


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES, near: bool = False) -> DataFrame:
    """(site, dropped): the keys of the lines to drop, for each site that has any; ``near``: near copies vote once."""
    p = pick(pages, site=site, text=text).where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("site").cast("string"), F.lit("")).alias("site"), "text",
        F.xxhash64("text").alias("p1"), F.xxhash64(F.lit(1), "text").alias("p2"))
    if near:
        votes = [f"k{k}" for k in range(FAMILIES)]
        lines = _voters(p).select("site", *votes, F.inline("lines"))
    else:
        votes = ["p1", "p2"]
        line = p.select("site", *votes, F.explode(_lines(F.col("text"))).alias("x")).withColumn("x", _trimmed(F.col("x"))).where("x <> ''")
        lines = line.select("site", *votes, F.xxhash64("x").alias("line"), F.xxhash64(F.lit(1), "x").alias("line2"))
    lines = lines.distinct()  # copies of a page count once
    total = written(p.select("site", "p1", "p2").distinct().groupBy("site").agg(F.count("*").alias("pages")), "sites")
    counts = [F.count_distinct(k) for k in votes] if near else [F.count("*")]
    on = lines.groupBy("site", "line", "line2").agg(*(c.alias(f"n{i}") for i, c in enumerate(counts)))
    passed = [((F.col(f"n{i}") >= min_pages) & (F.col(f"n{i}") > F.col("pages") * F.lit(ratio))).cast("int") for i in range(len(counts))]
    least = F.greatest(*(F.col(f"n{i}") for i in range(len(counts)))) if len(counts) > 1 else F.col("n0")
    return (on.where(least >= min_pages).join(total, "site").where(2 * sum(passed[1:], passed[0]) > len(counts))
            .groupBy("site").agg(F.collect_list("line").alias("dropped")))


def dedup_lines(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES, with_counts: bool = False, near: bool = False) -> DataFrame:
    """The rows of ``pages`` with the boilerplate lines of their site taken out of ``text``; ``near`` as for
    ``boilerplate``; ``with_counts`` adds ``_n_lines`` and ``_n_dropped`` at the end."""
    names = pages.columns
    bad = written(boilerplate(pages, site, text, ratio, min_pages, near), "boilerplate")
    rows = packed(pages, site=site, text=text).withColumn("site", F.coalesce(F.col("site").cast("string"), F.lit("")))
    rows = rows.join(bad.withColumnRenamed("site", "_site"), F.col("site") == F.col("_site"), "left")
    own = F.array_intersect(F.transform(_lines(F.col("text")), _key), "dropped")
    rows = rows.withColumn("own", F.when(F.col("dropped").isNotNull(), own))
    rest = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col("own"), _key(x)))
    none = F.col("own").isNull() | (F.size("own") == 0)
    kept = F.when(none, F.col("text")).otherwise(F.array_join(rest, "\n"))
    # lines are counted by their ends: a text that lost all its lines is empty, and so is one empty line
    had = F.coalesce(F.size(_lines(F.col("text"))).cast("long"), F.lit(0)) if with_counts else None
    out = rows.withColumn("_kept", kept)
    at = positions(pages, [text])[0]
    if not with_counts:
        return unpacked(out, names, {at: "_kept"})
    left = F.when(none, F.col("_had")).otherwise(F.size(rest).cast("long"))
    out = out.withColumn("_had", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(had))
    out = out.withColumn("_lost", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("_had") - left))
    return out.select(*[F.col("_kept") if i == at else F.col(f"_row._c{i}") for i in range(len(names))],
                      "_had", "_lost").toDF(*names, "_n_lines", "_n_dropped")


def oracle_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL of (doc_id, text, n_lines, n_dropped) over ``documents``."""
    blanks = "' ' || chr(9) || chr(13)"
    return f"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT site, text, trim(u.x, {blanks}) AS line FROM (SELECT DISTINCT site, text, ls FROM p), unnest(ls) AS u(x)),
t AS (SELECT site, count(DISTINCT text) AS pages FROM p WHERE text IS NOT NULL GROUP BY site),
b AS (SELECT site, list(line) AS dropped
      FROM (SELECT site, line, count(*) AS n FROM l WHERE line <> '' GROUP BY site, line) JOIN t USING (site)
      WHERE n >= {min_pages} AND n > CAST(pages AS DOUBLE) * CAST('{ratio}' AS DOUBLE) GROUP BY site),
r AS (SELECT p.*, list_filter(ls, lambda x: NOT list_contains(coalesce(dropped, []), trim(x, {blanks}))) AS rest
      FROM p LEFT JOIN b USING (site))
SELECT doc_id, array_to_string(rest, chr(10)) AS text, coalesce(len(ls), 0) AS n_lines,
       coalesce(len(ls) - len(rest), 0) AS n_dropped
FROM r"""
