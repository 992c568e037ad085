"""Registered queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm import (alignment, bpe, collocations, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, ngram_join,
                      secret_scan, substring_dedup, token_counts, url_filter)
from haze.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.dedup_lines(docs, with_counts=True)
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


ORACLE["op2_line_dedup"] = line_dedup.oracle_sql()


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("_items").cast("array<string>")))
    hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["first"])
    return rows.select(F.col("_row._c0").alias("doc_id"), F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
                       F.size("_items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                       (F.size("_hits") > 0).alias("contaminated"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join_components(docs, n=4, p=85, q=100).select("doc_id", "n_shingles", "component_id")


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs).select(
        F.col("_row._c0").alias("doc_id"), F.col("_language").alias("language"), F.round("_posterior", 6).alias("posterior"),
        F.col("_letters").alias("n_letters"), F.col("_kept").alias("kept"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _url_oracle() -> str:
    fits = "\n".join(
        f"    WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
        for _, host, path in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    blocked = ", ".join(f"'{host}{path}'" for verdict, host, path in URL_RULES if verdict == "block")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS own FROM a),
c AS (SELECT page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
{fits}
    END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NULL AND host = '' THEN 'block' ELSE 'allow' END AS verdict
FROM d"""


ORACLE["op6_url_filter"] = _url_oracle()


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.recount(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded",
                       F.sha2("text", 256).alias("edited_sha256"))


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op13_substring_dedup"] = substring_dedup.oracle_sql()


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = collocations.oracle_sql()


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")
