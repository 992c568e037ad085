"""Corpus pipeline over ``documents``: language ID, line dedup, near-duplicate join, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next one's docs.

1. language_id: rows without letters or without a likely language go.
2. line_dedup: boilerplate lines of a site go from its texts; ``n_chars`` follows. Near copies vote about once,
   so that they don't vote their own lines out.
3. ngram_join: of documents that five-word shingles link at a Jaccard similarity
   of 0.8 or more, the one with the least id stays.
4. decontaminate: documents that hold a benchmark window of ten words go.
5. byte_bpe: token ids of every text, and digests of the ids and of what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from haze.llm.common import table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Near copies: five-word shingles at a Jaccard similarity of 0.8.
#: Pre-tokens that a worker remembers: fewer than in a job of its own, as workers stay for the other stages.
REMEMBERED = 100_000
NEAR = {"n": 5, "p": 80, "q": 100}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, near=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, remembered=REMEMBERED)


STAGES = [("language_id", identify_language), ("line_dedup", drop_boilerplate), ("ngram_join", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("byte_bpe", tokenize)]

#: SQL can't express the language model, the merges of the tokenizer or the connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
