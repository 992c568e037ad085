import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from haze.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.load_ranks(PATH), P.PATTERN)


def test_random_texts_match_the_library(own, library):
    rng = random.Random(5)
    alphabet = "ab \n\t  \x1c\x85\xa0é'sd1２٣中😀!?.,lrevmt\u0558\U0003d000\u1c89\U00011de0"
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        assert own.encode(t).tolist() == library.encode_ordinary(t), repr(t)


def test_long_pretokens_match_the_library(own, library):
    rng = random.Random(6)
    for t in ["a" * 5000, "ab" * 3000, "the" * 4000, "=" * 999, " " * 3000 + "x", "".join(rng.choice("abcdefgh") for _ in range(20_000))]:
        assert own.encode(t).tolist() == library.encode_ordinary(t)
    assert not own.buckets and not any(own.low)


def test_table_matches_the_library_and_round_trips(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = bpe.encode(docs, PATH, P.PATTERN)
    got = {r.doc_id: r.token_ids for r in ids.collect()}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.encode_ordinary(r.text)
        assert back[r.doc_id] == r.text.encode()


def test_defined_cases(spark):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (5, long)]
    ids = bpe.encode(spark.createDataFrame([(*r, 7, "q") for r in rows], SCHEMA + ", token_ids int, TEXT2 string"), PATH, P.PATTERN)
    out = sorted(((r.doc_id or 0, len(r.token_ids)) for r in ids.collect()))
    assert out == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (5, 200_001)]
    back = sorted((r.doc_id or 0, len(r.decoded)) for r in bpe.decode(ids, PATH, P.PATTERN).collect())
    assert back == [(0, 1), (1, 0), (2, 0), (3, 3), (3, 3), (5, 1_000_000)]
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, token_ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(nulls, PATH, P.PATTERN).collect()] == [b""]


def test_query_matches_the_library(spark, library):
    import hashlib

    from haze.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.01").collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
