import functools
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from haze.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string"


@functools.cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def entry_bytes(entry):
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return bytes(table[c] for c in entry)


def plain(rows):
    """By whole texts and all pairs of tokens near each other."""
    a, b = tokenizers()
    out, links = [], []
    for doc_id, text in rows:
        groups, mine = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [entry_bytes(a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                at_a, at_b, i, j = [], [], 0, 0
                own_a, own_b, end_a, end_b = [], [], 0, 0
                while i < len(ids_a) or j < len(ids_b):
                    if end_a <= end_b and i < len(ids_a):
                        at_a.append((end_a, end_a + len(bytes_a[i]), ids_a[i]))
                        own_a.append(ids_a[i])
                        end_a += len(bytes_a[i])
                        i += 1
                    else:
                        at_b.append((end_b, end_b + len(bytes_b[j]), ids_b[j]))
                        own_b.append(ids_b[j])
                        end_b += len(bytes_b[j])
                        j += 1
                    if end_a == end_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
                for x, y, ida in at_a:
                    mine += [(ida, idb) for u, v, idb in at_b if u < y and x < v]
        out.append((doc_id, groups))
        links.append(mine)
    count = Counter(pair for mine in links for pair in mine)
    best = Counter()
    for (_, idb), n in count.items():
        best[idb] = max(best[idb], n)
    result = []
    for (doc_id, groups), mine in zip(out, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        result.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(mine),
                       sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), text))
    return sorted(result, key=repr)


def got(spark, rows, **params):
    return sorted((tuple(r) for r in alignment.align(spark.createDataFrame(rows, SCHEMA), A, B, **params).collect()), key=repr)


SIGNS = ["word", "Wörter", "naïve", "don't", "<|endoftext|>", "</s>", "<0x41>", "日本語テキスト", "😀👩‍👩‍👧", "▁x", "a b", "1234567", "foo_bar(x);",
         "\n", "\n\n", "\t", "  ", " \n ", "\r\n", "…", "x" * 70, "\x1c", " ", "ﬁ", "é", "\x00", "\u0085", "안녕하세요", "été"]


def corpus(seed, size):
    rng = random.Random(seed)
    rows = [(k, rng.choice([" ", " ", "  ", ""]).join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40)))) for k in range(size)]
    return rows + [(size + k, rows[k][1]) for k in range(0, size, 7)]


@pytest.mark.parametrize("chunk,fan", [(alignment.CHUNK, 8), (40, 2), (7, 3), (1, 8)])
def test_matches_brute_force_at_any_cut(spark, chunk, fan):
    rows = corpus(chunk, 80)
    expected = plain(rows)
    assert any(r[1] for r in expected) and any(r[1] == 0 for r in expected)
    assert got(spark, rows, chunk=chunk, fan=fan) == expected


def test_composing_is_associative():
    with open(A, "rb") as f, open(B, "rb") as g:
        own = alignment.aligner(f.read(), g.read())
    rng = random.Random(3)
    text = " ".join(rng.choice(["naïve", "Wörter", "x" * 30, "日本語テキスト", "antidisestablishmentarianism"]) for _ in range(60))
    parts = [alignment.fragment(own, *r) for r in alignment.ranges(alignment.units(text), 31)]
    assert len(parts) > 20 and any(p.head_a for p in parts) and any(p.tail_a or p.tail_b for p in parts)
    whole = alignment.fragment(own, text, 0, len(text.encode()) + 1)
    for _ in range(5):
        todo = list(parts)
        while len(todo) > 1:
            k = rng.randrange(len(todo) - 1)
            todo[k:k + 2] = [alignment.compose(own, todo[k], todo[k + 1])]
        assert [x.tolist() if hasattr(x, "tolist") else x for x in alignment.finished(own, todo[0])] == [
            x.tolist() if hasattr(x, "tolist") else x for x in alignment.finished(own, whole)]


def test_edges_digest_and_columns(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "   "), (5, "x "), (6, " x"), (7, "x"), (7, "x"), (None, "x"), (8, "\n"), (9, "one word " * 5)]
    assert got(spark, rows) == plain(rows)
    df = spark.createDataFrame([(1, "two words", "z", 3)], "DOC_ID int, Text string, pairs string, slice int")
    row = alignment.align(df, A, B, digest=True).collect()[0]
    assert row.groups == hashlib.sha256(plain([(1, "two words")])[0][-1].encode()).hexdigest()
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_small_slices_give_the_same(spark):
    rows = corpus(9, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=repr) == plain(rows)


def test_long_text_without_spaces(spark):
    rows = [(1, "日本" * 3000 + " " + "語" * 10), (2, "a" * 5000)]
    assert got(spark, rows, chunk=100) == plain(rows)
