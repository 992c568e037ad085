import base64
import hashlib
import random
import re

import duckdb
import public_tokenizers as P
import tiktoken

from haze.llm import license_scan, secret_scan, token_counts, url_filter
from haze.llm.bpe import codec, load_ranks
from haze.llm.queries import ORACLE, QUERIES
from tests.llm import brute

SCHEMA = "doc_id bigint, text string"
PATH = P.path("byte_bpe_50k.tiktoken")


# ------------------------------------------------------------------ licenses
def places(text):
    w, out, labels = brute.words(text), [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        out += found
        labels |= {label} if found else set()
    return len(w), len(out), min(out, default=None), max(out, default=None), ",".join(sorted(labels))


def test_license_base_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(-1, "MIT License mit-license\nmit license"), (-2, None), (-3, ""), (-4, "The GENERAL public license; Apache\tLicense"), (-4, "x")]
    df = docs.union(spark.createDataFrame(extra, SCHEMA))
    texts = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    out = sorted(license_scan.scan(df).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    want = sorted(((d, *places(t)) for d, t in texts), key=lambda x: (str(x[0]), x[1]))
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out] == want
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {x for r in out for x in r.labels.split(",")}
    assert {"apache", "gpl", "cc-by-nc"} <= labels


def test_license_text_with_changes_is_found(spark):
    mit = license_scan.TEMPLATES[0][1]
    w = mit.split()
    changed = " ".join([*w[:10], "indeed", *w[10:30], *w[32:]])
    rows = [(1, "intro words " * 50 + changed + " more text"), (1, "intro words " * 50 + changed + " more text"), (2, "free of charge to any person"), (3, " ".join(reversed(w))),
            (4, "a " * 200_000 + mit)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", spans int, KEY string")
    out = sorted(license_scan.scan(df).collect(), key=lambda r: r.doc_id)
    assert [r.labels for r in out] == ["mit", "mit", "", "", "mit"]
    assert out[0].spans[0].first == 100 and out[0].score > 0.9 and out[4].score == 1.0
    assert license_scan.scan(df.limit(0)).collect() == []


# ------------------------------------------------------------------ secrets
def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_secret_base_matches_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", "ſecret", "toKen", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF1234567890", "deadbeef", "0123456789abcdef", "é😀", "x", "_-./+", "secret=", "\n"]
    made = [(10 ** 6 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(400)] + [(-1, None), (-1, "")]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, SCHEMA))
    rows = [tuple(r) for r in df.collect()]
    out = [(r.doc_id, [(s.start, secret_scan.KINDS.index(s.kind), s.stop) for s in r.spans if s.kind != "novel"]) for r in secret_scan.scan(df).collect()]
    assert out == [(d, secrets(t)) for d, t in rows]
    assert any(x for _, x in out)


def test_secret_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op5_secret_scan"](spark, "/root/testdata/sf0.01").collect():
        spans = secrets(docs[r.doc_id])
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_novel_strings_in_sensitive_places(spark):
    key = "gT7vK2mQ9xLw4RzB8nYc"
    rows = [(1, f"the private signing key is {key} and more"), (2, f"the file is {key}"), (3, "customers_and_their_orders_2024 has the key customers_and_their_orders_2024"),
            (4, f"{'private key file and so on ' * 20_000}bearer {key}"), (5, "key " + "z" * 40 + "1")]
    out = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1] == [("novel", 27)] and out[2] == [] and out[3] == [] and out[5] == []
    assert out[4] == [("novel", len(rows[3][1]) - len(key))]
    assert secret_scan.scan(spark.createDataFrame([], SCHEMA + ", spans int")).collect() == []


def test_novel_strings_are_whole(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    long = "".join(rng.choice(letters + "0123456789") for _ in range(9000))
    plain = "".join(rng.choice(letters) for _ in range(32))
    part = "gT7vK2mQ9xLw4Rz_0123456789abcdef_B8nYcPq3"
    rows = [(1, f"private_key = '{long}'"), (2, f"the signing key is {plain}"), (3, f"the signing key is {part}"),
            (4, f"token={long}"), (5, "key " * 200_000 + "." * 100 + long), (6, f"key {'.' * 39}{plain}"), (7, f"key {'.' * 40}{plain}")]
    out = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1] == [("novel", 15, 9015)] and out[2] == [("novel", 19, 51)]
    assert out[3] == [("novel", 19, 19 + len(part)), ("hex", 35, 51)]
    assert out[4] == [("assign", 0, 9006)]
    assert out[5] == [] and out[6] == [("novel", 43, 75)] and out[7] == []


# ------------------------------------------------------------------ urls
def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        own = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), own), re.match(r"[^?#]*", rest[len(own):])[0]
    fits = [(-len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else ("allow" if host else "block")


def test_url_verdicts_match_brute_force(spark):
    rng = random.Random(8)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/"), ("block", "x.org", ""), ("allow", "x.org", "/a"), ("block", "é.net", "/É")]
    hosts = ["com", "example.com", "WWW.Example.COM", "notexample.com", "a.b.net", "net", "x.org", "y.x.org", "É.net", "", "a..com", "com.", "example.com:80"]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', ':/'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/x', '/es/', '/fr/?q', '?a=/en/', '#/en/', '/a/b', '/É'])}" for _ in range(400)]
    urls += [None, "", "no url", "://", "http://a://com/en/", "http://example.com/" + "p" * 500_000]
    rows = list(enumerate(urls))
    for shard in (url_filter.SHARD, 3):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, Host int")
        out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, shard=shard).collect()]
        assert out == [(i, *judged(u, rules)) for i, u in rows]
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow", "block"}
    assert url_filter.judge(df.limit(0), rules).collect() == []


def test_url_query_matches_duckdb(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet')")
    a = sorted(tuple(r) for r in QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.01").collect())
    assert a == sorted(con.execute(ORACLE["op6_url_filter"]).fetchall(), key=lambda r: r[0])


def test_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(url_filter, "digests", lambda s: np.array([len(x) for x in s], np.uint64))
    path = tmp_path / "rules"
    path.write_bytes(url_filter.packed_rules({"aa/": "block", "bb/": "allow", "c/": "block"}))
    strings = ["bb/", "aa/", "dd/", "c/", "long/"]
    assert url_filter.Rules(str(path)).find(url_filter.digests(strings), strings) == [(0, "allow"), (1, "block"), (3, "block")]


# ------------------------------------------------------------------ token counts
def test_edited_counts_match_full_encoding():
    own = codec(load_ranks(PATH), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    alphabet = ["a", "the ", " ", "\n", "  ", "'s", "'", "re", "12", "!", "é", "word ", "\u0558", "don't ", "\t"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    for trial in range(600):
        doc = token_counts.Counted(text := make(40 if trial % 3 else 900), own)
        for _ in range(8):
            a = rng.randrange(len(text) + 2)
            b = a + rng.randrange(6 if rng.random() < .8 else 200)
            new = make(6)
            text = text[:a] + new + text[b:]
            doc.edit(a, b, new)
            assert doc.text == text and doc.total == len(library.encode_ordinary(text)), (text, a, b, new)
            assert [x for part in doc.lengths for x in part] == [len(p) for p in doc.pattern.findall(text)]


def test_recount_of_the_table_and_defined_cases(spark):
    own = codec(load_ranks(PATH), P.PATTERN)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (-3, "mail a.b@c.example.com " * 3000)], SCHEMA))
    texts = [tuple(r) for r in df.collect()]
    out = token_counts.recount(df, PATH, P.PATTERN).collect()
    for (d, t), r in zip(texts, out):
        edited = t or ""
        for a, b, new in reversed(token_counts.in_order(token_counts.masks(edited))):
            edited = edited[:a] + new + edited[b:]
        assert (r.doc_id, r.n_tokens, r.n_tokens_after, r.text) == (d, len(own.encode(t or "")), len(own.encode(edited)), edited)
    some = [r for r in out if 0 < r.n_edits < 10]
    assert some and all(r.n_reencoded < 30 * r.n_edits for r in some)
    given = spark.createDataFrame([(1, "one two", [(0, 3, "three"), (2, 5, "x"), (99, 120, "!")], 1), (2, None, [(0, 0, "new")], 1), (3, "a", None, 1)],
                                  SCHEMA + ", edits array<struct<start:int,stop:int,text:string>>, n_tokens int")
    got = {r.doc_id: (r.text, r.n_edits) for r in token_counts.recount(given, PATH, P.PATTERN, edits="edits").collect()}
    assert got == {1: ("three two!", 2), 2: ("new", 1), 3: ("a", 0)}
    assert token_counts.recount(given.limit(0), PATH, P.PATTERN).collect() == []
