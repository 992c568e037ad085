import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken
import xxhash

import corpus_pipeline
from haze.llm import language_id, line_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_by_language(spark, rows):
    """Ids that language ID keeps: the fusion again, from the text model's scores."""
    model = language_id.fit_text(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    names = model.languages
    scores = {r[0]: model.text_scores(r[1]) for r in rows}
    said = {d: max(range(len(names)), key=lambda i: s[i]) for d, (s, letters) in scores.items() if letters}
    every, hosts, declared = Counter(), defaultdict(Counter), Counter()
    for d, _, lang, source, _ in rows:
        if d in said:
            every[said[d]] += 1
            hosts[source or ""][said[d]] += 1
            declared[lang, said[d]] += 1
    size, k = len(names), language_id.SMOOTH
    prior = [(1 + every[i]) / (size + sum(every.values())) for i in range(size)]
    total = [sum(c[i] for c in hosts.values()) for i in range(size)]
    above = [(total[i] + k * prior[i]) / (sum(total) + k) for i in range(size)]  # no host has a dot: one suffix
    seen = {(a, i): declared[a, i] + 1 for a in names for i in range(size)}
    kept = set()
    for d, _, lang, source, _ in rows:
        s, letters = scores[d]
        c = hosts[source or ""]
        own = [s[i] + math.log((c[i] + k * above[i]) / (sum(c.values()) + k)) for i in range(size)]
        if lang in names:
            own = [own[i] + math.log(seen[lang, i] / sum(seen[a, i] for a in names)) for i in range(size)]
        top = max(own)
        if letters and 1 / sum(math.exp(x - top) for x in own) >= language_id.LEAST_POSTERIOR:
            kept.add(d)
    return kept


def hashed(family, text):
    """Spark's xxhash64 of a 32-bit integer and a string, or of the string alone."""
    seed = 42 if family is None else xxhash.xxh64_intdigest(family.to_bytes(4, "little"), 42)
    h = xxhash.xxh64_intdigest(text.encode(), seed)
    return h - (1 << 64) if h >> 63 else h


def vote_keys(text):
    windows = re.findall(line_dedup.WINDOW, text, re.ASCII)
    return [min((hashed(k, w) for w in windows), default=None) if windows else hashed(None, text) for k in range(line_dedup.FAMILIES)]


def without_boilerplate(rows, ratio=0.1, least=3):
    pages, on = defaultdict(set), defaultdict(lambda: [set() for _ in range(line_dedup.FAMILIES)])
    for _, text, _, source, _ in rows:
        pages[source].add(text)
        keys = vote_keys(text)
        for line in text.split("\n"):
            if line.strip(" \t\r"):
                for votes, key in zip(on[source, line.strip(" \t\r")], keys):
                    votes.add(key)
    bad = {k for k, v in on.items() if sum(len(x) >= least and len(x) > ratio * len(pages[k[0]]) for x in v) >= 2}
    out = []
    for d, text, lang, source, _ in rows:
        text = "\n".join(x for x in text.split("\n") if (source, x.strip(" \t\r")) not in bad)
        out.append((d, text, lang, source, len(text)))
    return out


def test_every_stage_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "byte_bpe"]

    def run(name):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), SF)
        assert name == "byte_bpe" or out.columns == COLUMNS
        return sorted(tuple(r) for r in out.collect())

    keep = kept_by_language(spark, rows)
    rows = [r for r in rows if r[0] in keep]
    assert run("language_id") == sorted(rows)
    out = run("line_dedup")
    rows = without_boilerplate(rows)
    assert out == sorted(rows)
    out = run("ngram_join")
    parts = brute.jaccard_components([r[:2] for r in rows], 5, 80, 100)
    rows = [r for r in rows if parts[r[0]][1] == r[0]]
    assert out == sorted(rows) and len(rows) < len(parts)
    out = run("decontaminate")
    rows = [r for r in rows if not brute.contaminated(r[1], items)[1]]
    assert out == sorted(rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in stages["byte_bpe"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for d, text, *_ in rows:
        assert got[d].token_ids == library.encode_ordinary(text) and got[d].n_tokens == len(got[d].token_ids)
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {d: r.ids_sha256 for d, r in got.items()}


def test_rows_that_are_odd_pass_through(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    base = [(i, f"the house number {i} and the garden of the old king by the sea are {i * 7} years old", "en", "a", 1) for i in range(20)]
    odd = [(50, None, None, None, None), (51, "", "en", "a", 0), (52, "the house", None, None, None), (None, "the garden of the house", "en", None, 3),
           (1, base[1][1], "en", "a", 1), (53, "?! 12", "en", "a", 5), (54, "the sea " * 100_000, "en", "b", 0)]
    docs = spark.createDataFrame(base + odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, SF)
            n = out.count()
            assert n <= part.count() and (name == "byte_bpe" or out.columns == docs.columns)
    ids = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert ids.count(1) == 1 and 50 in ids and 51 in ids
    assert re.fullmatch(r"[0-9a-f]{64}", corpus_pipeline.tokenize(spark, docs, SF).first().ids_sha256)


def test_groups_of_near_copies_keep_one_whole_text(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts, near = [], []
    for site, others, copies in (("small", 3, 8), ("large", 40, 20)):  # 8 of 11 pages, 20 of 60 pages
        menu = line(4)
        texts += [(f"{menu}\n{line(30)}\n{line(30)}", site) for _ in range(others)]
        whole = [line(25) for _ in range(12)]
        group = []
        for i in range(copies):
            own = list(whole)
            own[i % 12] = own[i % 12] + " " + line(3)
            group.append(len(texts))
            texts.append(("\n".join([menu, *own]), site))
        near.append((group, menu, whole))
    rows = [(i, t, "en", site, len(t)) for i, (t, site) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.drop_boilerplate(spark, docs, SF).cache()
    after = {r.doc_id: r.text for r in out.collect()}
    last = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, out, SF).collect()}
    assert len(after) == len(rows) and all(after.values())
    for group, menu, whole in near:
        for i in group:  # the menu goes, all else stays
            assert after[i] == texts[i][0].removeprefix(menu + "\n")
        kept = [i for i in group if i in last]
        assert kept == group[:1] and last[kept[0]].split("\n")[1:] == whole[1:]
    plain = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert all(len(plain[i]) < len(after[i]) / 4 for group, _, _ in near for i in group)  # without groups the text is lost
