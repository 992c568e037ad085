"""Secret scans by dictionary-primed zstandard novelty.

Base spans come from fixed patterns. The method adds spans: a candidate is a
long unbroken string soon after a word that speaks of keys or credentials.
Its novelty is what it adds to the compressed size of its surroundings: the
text around it is compressed with a dictionary of common words of code, once
with and once without the candidate, and the difference is divided by the
candidate's length. Names, paths and repeated values add little; random
strings add most of a byte for each character, and are reported, with or
without digits. Only a candidate's start is bounded; it ends where its
unbroken string does. One that a base span holds whole isn't given again; one
that base spans cover in part is.

Base patterns are matched from left to right over the whole text and matches
that are too short are dropped after that. Offsets are code points, ends
exclusive; a span is that of the whole match.

Rows: one per input row. A null or empty text has no spans; equal strings
are given wherever they stand; repeated rows give repeated results; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, pick

#: The base patterns in their order.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs of 16 and more are all the runs that aren't dropped
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Words that make what follows within REACH characters sensitive.
SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|credential|bearer|authorization|private|signature", re.IGNORECASE | re.ASCII)
REACH = 40
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}")
#: Characters of text before and after a candidate that it is compressed with.
AROUND = 256
#: Compressed bytes that each character must add; random base 64 adds about 0.75, random hexadecimal about 0.5.
NOVELTY = 0.45
#: What compression starts from: common words of code and of configuration.
DICTIONARY = " ".join("""
    import from class def return public private static void const function var let string integer boolean null None true false
    config configuration settings environment variable default value name description version example localhost https http www com
    password secret token key api_key apikey access_key client_id client_secret authorization bearer credential username user login
    self this request response headers content type application json charset utf-8 Content-Type Accept database connection host port
    private_key public_key BEGIN END RSA certificate signature session cookie expires domain path endpoint service account project
    customer order account product invoice address number value index table column row file folder path list item group total amount
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 the and for with that this not are from have you
""".split()).encode()


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def novelty(text: str, start: int, stop: int) -> float:
    """Compressed bytes that text[start:stop] adds to its surroundings, for each of its characters."""
    before, after = text[max(0, start - AROUND):start], text[stop:stop + AROUND]
    size = lambda s: len(_compressor().compress(s.encode()))
    return max(0, size(before + after + text[start:stop]) - size(before + after)) / (stop - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns."""
    low, out = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, novelty) of the strings that the method adds."""
    out, done = [], -1
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))  # the furthest end of the spans up to each
    for word in SENSITIVE.finditer(text):
        at, last = max(word.end(), done), word.end() + REACH + LEAST_CANDIDATE
        # looked for where it may start only, so that a text of many such words is read once; its end is its own
        while found := CANDIDATE.search(text, at, min(len(text), last)):
            start, at = found.start(), CANDIDATE.match(text, found.start()).end()
            done = at
            i = bisect_right(starts, start)
            if i and ends[i - 1] >= at:
                continue  # a base span holds all of it
            if (x := novelty(text, start, at)) >= NOVELTY:
                out.append((start, at, x))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("novelty", pa.float64())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every span by start and kind, with the novelty of its string."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for t in batch.column(1).to_pylist():
            t = t or ""
            base = base_spans(t)
            spans = [(a, k, b, novelty(t, a, b)) for a, k, b in base] + [(a, 3, b, x) for a, b, x in novel_spans(t, base)]
            out.append([{"kind": KINDS[k], "start": a, "stop": b, "novelty": x} for a, k, b, x in sorted(spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_map(rows, run, "doc_id bigint, spans array<struct<kind:string,start:int,stop:int,novelty:double>>")
