"""Benchmark decontamination: a broadcast hash set of normalised item n-grams, scanned for in every text.

Words are runs of letters, digits and everything past U+007F, A-Z
lower-cased. A window is ``n`` consecutive words of an item; an item of fewer
words, but not none, is one window. The windows of a block of items (at most
BLOCK_CHARS characters, checked) are broadcast; a larger benchmark is scanned
for block by block, so that nothing depends on its size. In a task, words
become ids of the block's vocabulary, a rolling hash of every run of ``n``
known words probes a bitmap of the windows' hashes, and each hit is verified
by its words. No shuffle.

Rows: one per input row of documents. Null and empty texts have no words and
no hits; items without words have no windows; repeated items and rows count
as they stand; items with a null id hit words but can't be listed; an empty
benchmark leaves all documents clean; other columns are kept, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, mix, packed, pick, plain_words, positions, unpacked

#: Words of a window.
N = 10
#: Characters of the items that are broadcast at once.
BLOCK_CHARS = 2_000_000
#: Words as characters, for offsets into the text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "_n_words bigint, _hits array<struct<first:int,stop:int>>, _items array<bigint>"
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))


class Windows:
    """The windows of a block of items by length, with a bitmap of their hashes."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], n: int):
        self.ids: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, list[int]]] = {}
        for item, text in items:
            words = plain_words((text or "").encode())
            if not words:
                continue
            own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.uint32)
            length = min(n, len(own))
            windows = self.by_length.setdefault(length, {})
            for i in range(len(own) - length + 1):
                listed = windows.setdefault(own[i:i + length].tobytes(), [])
                if item is not None and item not in listed[-1:]:
                    listed.append(item)
        self.bitmap: dict[int, np.ndarray] = {}
        for length, windows in self.by_length.items():
            bits = np.zeros(1 << max(16, (16 * len(windows)).bit_length()), bool)
            every = np.frombuffer(b"".join(windows), np.uint32).reshape(-1, length)
            bits[self.hashes(every.T, len(windows)) & np.uint64(len(bits) - 1)] = True
            self.bitmap[length] = bits

    @staticmethod
    def hashes(columns, size: int) -> np.ndarray:
        out = np.zeros(size, np.uint64)
        for c in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        return mix(out)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit runs of words (first, stop), items with a window in the text."""
        words = plain_words(text)
        found: set[int] = set()
        if not words or not self.ids:
            return len(words), [], found
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint32, len(words))
        unknown = np.flatnonzero(ids == 0)
        runs = np.diff(unknown, prepend=-1, append=len(ids)) - 1  # known words between unknown ones
        longest = int(runs.max())
        ends: list[tuple[int, int]] = []
        for length, windows in self.by_length.items():
            if longest < length:
                continue
            starts = np.concatenate([np.arange(a, a + r - length + 1) for a, r in
                                     zip(np.concatenate([[0], unknown + 1])[runs >= length], runs[runs >= length])])
            bits = self.bitmap[length]
            probe = self.hashes((ids[starts + j] for j in range(length)), len(starts))
            for p in starts[bits[probe & np.uint64(len(bits) - 1)]].tolist():
                items = windows.get(ids[p:p + length].tobytes())
                if items is not None:
                    found.update(items)
                    ends.append((p, p + length))
        return len(words), merged(ends), found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=2)
def windows_of(items: tuple[tuple[int | None, str], ...], n: int) -> Windows:
    return Windows(items, n)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
           block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items, block by block; the block of an item is set by a hash, their number by the size of the table."""
    items = pick(benchmark, item=item_id, text=text).where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield tuple(sorted(((r[0], r[1]) for r in own.distinct().collect()), key=str))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N, item_id: str = "item_id",
         item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``_row`` of every document with ``_n_words``, ``_hits`` (runs of hit words) and ``_items``."""
    sc = docs.sparkSession.sparkContext
    rows = packed(docs)
    at = positions(docs, [text])[0]
    kind = rows.schema["_row"].dataType.simpleString()
    first = True
    for items in [*blocks(benchmark, item_id, item_text, block_chars)] or [()]:
        shared = sc.broadcast(items)  # at most about block_chars characters

        def run(batch: pa.RecordBatch, first=first, shared=shared) -> Iterator[pa.RecordBatch]:
            own = windows_of(shared.value, n)
            found = [own.scan((t or "").encode()) for t in batch.column(0).field(at).to_pylist()]
            hits, listed = [x[1] for x in found], [x[2] for x in found]
            if not first:
                hits = [merged(a + [(h["first"], h["stop"]) for h in b]) for a, b in zip(hits, batch.column(2).to_pylist())]
                listed = [a.union(b) for a, b in zip(listed, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()),
                 pa.array([[{"first": a, "stop": b} for a, b in h] for h in hits], _HITS),
                 pa.array([sorted(x) for x in listed], pa.list_(pa.int64()))],
                names=["_row", "_n_words", "_hits", "_items"])

        rows = arrow_map(rows, run, f"_row {kind}, {HITS}")
        first = False
    return rows


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """The documents without any window of an item, all columns as they were."""
    return unpacked(scan(docs, benchmark, text, n).where(F.size("_hits") == 0), docs.columns)


def without_runs(text: str, hits: list[dict]) -> str:
    """The text less the characters from the first word of each run to the end of its last."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for h in hits:
        out.append(text[at:words[h["first"]][0]])
        at = words[h["stop"] - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """All documents; from their texts the runs of words that windows of items cover are gone."""
    rows = scan(docs, benchmark, text, n)
    at = positions(docs, [text])[0]
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t if not h else without_runs(t, h) for t, h in zip(batch.column(0).field(at).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_clean"])

    out = arrow_map(rows.select("_row", "_hits"), run, f"_row {kind}, _clean string")
    return unpacked(out, docs.columns, {at: "_clean"})
