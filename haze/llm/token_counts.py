"""Edit-aware token counts: pre-token segment trees by document.

A document's pre-tokens are the leaves' entries: each leaf holds up to LEAF
lengths (in characters) and token counts, and two segment trees over the
leaves hold the sums of both. An edit (start, stop, text) is applied by

1. descending the tree of lengths to the first pre-token that can look at a
   changed character: matches look one character past their end at most, so
   all that end before start - 1 stay;
2. matching the pattern anew from there, until a match ends where an old one
   does, past the edit: from there on all is as before;
3. encoding only those matches, replacing the entries, and updating the sums
   on the way from the touched leaves to the root.

The total is the root's sum. Counts are those of ``bpe`` for the whole
edited text; edits of a document are applied in the order of their starts
and must not overlap (one that does is dropped, the earlier one stands).
Offsets are code points of the text before all edits.

Rows: one per input row. A null or empty text has no tokens, and edits can
fill it; null edits are none; an edit past the end appends; repeated rows give repeated
results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.bpe import Codec, codec, load_ranks
from haze.llm.common import arrow_map, pick

#: Pre-tokens of a leaf; one that grows to twice as many makes the tree anew.
LEAF = 64


class Tree:
    """Sums over the leaves: node 1 is the root, the leaves start at ``size``."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.sums = [0] * self.size + values + [0] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def put(self, leaf: int, value: int) -> None:
        i = leaf + self.size
        change = value - self.sums[i]
        while i:
            self.sums[i] += change
            i >>= 1

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds this offset (the last one, past the end) and the sum of all before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if offset >= before + self.sums[i] and self.sums[i + 1]:
                before += self.sums[i]
                i += 1
        return i - self.size, before


def counted(codec: Codec, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token; ids have four bytes."""
    return [n >> 2 for n in map(len, map(codec.remembered.__getitem__, pieces))]


class Counted:
    """A text with its pre-tokens' lengths and token counts."""

    def __init__(self, text: str, codec: Codec):
        self.text, self.codec = text, codec
        self.pattern = codec.pattern(text)
        pieces = self.pattern.findall(text)
        self.encoded = 0  # pre-tokens encoded again by edits
        self._plant([*map(len, pieces)], counted(codec, pieces))

    def _plant(self, lengths: list[int], counts: list[int]) -> None:
        cuts = range(0, len(lengths), LEAF) or range(1)
        self.lengths = [lengths[i:i + LEAF] for i in cuts]
        self.counts = [counts[i:i + LEAF] for i in cuts]
        self.chars = Tree([*map(sum, self.lengths)])
        self.tokens = Tree([*map(sum, self.counts)])

    @property
    def total(self) -> int:
        return self.tokens.sums[1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces text[start:stop] by ``new``."""
        start = min(start, len(self.text))
        stop = min(max(stop, start), len(self.text))
        old_size, text = len(self.text), self.text[:start] + new + self.text[stop:]
        if (pattern := self.codec.pattern(text)) is not self.pattern:  # other tables of letters: all may differ
            fresh = Counted(text, self.codec)
            encoded = self.encoded + sum(map(len, fresh.lengths))
            self.__dict__.update(fresh.__dict__, encoded=encoded)
            return
        # the first pre-token that ends at start - 1 or later
        leaf, at = self.chars.find(max(0, start - 1))
        i = 0
        while i < len(self.lengths[leaf]) and at + self.lengths[leaf][i] < start - 1:
            at += self.lengths[leaf][i]
            i += 1
        if i == 0 and leaf and at >= start - 1:
            # it may end just at the border of two leaves
            leaf -= 1
            while leaf and not self.lengths[leaf]:
                leaf -= 1
            if self.lengths[leaf]:
                i = len(self.lengths[leaf]) - 1
                at -= self.lengths[leaf][i]
        first, head = leaf, i
        # match until a match ends with an old one past the edit
        shift = len(text) - old_size
        old, pieces = at, []  # old: where the old pre-tokens have come to
        position = at
        for m in self.pattern.finditer(text, at):
            pieces.append(m.group())
            position = m.end()
            while old < position - shift and leaf < len(self.lengths):
                if i < len(self.lengths[leaf]):
                    old += self.lengths[leaf][i]
                    i += 1
                else:
                    leaf, i = leaf + 1, 0
            if position >= start + len(new) and old >= stop and old == position - shift:
                break
        else:
            leaf, i = len(self.lengths) - 1, len(self.lengths[-1])
        self.encoded += len(pieces)
        lengths, counts = [*map(len, pieces)], counted(self.codec, pieces)
        rest_l, rest_c = ([], []) if leaf >= len(self.lengths) else (self.lengths[leaf][i:], self.counts[leaf][i:])
        self.text = text
        for k in range(first + 1, min(leaf, len(self.lengths) - 1) + 1):
            self._put(k, [], [])
        self._put(first, self.lengths[first][:head] + lengths + rest_l, self.counts[first][:head] + counts + rest_c)
        if len(self.lengths[first]) > 2 * LEAF:
            self._plant([x for part in self.lengths for x in part], [x for part in self.counts for x in part])

    def _put(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.lengths[leaf], self.counts[leaf] = lengths, counts
        self.chars.put(leaf, sum(lengths))
        self.tokens.put(leaf, sum(counts))


#: Personal data that production texts lose before they are counted: what a text must hold, the pattern, what takes its place.
MASKS = [(re.compile("@"), re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "<email>"),
         (re.compile(r"[0-9]\."), re.compile(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), "<address>"),
         (re.compile("[0-9]{13}"), re.compile(r"\b[0-9]{13,19}\b"), "<number>")]


def masks(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask personal data."""
    return sorted((m.start(), m.end(), new) for sign, pattern, new in MASKS if sign.search(text) for m in pattern.finditer(text))


def in_order(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1])):
        if not out or a >= out[-1][1]:
            out.append((a, max(a, b), new))
    return out


def recount(docs: DataFrame, vocabulary: str, pattern: str, edits: str | None = None, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_reencoded, text): counts before and after the edits, a column of
    array<struct<start, stop, text>>, or those of ``masks`` without one; the edited text."""
    file = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # the size of a vocabulary
    names = {"doc_id": doc_id, "text": text} | ({"edits": edits} if edits else {})

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        out = []
        given = batch.column(2).to_pylist() if edits else [None] * batch.num_rows
        for t, listed in zip(batch.column(1).to_pylist(), given):
            doc = Counted(t or "", own)
            n, pieces = doc.total, sum(map(len, doc.lengths))
            todo = masks(t or "") if not edits else [(e["start"], e["stop"], e["text"] or "") for e in listed or [] if e]
            todo = in_order(todo)
            for a, b, new in reversed(todo):  # from the end, so that offsets hold
                doc.edit(a, b, new)
            out.append((n, len(todo), doc.total, pieces, doc.encoded, doc.text))
        kinds = [pa.int64()] * 5 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                                         names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded", "text"])

    rows = pick(docs, **names).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrow_map(rows, run, "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_pretokens bigint, "
                                "n_reencoded bigint, text string")
