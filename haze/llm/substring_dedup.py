"""Substring dedup by level-wise doubling: words inside passages that an earlier document has are removed.

A window is ``n`` consecutive words. The levels are windows of n / 2 words
(rounded up), n, 2 n, 4 n, ...; only what repeats at one length is extended
to the next, until no candidates survive:

1. Of the windows of n / 2 words in each window of ``n`` words, the one with
   the least hash is its anchor. Equal windows have equal anchors, so only
   anchors, about 4 / n of all positions, are dealt out and counted. An
   anchor of a single text ends there, and with it its windows.
2. The windows of ``n`` words whose anchor survived are compared by 128-bit
   hashes. The least document of each decides: its word sequence also starts in
   a document with a smaller id, for all others that hold it. Of equal texts only
   the one with the least id takes part; the others are covered as a whole.
3. A window of twice the length is a candidate where both its halves have
   survived; its hash comes from theirs, so texts aren't read again. Levels go
   on until no candidate is left. Two halves that both start in earlier documents
   leave their words to the level of twice the length, so that each level covers
   the words of the passages that end at it; the levels together give the words
   that go, and the last of them the length of a document's longest repeat
   (``longest``).

Every shuffle carries hashes and ids that are combined before it. A passage
in a third of all documents is a key with one row for each of its windows and documents; such
keys meet their least document in a plain join, whose skewed partitions Spark
splits. No group is collected: what is gathered is the positions of one document.

Rows: one per input row. A null or empty text has no words; a text of fewer
than ``n`` words has no window and loses nothing; rows that share an id don't
take words from each other, as no id is smaller; a row whose id is null
neither loses nor takes; repeated rows give repeated results; an empty table
gives an empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, mix, pick, release, rolling, step, utf8
from haze.llm.ngram_join import placed_hashes

#: Words of a window.
WORDS = 13
#: Rows of a batch that Python hands back.
BATCH = 200_000

_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _anchors(words: np.ndarray, n: int) -> np.ndarray:
    """The anchor of every window of ``n`` words."""
    half = rolling(words, (n + 1) // 2)
    span = n - (n + 1) // 2 + 1
    if len(half) < span:
        return np.empty(0, np.uint64)
    out = half[:len(half) - span + 1].copy()
    for i in range(1, span):
        np.minimum(out, half[i:i + len(out)], out=out)
    return out


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of these texts one after another, and where each text's own begin and end."""
    starts, words = placed_hashes(b" ".join(texts), False)
    return words, np.r_[0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))]


def _whole(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a window of ``n`` words of one text starts, and the number of that text."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.nonzero(row[:max(0, len(row) - n + 1)] == row[n - 1:])[0]
    return at, row[at]


def _anchor_rows(rows: DataFrame, n: int) -> DataFrame:
    """(anchor, key), once for each text of a slice."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()))
        words, ends = _words([*texts.values()])
        at, row = _whole(ends, n)
        anchors, keys = _anchors(words, n)[at].view(np.int64), np.array([*texts], np.int64)[row]
        first = np.ones(len(anchors), bool)  # neighbours that are equal count once
        first[1:] = (anchors[1:] != anchors[:-1]) | (keys[1:] != keys[:-1])
        anchors, keys = anchors[first], keys[first]
        for i in range(0, len(anchors), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(anchors[i:i + BATCH]), pa.array(keys[i:i + BATCH])], names=["anchor", "key"])

    return arrow_map(rows.select("key", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), run, "anchor bigint, key bigint")


_WINDOWS = "doc_id bigint, key bigint, place int, h bigint, g bigint"


def _batches(doc_id: np.ndarray, key: np.ndarray, place: np.ndarray, h: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _WINDOWS. A place comes as twice itself, and 1 more where both halves of the window have left it their words."""
    columns = [doc_id, key, place.astype(np.int32), h.view(np.int64), g.view(np.int64)]
    for i in range(0, len(place), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + BATCH]) for c in columns], names=["doc_id", "key", "place", "h", "g"])


def _hashes(words: np.ndarray, places: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Two hashes of the windows at these places."""
    for factor in _FACTORS:
        out = np.zeros(len(places), np.uint64)
        for i in range(n):
            out = out * factor + words[places + i]
        yield mix(out)


def _windows(rows: DataFrame, n: int) -> DataFrame:
    """The windows of ``n`` words of (doc_id, key, text, anchors) whose anchor is among those."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        values, alive_ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        words, ends = _words(utf8(batch.column(2)))
        at, row = _whole(ends, n)
        anchors, own = _anchors(words, n)[at], np.searchsorted(row, np.arange(batch.num_rows + 1))
        found = np.zeros(len(at), bool)
        for k, (i, j) in enumerate(zip(own[:-1], own[1:])):
            alive = np.sort(values[alive_ends[k]:alive_ends[k + 1]])
            found[i:j] = alive[np.minimum(np.searchsorted(alive, anchors[i:j]), len(alive) - 1)] == anchors[i:j]
        at, row = at[found], row[found]
        ids, keys = (batch.column(c).to_numpy()[row] for c in (0, 1))
        yield from _batches(ids, keys, (at - ends[row]) * 2, *_hashes(words, at, n))

    return arrow_map(rows, run, _WINDOWS)


#: State of a window: it starts in an earlier document; it is to cover its words; it starts in several documents.
LATER, COVERS, OPEN = 1, 2, 4


#: Places of a row's windows follow each other below this.
_ROW = 1 << 32


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all rows in order: place and _ROW for each row before its own, hash and state; those of repeated rows
    count once."""
    ends = column.offsets.to_numpy()
    place, h = (column.values.field(k).to_numpy()[ends[0]:ends[-1]] for k in (0, 1))
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    codes, at = np.unique(row * (_ROW << 3) + place, return_index=True)
    return codes >> 3, h[at].view(np.uint64), codes & 7


def _pairs(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places have another one ``length`` words later, and where that is."""
    at = np.minimum(np.searchsorted(place, place + length), len(place) - 1)
    both = np.nonzero(place[at] == place + length)[0]
    return both, at[both]


def _doubled(repeats: DataFrame, length: int) -> DataFrame:
    """The windows of twice the length both of whose halves are among the repeats of ``length`` words. Two hashes of 64
    bits, one of each half, make the two of the window, so 128 bits are compared at every level."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place, h, state = _lists(batch.column(2))
        is_open = state & OPEN > 0
        place, h, later = place[is_open], h[is_open], state[is_open] & LATER
        first, second = _pairs(place, length)
        one, two, row, at = h[first], h[second], place[first] // _ROW, place[first] % _ROW
        ids, keys = (batch.column(c).to_numpy()[row] for c in (0, 1))
        yield from _batches(ids, keys, at * 2 + (later[first] & later[second]), mix(one * _FACTORS[0] + two), mix(two * _FACTORS[1] + one))

    return arrow_map(repeats, run, _WINDOWS)


def _repeats(windows: DataFrame, name: str, how: str = "left") -> DataFrame:
    """(doc_id, key, windows): those that start in several documents or have words to cover, as 8 * place + state and the
    hash."""
    least = windows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # both sides are written tables, so that the join splits the windows of a frequent passage
    least = step(least.drop("most"), "least")
    hits = windows.join(least.hint("merge"), ["h", "g"], how)
    later, covers = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)), F.col("place").bitwiseAND(1) == 1
    state = sum(F.when(c, bit).otherwise(0) for c, bit in ((later, LATER), (later | covers, COVERS), (F.col("least").isNotNull(), OPEN)))
    hits = hits.where(F.col("least").isNotNull() | covers)
    place = F.shiftright("place", 1) * 8 + state
    out = step(hits.groupBy("doc_id", "key").agg(F.collect_list(F.struct(place.alias("place"), "h")).alias("windows")), name)
    release(least)
    return out


def _ended(repeats: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, length, spans): whether windows of this length start in an earlier document (else 0), and the words that
    this level covers, as runs of word places: those of windows whose words are not left to the level of twice the length."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place, _, state = _lists(batch.column(2))
        later = np.nonzero(state & LATER)[0]
        covers = state & COVERS > 0
        for half in _pairs(place[later], length):
            covers[later[half]] = False
        own = place[covers]
        apart = np.diff(own) > length  # windows that touch cover one run; rows are further apart
        firsts, stops = own[np.r_[True, apart][:len(own)]], own[np.r_[apart, True][:len(own)]] % _ROW + length
        sizes = np.bincount(firsts // _ROW, minlength=batch.num_rows)
        lengths = np.zeros(batch.num_rows, np.int64)
        lengths[place[later] // _ROW] = length
        spans = pa.StructArray.from_arrays([pa.array((firsts % _ROW).astype(np.int32)), pa.array(stops.astype(np.int32))], names=["first", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), lists],
                                         names=["doc_id", "key", "length", "spans"])

    out = arrow_map(repeats, run, "doc_id bigint, key bigint, length bigint, spans array<struct<first: int, stop: int>>")
    return out.where("length > 0 OR size(spans) > 0")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return pick(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2"), "text")


def _levels(windows: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, longest, spans) by the levels from that of ``windows``, of ``n`` words, on; their table is released."""
    levels, length = [], n
    repeats = _repeats(windows, "repeats", "inner")  # no level before has left words to the first one
    release(windows)
    while True:
        levels.append(step(_ended(repeats, length), "level"))
        windows = step(_doubled(repeats, length), "windows")
        release(repeats)
        if not windows.take(1):
            release(windows)
            break
        repeats, length = _repeats(windows, "repeats"), 2 * length
        release(windows)
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    out = step(found.groupBy("doc_id", "key").agg(F.max("length").alias("longest"), spans.alias("spans")), "spans")
    release(*levels)
    return out


def repeated_spans(docs: DataFrame, n: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, texts): for each text, by its 64-bit hash, that several documents hold or that holds words of an earlier one: an array of
    (key2, first, spans, longest), one entry but for hashes that collide: its second hash, its least document, and for
    that the runs of words covered by windows of earlier ones, in order (those of several levels may overlap), and the
    greatest length of a level at which a window still starts in an earlier one. Documents after the first hold the text as a whole."""
    rows = _keyed(docs, doc_id, text).where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = step(_anchor_rows(rows, n), "anchors")
    often = anchors.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("anchor")
    often = step(often, "often")
    alive = anchors.join(often.hint("merge"), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    first = step(rows.groupBy("key", "key2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "first")
    firsts = first.groupBy("key").agg(F.collect_list("first").alias("firsts"))  # one but for hashes that collide
    # what is alive grows with the documents: it is never broadcast
    alive = step(alive.join(firsts.hint("merge"), "key"), "alive")
    release(anchors, often)
    texts = rows.select("doc_id", "key", "text").join(alive.hint("merge"), "key")
    texts = texts.where(F.array_contains("firsts", F.col("doc_id"))).select("doc_id", "key", "text", "anchors")
    windows = step(_windows(texts, n), "windows")
    release(alive)
    spans = _levels(windows, n)
    found = spans.withColumnRenamed("doc_id", "first")
    rest = first.join(found, ["first", "key"], "left").where("first < last OR spans IS NOT NULL")
    out = step(rest.groupBy("key").agg(F.collect_list(F.struct("key2", "first", "spans", "longest")).alias("texts")), "repeated")
    release(spans, first)
    return out


def remove_repeats(docs: DataFrame, n: int = WORDS, longest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined by one space; a null text stays null. ``longest``
    returns a column of that name too, 0 without repeats; the levels are the same with it and without."""
    found = repeated_spans(docs, n, doc_id, text)
    rows = _keyed(docs, doc_id, text).join(found.hint("merge"), "key", "left")
    own = F.get(F.filter("texts", lambda t: (t["key2"] == F.col("key2")) & (t["first"] <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("own", F.when(F.col("texts").isNotNull(), own)).select(
        "doc_id", "text", (F.col("own.first") < F.col("doc_id")).alias("copy"), "own.spans", "own.longest")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, gone, lengths, kept = [], [], [], []
        columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
        for t, copy, spans, length in zip(batch.column(1).cast(pa.binary()).to_pylist(), *columns):
            words = (t or b"").split()
            size, left, at = len(words), words, 0
            if copy:  # every window starts in the first document with this text
                length, left = 0, [] if size >= n else words
                if size >= n:
                    length = n << (size // n).bit_length() - 1
            elif spans:
                left = []
                for s in spans:
                    left += words[at:s["first"]]
                    at = max(at, s["stop"])
                left += words[at:]
            counts.append(size)
            gone.append(size - len(left))
            lengths.append(length or 0)
            kept.append(None if t is None else b" ".join(left))
        numbers = [pa.array(x, pa.int64()) for x in (counts, gone, lengths)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(kept, pa.binary()).cast(pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "longest", "text"])

    out = arrow_map(rows, run, "doc_id bigint, n_words bigint, n_removed bigint, longest bigint, text string")
    return out if longest else out.drop("longest")


def oracle_sql(n: int = WORDS) -> str:
    """DuckDB SQL of (doc_id, n_words, n_removed, kept_sha256) over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {n - 1}], ' ')) AS id
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM d WHERE len(ws) >= {n})),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY id) AS least FROM t) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range({n}) AS u(j)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d),
k AS (SELECT w.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN c USING (doc_id, i) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
