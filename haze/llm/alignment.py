"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, by an associative fragment monoid.

Byte offsets where tokens of A and of B both end cut a text into groups. A
fragment is what a byte range of a text yields: an open prefix (tokens up to
the first common end), closed groups, and an open suffix (tokens after the
last common end). Two neighbours compose: the suffix of the left one and the
prefix of the right one close a group between them. Composing is associative, so
fragments may be made anywhere and composed in any tree:

- A text up to CHUNK bytes is composed in one task of fragments by word: no token of either
  tokenizer goes from a character that isn't white space into a space, so the text between two such
  places is closed at both ends. The fragments of words are remembered.
- Longer texts are cut into byte ranges of CHUNK bytes, wherever they fall. Each range is a row of its own, with
  the rest of the words at its edges, so that these can be encoded; its fragment takes the tokens
  that end in the range. Rounds of FAN neighbours compose them across tasks until one is left for each text.

A link is a pair of an A and a B token whose byte ranges overlap: there is
one for each stretch between two ends. Pairs of ids are counted over all texts in three steps:
the texts of a task are packed into slices of at most ENTRIES distinct pairs of a text, each
slice lists its distinct pairs with their counts; these are added up by pair;
and the sums go back to the slice that lists the pair, which gives every text its figures. So a pair that all
texts have is one row for each slice, and no table of pairs is broadcast.

Rows: one per input row. Texts that are null or empty, or whose tokens of A or B don't join to the
bytes of a space and the text, have no tokens: zeros and empty groups. Repeated rows are
counted each time and give repeated results; null ids stay null; ties for the best are all best; a word
longer than CHUNK is not cut; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import SLICE_BYTES, arrow_map, pick, release, step

#: Bytes of a range of a long text.
CHUNK = 1 << 16
#: Neighbours that one task composes.
FAN = 8
#: Distinct pairs, by text, of a slice.
ENTRIES = 1_000_000
#: Words whose fragments one Python worker remembers in each of two generations, and their characters.
REMEMBERED, REMEMBERED_CHARS = 90_000, 3_000_000
#: Bits of the id of A in a pair.
SHIFT = 24
_LOW = (1 << SHIFT) - 1
#: A space that nothing which goes on before it is cut by: after a character that isn't white space, not at the end.
_CUT = re.compile(r"(?<=\S) (?= *\S)")
_ODD = re.compile(r"\s | \Z|\A ")


def units(text: str) -> list[str]:
    """The words of a text, as cut at such spaces, each without the space that it starts with."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Closed(NamedTuple):
    """Groups that are closed at both ends: their text (each ends in ``;``), the pairs of their links, tokens of A."""

    text: str
    pairs: bytes
    n_a: int


class Aligner:
    """Both tokenizers; one for each Python worker."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        by_char = _byte_characters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(by_char[c] for c in entry) if all(c in by_char for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B has pieces that go on after a word: texts can't be cut at spaces")
        # names of the ids of A, then of B, each followed by what parts tokens of a group and by what ends them
        self.names = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]
        self.remembered: dict[str, Closed | None] = {}
        self.older: dict[str, Closed | None] = {}
        self.chars = 0

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A and B of each word with the space before it, and whether both join to its bytes."""
        spaced = [" " + w for w in words]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        good = [(own := w.encode()) == b"".join(map(self.a_bytes.__getitem__, x)) and own == b"".join(map(self.b_bytes.__getitem__, y))
                for w, x, y in zip(spaced, a, b)]
        return a, b, good

    def closed(self, a: list[list[int]], b: list[list[int]]) -> list[Closed]:
        """The groups of each pair of token lists that join to the same bytes."""
        na, nb = [*map(len, a)], [*map(len, b)]
        ids_a, ids_b = (np.fromiter((i for x in lists for i in x), np.int64, sum(n)) for lists, n in ((a, na), (b, nb)))
        if not len(ids_a):
            return [Closed("", b"", 0)] * len(a)
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        b_of_a, a_of_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)  # the token where a token ends
        last_a, last_b = ends_b[b_of_a] == ends_a, ends_a[a_of_b] == ends_b
        stop_a, stop_b = np.nonzero(last_a)[0] + 1, np.nonzero(last_b)[0] + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.r_[0, stop_b][group_a]] = ids_a * 2 + last_a
        order[np.arange(len(ids_b)) + stop_a[group_b]] = (ids_b + len(self.a_bytes)) * 2 + last_b
        names = [*map(self.names.__getitem__, order.tolist())]
        # one link for each end: those of A, then those of B that aren't ends of A; by place in the text
        inner = np.nonzero(~last_b)[0]
        pairs = np.concatenate([ids_b[b_of_a] << SHIFT | ids_a, ids_b[inner] << SHIFT | ids_a[a_of_b[inner]]])
        place = np.argsort(np.concatenate([ends_a, ends_b[inner]]), kind="stable")
        pairs = pairs[place]
        cut_a, cut_b = np.cumsum([0, *na]), np.cumsum([0, *nb])
        cut = (cut_a + cut_b).tolist()
        links = (cut_a + cut_b - np.r_[0, stop_a.searchsorted(cut_a[1:], "right")]).tolist()
        return [Closed("".join(names[cut[i]:cut[i + 1]]), pairs[links[i]:links[i + 1]].tobytes(), n) for i, n in enumerate(na)]

    def learn(self, words: set[str]) -> None:
        """Makes sure that the fragments of these words are remembered."""
        if len(self.remembered) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.older, self.remembered, self.chars = self.remembered, {}, 0
        absent = words - self.remembered.keys()
        again = absent & self.older.keys()
        self.remembered.update(zip(again, map(self.older.__getitem__, again)))
        new = [*(absent - again)]
        a, b, good = self.encode(new)
        none: list[int] = []
        found = self.closed([x if g else none for x, g in zip(a, good)], [y if g else none for y, g in zip(b, good)])
        self.remembered.update(zip(new, (c if g else None for c, g in zip(found, good))))
        self.chars += sum(map(len, absent))


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: itself if it is printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    return Aligner(a_file, b_file)


# ------------------------------------------------------------------ fragments of byte ranges
class Fragment(NamedTuple):
    """``head`` and ``tail`` are open; without a common end (``cut``) all tokens are in ``head``."""

    good: bool
    cut: bool
    head_a: list[int]
    head_b: list[int]
    text: str
    pairs: list[int]
    times: list[int]
    n_a: int
    tail_a: list[int]
    tail_b: list[int]


_FRAGMENT = ("good boolean, cut boolean, head_a array<int>, head_b array<int>, text string, pairs array<bigint>, times array<bigint>, "
             "n_a bigint, tail_a array<int>, tail_b array<int>")
BAD = Fragment(False, False, [], [], "", [], [], 0, [], [])


def summed(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(pairs, return_counts=True)
    own, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, at, times)
    return own, out


def fragment(own: Aligner, piece: str, low: int, high: int) -> Fragment:
    """That of the bytes from ``low`` to ``high`` of a space and ``piece``, whose edges are edges of words: the tokens that end there."""
    a, b, good = own.encode(units(piece))
    if not all(good):
        return BAD
    sides = []
    for lists, sizes in ((a, own.a_size), (b, own.b_size)):
        ids = np.array([i for x in lists for i in x], np.int64)
        ends = np.cumsum(sizes[ids])
        here = (ends > low) & (ends <= high)
        sides.append((ids[here], ends[here]))
    (ids_a, ends_a), (ids_b, ends_b) = sides
    common = np.intersect1d(ends_a, ends_b)
    if not len(common):
        return Fragment(True, False, ids_a.tolist(), ids_b.tolist(), "", [], [], 0, [], [])
    (i, j), (k, m) = ((np.searchsorted(e, common[0], "right"), np.searchsorted(e, common[-1], "right")) for e in (ends_a, ends_b))
    middle = own.closed([ids_a[i:j].tolist()], [ids_b[k:m].tolist()])[0]
    pairs, times = summed(np.frombuffer(middle.pairs, np.int64))
    return Fragment(True, True, ids_a[:i].tolist(), ids_b[:k].tolist(), middle.text, pairs.tolist(), times.tolist(), middle.n_a,
                    ids_a[j:].tolist(), ids_b[m:].tolist())


def compose(own: Aligner, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not (x.good and y.good):
        return BAD
    if not x.cut:
        return y._replace(head_a=x.head_a + y.head_a, head_b=x.head_b + y.head_b)
    if not y.cut:
        return x._replace(tail_a=x.tail_a + y.head_a, tail_b=x.tail_b + y.head_b)
    between = own.closed([x.tail_a + y.head_a], [x.tail_b + y.head_b])[0]
    more = np.frombuffer(between.pairs, np.int64)
    pairs, times = summed(np.concatenate([np.array(x.pairs, np.int64), more, np.array(y.pairs, np.int64)]),
                          np.concatenate([np.array(x.times, np.int64), np.ones(len(more), np.int64), np.array(y.times, np.int64)]))
    return Fragment(True, True, x.head_a, x.head_b, x.text + between.text + y.text, pairs.tolist(), times.tolist(),
                    x.n_a + between.n_a + y.n_a, y.tail_a, y.tail_b)


#: A text: id, groups, distinct pairs and their counts, tokens of A.
Document = tuple[int | None, str, np.ndarray, np.ndarray, int]
_NOTHING = np.empty(0, np.int64)


def finished(own: Aligner, x: Fragment) -> tuple[str, np.ndarray, np.ndarray, int]:
    """That of a whole text: its start closes the head, its end is common."""
    if not x.good or x.tail_a or x.tail_b or not x.cut:
        return "", _NOTHING, _NOTHING, 0
    first = own.closed([x.head_a], [x.head_b])[0]
    more = np.frombuffer(first.pairs, np.int64)
    pairs, times = summed(np.concatenate([more, np.array(x.pairs, np.int64)]), np.concatenate([np.ones(len(more), np.int64), np.array(x.times, np.int64)]))
    return first.text + x.text, pairs, times, first.n_a + x.n_a


def ranges(words: list[str], chunk: int) -> Iterator[tuple[str, int, int]]:
    """(piece, low, high) of the byte ranges of a text: the words that a range touches, and the range within their bytes."""
    starts = np.cumsum([0, *(1 + len(w.encode()) for w in words)])
    at = 0
    while at < starts[-1]:
        stop = min(at + chunk, int(starts[-1]))
        k = int(np.searchsorted(starts, stop, "left"))
        if starts[k] - starts[k - 1] > chunk:  # a word that is longer than a range isn't cut
            stop = int(starts[k])
        first, last = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, stop, "left"))
        yield " ".join(words[first:last]), at - int(starts[first]), stop - int(starts[first])
        at = stop


# ------------------------------------------------------------------ jobs
_TEXTS = ("slice bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, at array<int>, "
          "times array<int>, pairs array<bigint>, sums array<bigint>")


def _ragged(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *(0 if x is None else len(x) for x in arrays)]).astype(np.int32))
    values = pa.array(np.concatenate([*(x for x in arrays if x is not None), _NOTHING]).astype(kind.to_pandas_dtype()))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in arrays]))


def _slices(documents: Iterable[Document], tag: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _TEXTS: texts with the places of their pairs in the list of their slice; that list is the row whose ``pairs`` isn't null."""
    held: list[tuple] = []
    size, n = 0, 0

    def packed() -> pa.RecordBatch:
        key = tag << 20 | n
        pairs, sums = summed(np.concatenate([_NOTHING, *(d[2] for d in held)]), np.concatenate([_NOTHING, *(d[3] for d in held)]))
        rows = []
        for doc_id, groups, own, times, n_a, commas, n_groups in held:
            n_b = commas + 2 * n_groups - n_a  # a comma between the tokens of a side
            rows.append((doc_id, n_a, n_b, n_groups, n_a + n_b - n_groups, groups, np.searchsorted(pairs, own), times))
        rows.append((None, None, None, None, None, None, None, None))
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * len(rows), pa.int64()), *numbers, pa.array([r[5] for r in rows], pa.string()),
             _ragged([r[6] for r in rows], pa.int32()), _ragged([r[7] for r in rows], pa.int32()),
             _ragged([None] * len(held) + [pairs], pa.int64()), _ragged([None] * len(held) + [sums], pa.int64())],
            names=[c.split()[0] for c in _TEXTS.split(", ")])

    for doc_id, text, pairs, times, n_a in documents:
        shown = text[:-1]
        if digest and shown:
            shown = hashlib.sha256(shown.encode()).hexdigest()
        held.append((doc_id, shown, pairs, times, n_a, text.count(","), text.count(";")))
        size += len(pairs)
        if size >= ENTRIES or len(held) >= 20_000:
            yield packed()
            held, size, n = [], 0, n + 1
    if held:
        yield packed()


def _documents(own: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[Document]:
    for batch in batches:
        width = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, width):
            part = batch.slice(i, width)
            words = [units(t) if t else None for t in part.column(1).to_pylist()]
            own.learn({w for x in words if x for w in x})
            for doc_id, mine in zip(part.column(0).to_pylist(), words):
                found = [*map(own.remembered.__getitem__, mine)] if mine else [None]
                if None in found:
                    yield doc_id, "", _NOTHING, _NOTHING, 0
                else:
                    pairs, times = summed(np.frombuffer(b"".join([c.pairs for c in found]), np.int64))
                    yield doc_id, "".join([c.text for c in found]), pairs, times, sum([c.n_a for c in found])


def _aligned(rows: DataFrame, files, digest: bool) -> DataFrame:
    """_TEXTS of the short texts (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from _slices(_documents(aligner(*files.value), batches), TaskContext.get().partitionId(), digest)

    return rows.mapInArrow(run, _TEXTS)


def _fragments(rows: DataFrame, files, chunk: int) -> DataFrame:
    """(row, doc_id, seq, fragment...) of the byte ranges of the long texts, dealt out by range."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            row = uuid.uuid4().hex  # fixed by the table that is written next
            parts = [*ranges(units(text), chunk)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()),
                                              *(pa.array([p[i] for p in parts], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64())))],
                                             names=["row", "doc_id", "seq", "piece", "low", "high"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        yield _fragment_rows([(row, doc_id, seq, fragment(own, piece, low, high))
                              for row, doc_id, seq, piece, low, high in zip(*(c.to_pylist() for c in batch.columns))])

    pieces = step(arrow_map(rows, cut, "row string, doc_id bigint, seq int, piece string, low bigint, high bigint"), "ranges")
    out = step(arrow_map(pieces.repartition("row", "seq"), run, f"row string, doc_id bigint, seq int, {_FRAGMENT}"), "fragments")
    release(pieces)
    return out


def _fragment_rows(rows: list[tuple[str, int | None, int, Fragment]]) -> pa.RecordBatch:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.bool_(), pa.bool_(), ints, ints, pa.string(), longs, longs, pa.int64(), ints, ints]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.int32()),
                                       *(pa.array([r[3][i] for r in rows], k) for i, k in enumerate(kinds))],
                                      names=["row", "doc_id", "seq", *Fragment._fields])


def _composed(fragments: DataFrame, files, fan: int) -> DataFrame:
    """One fragment for each long text: ``fan`` neighbours are composed in each round."""
    schema = f"row string, doc_id bigint, seq int, {_FRAGMENT}"

    def run(rows: pa.Table) -> pa.Table:
        own = aligner(*files.value)
        parts = sorted(rows.drop_columns(["to"]).to_pylist(), key=lambda r: r["seq"])
        whole = reduce(lambda x, y: compose(own, x, y), (Fragment(*(p[f] for f in Fragment._fields)) for p in parts))
        return pa.Table.from_batches([_fragment_rows([(parts[0]["row"], parts[0]["doc_id"], parts[0]["seq"] // fan, whole)])])

    while (fragments.agg(F.max("seq")).first()[0] or 0) > 0:
        to = fragments.withColumn("to", F.floor(F.col("seq") / fan))
        following = step(to.groupBy("row", "to").applyInArrow(run, schema), "composed")
        release(fragments)
        fragments = following
    return fragments


def _long_texts(fragments: DataFrame, files, digest: bool) -> DataFrame:
    """_TEXTS of the long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        documents = ((r["doc_id"], *finished(own, Fragment(*(r[f] for f in Fragment._fields)))) for batch in batches for r in batch.to_pylist())
        yield from _slices(documents, 1 << 30 | TaskContext.get().partitionId(), digest)

    return fragments.mapInArrow(run, _TEXTS)


def _with_counts(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one slice with the figures of their links; ``pairs`` are those that the slice lists."""
    order = np.argsort(pairs.column("pair").to_numpy())
    total = pairs.column("total").to_numpy()[order]
    best = pairs.column("best").to_numpy()[order].astype(np.int64)
    at, times = texts.column("at").combine_chunks(), texts.column("times").combine_chunks()
    many, place, ends = times.flatten().to_numpy().astype(np.int64), at.flatten().to_numpy(), np.cumsum([0, *at.value_lengths().to_pylist()])
    sums = [np.concatenate([[0], np.cumsum(many * x[place])]) for x in (best, total)]
    figures = [pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums]
    return pa.table([*(texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *figures, texts.column("groups")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", digest: bool = False, chunk: int = CHUNK,
          fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text: ``a1,a2|b1;a3|b2,b3``, or its SHA-256
    with ``digest``. ``a_path`` is a byte-level BPE file of the tokenizers library, ``b_path`` a sentencepiece model."""
    spark = docs.sparkSession
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
    files = spark.sparkContext.broadcast(tuple(contents))  # the size of two vocabularies
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    fragments = _composed(_fragments(rows.where(long), files, chunk), files, fan)
    texts = step(_aligned(rows.where(~long), files, digest).union(_long_texts(fragments, files, digest)), "texts")
    release(fragments)
    listed = texts.where("pairs IS NOT NULL").select("slice", F.explode(F.arrays_zip("pairs", "sums")).alias("e"))
    listed = listed.select("slice", F.col("e.pairs").alias("pair"), F.col("e.sums").alias("n"))
    total = listed.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.shiftright("pair", SHIFT))
    total = step(total, "pairs")
    most = F.broadcast(total.groupBy("b").agg(F.max("total").alias("most")))  # a row for each id of B
    known = step(total.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best")), "known")
    release(total)
    answers = listed.select(F.col("slice").alias("part"), "pair").join(known.hint("merge"), "pair")
    own = texts.where("pairs IS NULL").drop("pairs", "sums")
    return own.groupBy("slice").cogroup(answers.groupBy("part")).applyInArrow(
        _with_counts, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
