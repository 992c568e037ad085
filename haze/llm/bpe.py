"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the pre-token pattern is encoded by itself. Adjacent tokens
whose joined bytes have a merge rank are queued under that rank: a bucket
per rank holds the places (in the linked list of tokens) where the pair
starts, and a two-level bitmap over the ranks gives the lowest non-empty
bucket by find-first-set. Within a bucket the leftmost place goes first. A
place whose pair has changed since it was queued is stale and skipped. The
cost of a pre-token of n bytes is O(n log n) at worst, also for very long ones.
Only pairs that no neighbouring pair precedes are queued; the others can't
be next, and are queued once their neighbour has changed.

Rows: one per input row. A null or empty text has no tokens (an empty
array); a null array decodes to empty bytes. Repeated rows give repeated
results, null ids stay null, an empty table gives an empty one, and other
columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, pick

#: Pre-tokens whose ids one Python worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Code points that Unicode 17 and later call letters or numbers. The regex module may know them
#: already, tiktoken's tables (Unicode 16) don't; in a text that holds one they count as neither.
NEWER_LETTERS = (
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    "\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    "\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    "\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    "\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    "\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F")
NEWER_NUMBERS = "\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
#: Pre-tokens of a text that are encoded at once.
CHUNK = 1 << 16
#: Stands for no rank, past all ranks.
NONE = 1 << 30
BITS = [1 << i for i in range(256)]


def load_ranks(path: str) -> bytes:
    """The rank file as it is: a line for each token, base64 and rank. Its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


class Remembered(dict):
    """Ids of pre-tokens as 32-bit integers, in two generations; a new one starts when the younger is full."""

    def __init__(self, merge, limit: int):
        super().__init__()
        self.merge, self.limit, self.older = merge, limit, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = array("i", self.merge(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder for one vocabulary; one for each Python worker."""

    def __init__(self, rank_file: bytes, pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        # white space is what Unicode calls so; the control characters 1C to 1F aren't
        plain = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        newer = f"[{NEWER_LETTERS}{NEWER_NUMBERS}]"
        exact = plain.replace(r"[^\p{White_Space}\p{L}\p{N}]+", r"(?:\p{NEW}|[^\p{White_Space}\p{L}\p{N}])+")
        exact = exact.replace(r" ?\p{L}+", rf" ?(?:(?!{newer})\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?!{newer})\p{{N}})+")
        if r"\p{" in pattern and any(x not in exact for x in (r"\p{NEW}", rf"(?!{newer})\p{{L}}", rf"(?!{newer})\p{{N}}")):
            raise ValueError("a pattern that this split of newer letters doesn't know")
        self.plain, self.exact = regex.compile(plain), regex.compile(exact.replace(r"\p{NEW}", newer))
        self.newer = regex.compile(newer)
        # the rank queue, empty between pre-tokens: places by rank, and the ranks in use as bits of words of 256
        self.buckets: dict[int, int | list[int]] = {}
        self.low = [0] * ((self.size >> 8) + 1)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        #: rank of two tokens side by side, by their ids, and of two bytes
        self.joined = {a << 20 | b: rank for token, rank in self.ranks.items() for i in range(1, len(token))
                       if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None}
        self.heads = [self.ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)]
        self.remembered = Remembered(self.merge, remembered)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, joined, heads = len(piece), self.joined.get, self.heads
        buckets, low, bit, top = self.buckets, self.low, BITS, 0  # bits of top: the words of low that aren't zero
        ids = [self.byte_ids[b] for b in piece]  # of the token that starts at i
        after = list(range(1, n + 1))  # start of the next token
        before = list(range(-1, n))  # start of the token before
        pair = [heads[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of the pair that starts at i
        pair.append(NONE)
        # A pair next to one that goes first can't be merged before that one has changed it; it is queued then.
        left, due = NONE, []
        for i, rank in enumerate(pair[:-1]):
            if rank < left and rank <= pair[i + 1]:
                due.append(i)
            left = rank
        while True:
            for i in due:
                rank = pair[i]
                held = buckets.get(rank)
                if held is None:  # the usual case: one place for the rank
                    buckets[rank] = i
                    word = rank >> 8
                    low[word] |= bit[rank & 255]
                    top |= bit[word]
                elif held.__class__ is list:
                    heappush(held, i)
                else:
                    buckets[rank] = [held, i] if held < i else [i, held]
            due = []
            if not top:
                break
            # find-first-set: the lowest rank in use, then its leftmost place
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            i = buckets[rank]
            held = None
            if i.__class__ is list:
                held, i = i, heappop(i)
            if not held:
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            middle = after[i]
            right = pair[middle]
            stop = after[i] = after[middle]
            ids[i] = rank
            pair[middle] = NONE
            if stop < n:
                before[stop] = i
                own = joined(rank << 20 | ids[stop], NONE)
                last = pair[stop]
                if last < own and last >= right and last <= pair[after[stop]] if after[stop] < n else False:
                    due.append(stop)
            else:
                own = last = NONE
            pair[i] = own
            first = before[i]
            if first >= 0:
                was = pair[first]
                now = pair[first] = joined(ids[first] << 20 | rank, NONE)
                further = before[first]
                if further >= 0:
                    r = pair[further]
                    if was < r <= now and r < NONE and (r < pair[before[further]] if before[further] >= 0 else True):
                        due.append(further)
                else:
                    r = NONE
                if now < r and now <= own:
                    due.append(first)
            else:
                now = NONE
            if own < now and own <= last:
                due.append(i)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def pattern(self, text: str):
        """The pattern that splits this text as tiktoken's tables would."""
        return self.plain if text.isascii() or not self.newer.search(text) else self.exact

    def encode(self, text: str) -> np.ndarray:
        pattern = self.pattern(text)
        if len(text) < CHUNK:
            return np.frombuffer(b"".join(map(self.remembered.__getitem__, pattern.findall(text))), np.int32)
        pieces = (m.group() for m in pattern.finditer(text))
        parts = []
        while chunk := list(islice(pieces, CHUNK)):
            parts.append(b"".join(map(self.remembered.__getitem__, chunk)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(rank_file, pattern, remembered)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)])))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, token_ids): ids of every whole text, without special tokens."""
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(load_ranks(vocabulary))  # the size of a vocabulary, not of the data

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        arrays = [own.encode(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(arrays)], names=["doc_id", "token_ids"])

    rows = pick(docs, doc_id=doc_id, text=text).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return arrow_map(rows, run, "doc_id bigint, token_ids array<int>")


def decode(rows: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
           token_ids: str = "token_ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the bytes that the ids stand for."""
    file = rows.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    own_rows = pick(rows, **{k: k for k in keep}, _ids=token_ids)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        lists = batch.column(batch.num_columns - 1)
        values = lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        out = [own.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    kinds = dict(own_rows.dtypes)
    return arrow_map(own_rows, run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "decoded binary"]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id",
               with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text encoded, and its ids decoded, in one pass;
    ``with_ids`` adds ``token_ids``; ``remembered`` bounds the memory of a worker, the results are the same."""
    file = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern, remembered)
        arrays = [own.encode(t or "") for t in batch.column(1).to_pylist()]
        decoded = pa.array([own.decode(a) for a in arrays], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(arrays), decoded], names=["doc_id", "token_ids", "decoded"])

    rows = pick(docs, doc_id=doc_id, text=text).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    both = arrow_map(rows, run, "doc_id bigint, token_ids array<int>, decoded binary")
    ids = [F.col("token_ids")] if with_ids else []
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), *ids)
