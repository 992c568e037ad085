"""N-gram Jaccard join by PartEnum signatures.

A document's set is that of its distinct ``n``-word shingles (64-bit hashes);
two documents link when ``q`` * intersection >= ``p`` * union. The method:

1. Sizes are cut into bands [l, floor(l q / p)]; linked sets lie in the same
   or in neighbouring bands, so the instance of a band compares its sets and
   those of the band below. Linked sets of an instance whose largest size is
   r differ in at most k = floor(2 r (q - p) / (q + p)) shingles.
2. The domain of the shingles is cut into parts, by a hash, and subsets of
   the parts are enumerated: for small k pairs of k + 3 parts, else each of
   k + 1 + k / 10 + 3 parts by itself. k differences spoil k parts at most,
   so linked sets agree on all the other parts and share the signatures that
   are made of them: the hash of all that a set has in a subset of parts.
   A signature of fewer than two shingles (for thresholds below 0.83, where
   parts hold fewer: of none) says little. A set that has fewer such weak
   signatures than it must share with any linked set leaves them out; a set
   that has more emits them all. Either way linked sets share one.
3. Equal sets are one class from the start (a digest), so copies never meet.
   Near copies share most of their signatures, so many buckets have the same
   members: of those one stays, as it has all their pairs.
   Signature buckets of up to SMALL classes give all their pairs, buckets of
   up to LARGE are compared as one block (6.).
4. In still larger buckets, pairs need not be similar: their members (all pairs
   of such a bucket are among them) are joined again by their rarest shingles:
   linked sets share one of the n - ceil(n p / q) + 1 shingles of a set that
   come first when ordered by frequency among these members. Keys of up to
   SMALL members give all pairs; larger ones are compared in blocks.
5. Every set has a sketch, the parities of its shingles by hash in about two
   bits for each. Where the parities of two sets differ, the sets do, so sets
   whose sketches differ in more bits than linked sets may differ in
   shingles aren't linked. That leaves few pairs but linked ones.
6. Blocks of large keys give, in the first rounds, a spanning forest of what
   the sketches leave between components as known so far, at most a row for
   each member; in the last round all that is left between components. A pair
   that shares several large keys counts in the least of them only. So a group
   of thousands of near copies doesn't give the square of its size in rows, and
   no link between components is lost.
7. Pairs are checked by their whole sets; links give components.

Rows: one per input row. Null or empty texts have no shingles and are linked
with nothing; a text of fewer than ``n`` words has one shingle, all of them;
repeated rows are copies; rows that share an id are compared by their texts
like others; ids that are null form no least id; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, mix, packed, pick, release, rolling, step, unpacked, written
from haze.llm.components import components

#: Members of a bucket that are compared pair by pair.
SMALL = 32
#: Up to this k, pairs of parts are enumerated.
PAIRS_TO = 4
#: Members of a block of a large key.
BLOCK = 1024
#: Members of a bucket that are compared as they are, in one block.
LARGE = BLOCK
#: Rounds that give forests of the large keys, before the one that gives all that is left.
ROUNDS = 2
#: Keys that are broadcast to what they pick from; more are joined by a shuffle.
FEW = 100_000

#: Bytes that are hashed at once.
CHUNK = 1 << 20
#: Words of up to this many bytes are hashed together.
LONG = 1 << 12
_PARTS_WORDS = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
#: A number of each byte, A-Z lower-cased, and an odd one of each place in a word.
_BYTE = mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_CASED = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(LONG, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: of the sum of its bytes' numbers, each times that of its place."""
    return placed_hashes(text, True)[1]


def placed_hashes(text: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash."""
    data, numbers = np.frombuffer(text, np.uint8), _BYTE if lower else _CASED
    if not len(data):
        return np.empty(0, np.intp), np.empty(0, np.uint64)
    blank = _PARTS_WORDS[data]
    edges = np.nonzero(blank[1:] != blank[:-1])[0] + 1
    edges = np.concatenate([[0] * (not blank[0]), edges, [len(data)] * (not blank[-1])]).astype(np.intp)
    starts, stops = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + CHUNK, side="right")))
        sizes = stops[at:to] - starts[at:to]
        over = np.nonzero(sizes > LONG)[0]
        if len(over) and not over[0]:
            import xxhash

            to = at + 1
            word = text[starts[at]:stops[at]]
            out[at] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
        else:
            if len(over):  # words up to the next long one
                to, sizes = at + int(over[0]), sizes[:over[0]]
            here = slice(starts[at], stops[to - 1])
            own, begins = data[here][~blank[here]], np.cumsum(sizes) - sizes
            place = np.arange(len(own)) - np.repeat(begins, sizes)
            out[at:to] = mix(np.add.reduceat(numbers[own] * _PLACE[place], begins))
        at = to
    return starts, out


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    out = np.sort(rolling(h, min(n, len(h))))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(items: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


@lru_cache(maxsize=100_000)
def band(size: int, p: int, q: int) -> tuple[int, int, int, int, int]:
    """Number of the band of ``size`` and the largest size and k of its instance and of the next one."""
    number, low = 0, 1
    while True:
        high = low * q // p
        if size <= high:
            above = (high + 1) * q // p
            return number, high, 2 * high * (q - p) // (q + p), above, 2 * above * (q - p) // (q + p)
        number, low = number + 1, high + 1


@lru_cache(maxsize=10_000)
def subsets(k: int, loose: bool) -> tuple[int, int, tuple[np.ndarray, np.ndarray] | None]:
    """Number of parts, signatures that sets with k differences share at least, and the pairs of parts enumerated.
    ``loose``: parts hold so few shingles that only empty signatures count as weak."""
    if k <= PAIRS_TO:
        pairs = np.array([*combinations(range(k + 3), 2)])
        return k + 3, 3, (pairs[:, 0], pairs[:, 1])
    parts = k + 1 + (3 * k // 20 + 4 if loose else k // 10 + 3)
    return parts, parts - k, None


def signatures(items: np.ndarray, p: int, q: int) -> np.ndarray:
    """Signatures of one set for the two instances that it belongs to."""
    number, _, k0, _, k1 = band(len(items), p, q)
    loose = 100 * p < 83 * q
    out = []
    values = mix(items)
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.float64), (values >> np.uint64(32)).astype(np.float64)
    for instance, k in ((number, k0), (number + 1, k1)):
        if k == 0:
            continue  # only equal sets can link, and they are one class
        parts, shared, pairs = subsets(k, loose)
        at = (mix(items + np.uint64(0x632BE59BD9B4E019)) % np.uint64(parts)).astype(np.intp)
        count = np.bincount(at, minlength=parts)
        # sums of 32-bit halves are exact in doubles
        total = (np.bincount(at, low, parts).astype(np.uint64) +
                 np.bincount(at, high, parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = np.arange(parts, dtype=np.uint64)
        if pairs is not None:
            a, b = pairs
            count, place = count[a] + count[b], np.arange(len(a), dtype=np.uint64)
            total = mix(total[a]) + np.uint64(3) * mix(total[b])
        own = mix(total + mix(place + np.uint64(instance << 32) + np.uint64(0xD6E8FEB86659FD93)))
        weak = count < (1 if loose else 2)
        out.append(own[~weak] if weak.sum() < shared else own)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash: a power of two of bits, two for each shingle at least, as 64-bit words."""
    bits = max(64, 1 << (2 * len(items) - 1).bit_length())
    odd = np.bincount((mix(items ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, d, sketch) of every row; d is null without shingles."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, ds, sketches = [], [], []
        for t in batch.column(2).cast(pa.binary()).to_pylist():
            s = shingles(t or b"", n)
            sizes.append(len(s))
            ds.append(digest(s) if len(s) else None)
            sketches.append(sketch(s) if len(s) else np.empty(0, np.int64))
        offsets = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sketches, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ds, pa.int64()), lists],
                                         names=["doc_id", "row_key", "n_shingles", "d", "sketch"])

    return arrow_map(docs, run, "doc_id bigint, row_key bigint, n_shingles bigint, d bigint, sketch array<bigint>")


def _signatures(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """(sig, d) of every distinct set of a slice of rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, ds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for t in batch.column(2).cast(pa.binary()).to_pylist():
            s = shingles(t or b"", n)
            if len(s) and (d := digest(s)) not in seen:
                seen.add(d)
                own = signatures(s, p, q)
                sigs.append(own)
                ds.append(np.full(len(own), d, np.int64))
        sig, d = np.concatenate(sigs).view(np.int64), np.concatenate(ds)
        for i in range(0, len(sig), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(sig[i:i + 200_000]), pa.array(d[i:i + 200_000])], names=["sig", "d"])

    return arrow_map(docs, run, "sig bigint, d bigint")


def _items(rows: DataFrame, n: int) -> DataFrame:
    """(d, items) of (d, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(t or b"", n).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["d", "items"])

    return arrow_map(rows, run, "d bigint, items array<bigint>")


def _unlike(rows: DataFrame, key: str) -> DataFrame:
    """(key, m): the number of members, for one key of those that have the same members, by 128 bits of their hashes."""
    both = [F.bit_xor(F.xxhash64(F.lit(i), "d")).alias(f"x{i}") for i in (1, 2)]
    # sums tell sets apart that xor alone doesn't; halves of hashes, so that they stay below 2**63
    sizes = rows.groupBy(key).agg(F.count("*").alias("m"), F.sum(F.shiftright(F.xxhash64(F.lit(3), "d"), 32)).alias("x3"), *both).where("m > 1")
    return sizes.groupBy("m", "x1", "x2", "x3").agg(F.min(key).alias(key)).select(key, "m")


def _pairs(members: DataFrame, key: str) -> DataFrame:
    """All pairs of classes of each key, which has SMALL members at most."""
    lists = members.groupBy(key).agg(F.sort_array(F.collect_set("d")).alias("l")).where(F.size("l") > 1)
    i = lists.select("l", F.posexplode("l").alias("i", "x"))
    return i.select("x", F.explode(F.slice("l", F.col("i") + 2, F.lit(SMALL))).alias("y"))


def _possible(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs that the sketches don't rule out: sizes and parities differ by no more than linked sets may."""
    # sizes rule pairs out before sketches move
    one, two = (sketches.select(F.col("d").alias(c), F.col("n").alias(f"n{c}")) for c in "xy")
    near = pairs.join(one, "x").join(two, "y").withColumn("k", F.floor((F.col("nx") + F.col("ny")) * (q - p) / (q + p)))
    near = near.where(F.abs(F.col("nx") - F.col("ny")) <= F.col("k")).select("x", "y", "k")
    a = sketches.select(F.col("d").alias("x"), F.col("sketch").alias("sx"))
    b = sketches.select(F.col("d").alias("y"), F.col("sketch").alias("sy"))
    both = near.join(a, "x").join(b, "y")
    size = F.least(F.size("sx"), F.size("sy"))

    def folded(s: str):  # the parities of a sketch of twice the size, as one of this size
        return F.when(F.size(s) == size, F.col(s)).otherwise(F.zip_with(
            F.slice(s, F.lit(1), size), F.slice(s, size + 1, size), lambda u, v: u.bitwiseXOR(v)))

    differ = F.aggregate(F.zip_with(folded("sx"), folded("sy"), lambda u, v: F.bit_count(u.bitwiseXOR(v))),
                         F.lit(0), lambda n, x: n + x)
    return both.where(differ <= F.col("k")).select("x", "y")


def _picked(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows whose ``names`` are among the keys, which grow with the documents; while they are few, no row moves for it."""
    few = keys.limit(FEW + 1).count() <= FEW
    return rows.join(keys.hint("broadcast" if few else "merge"), [*names], "left_semi")


def _check(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (x, y) that are linked, by their whole sets. Only sets that are in a pair are moved."""
    ids = pairs.select(F.col("x").alias("d")).union(pairs.select(F.col("y").alias("d"))).distinct()
    sets = _picked(sets, ids, "d")
    a = sets.select(F.col("d").alias("x"), F.col("items").alias("sx"))
    b = sets.select(F.col("d").alias("y"), F.col("items").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    return (pairs.join(a, "x").join(b, "y").select("x", "y", both.alias("i"), (F.size("sx") + F.size("sy")).alias("n"))
            .where(F.col("i") * q >= (F.col("n") - F.col("i")) * p).select("x", "y"))


def _rarest(sets: DataFrame, hot: DataFrame, p: int, q: int) -> DataFrame:
    """(item, d): the first shingles by frequency among the hot classes."""
    rows = _picked(sets, hot, "d").select("d", F.explode("items").alias("item"))
    # a written table, so that the join splits frequent items
    often = step(rows.groupBy("item").agg(F.count("*").alias("f")), "often")
    ordered = rows.join(often.hint("merge"), "item").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("l"))
    size = F.size("l")
    first = F.slice("l", F.lit(1), (size - F.ceil(size * F.lit(p) / F.lit(q)) + 1).cast("int"))
    return ordered.select("d", F.explode(first).alias("e")).select(F.col("e.item").alias("item"), "d")


def _common_least(mine: list, yours: list, item: int) -> bool:
    """Whether ``item`` is the least key that both lists, which are sorted, have."""
    i = j = 0
    while mine[i] != yours[j]:
        if mine[i] < yours[j]:
            i += 1
        else:
            j += 1
    return mine[i] == item


def _words_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sketches, by row."""
    lists = column.combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[i:j].view(np.uint64) for i, j in zip(ends[:-1], ends[1:])]


def _left_of(p: int, q: int, forest: bool):
    return lambda rows: _left_pairs(rows, p, q, forest)


def _left_pairs(rows: pa.Table, p: int, q: int, forest: bool) -> pa.Table:
    """One block pair of a key: (item, x, y) that the sketches leave between components; a spanning forest or all of them."""
    side = rows.column("side").to_numpy()
    parts = []
    for k in (0, 1):
        own = rows.filter(pa.array(side == k))
        order = np.argsort(own.column("d").to_numpy())
        words, keys = _words_of(own.column("sketch")), own.column("mine").to_pylist()
        parts.append(([own.column(c).to_numpy()[order] for c in ("d", "c", "n")], [words[i] for i in order], [keys[i] for i in order]))
    (a, wa, ka), (b, wb, kb) = parts
    if not wb:  # a block with itself
        b, wb, kb = a, wa, ka
    item = rows.column("item")[0].as_py()
    found = []
    for size in {len(w) for w in wa}:
        i = np.array([k for k, w in enumerate(wa) if len(w) == size])
        for other in {len(w) for w in wb}:
            if max(size, other) > 2 * min(size, other):
                continue  # sizes too far apart to be linked
            j = np.array([k for k, w in enumerate(wb) if len(w) == other])
            u, v = np.stack([wa[k] for k in i]), np.stack([wb[k] for k in j])
            width = min(size, other)
            u = u if size == width else u[:, :width] ^ u[:, width:]
            v = v if other == width else v[:, :width] ^ v[:, width:]
            differ = np.zeros((len(i), len(j)), np.int32)
            for w in range(width):
                differ += np.bitwise_count(u[:, w, None] ^ v[None, :, w])
            most = (a[2][i][:, None] + b[2][j][None, :]) * (q - p) // (q + p)
            left = (differ <= most) & (np.abs(a[2][i][:, None] - b[2][j][None, :]) <= most) & (a[1][i][:, None] != b[1][j][None, :])
            r, c = np.nonzero(left)
            found.append((i[r], j[c]))
    r, c = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    here = np.array([_common_least(ka[i], kb[j], item) for i, j in zip(r.tolist(), c.tolist())], bool)
    r, c = r[here], c[here]
    x, y = a[0][r], b[0][c]
    cx, cy = a[1][r], b[1][c]
    if forest and len(x):
        root: dict[int, int] = {}

        def top(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        keep = []
        for k, (s, t) in enumerate(zip(cx.tolist(), cy.tolist())):
            s, t = top(s), top(t)
            if s != t:
                root[s] = t
                keep.append(k)
        x, y, cx, cy = x[keep], y[keep], cx[keep], cy[keep]
    swap = x > y
    pairs = {"x": np.where(swap, y, x), "y": np.where(swap, x, y), "cx": np.where(swap, cy, cx), "cy": np.where(swap, cx, cy)}
    pairs = {"item": np.full(len(x), item), **pairs}
    return pa.table({name: pa.array(v, pa.int64()) for name, v in pairs.items()}).group_by([*pairs]).aggregate([])


def _large(keys: DataFrame, links: DataFrame, sketches: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The links with those that are left between members of large keys, (item, d, m), of unlike components."""
    rows = step(keys, "keys")
    mine = rows.groupBy("d").agg(F.sort_array(F.collect_set("item")).alias("mine"))  # part of a set's first shingles
    about = step(sketches.join(mine.hint("merge"), "d"), "about")
    for turn in range(ROUNDS + 1):
        roots = components(links)
        at = rows.join(roots, F.col("d") == F.col("node"), "left").withColumn("c", F.coalesce("root", "d")).select("item", "d", "m", "c")
        open_keys = at.groupBy("item").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("item")
        at = step(at.join(open_keys, "item", "left_semi"), "open")
        # blocks i <= j of a key meet once: each row goes to the pairs of blocks that its own one is in
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        # sketches are joined to the rows that are compared only, and move with them once
        parts = at.join(about.hint("merge"), "d").withColumn("own", F.pmod(F.xxhash64("d"), blocks).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        parts = parts.select("item", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "d", "c", "n", "sketch", "mine")
        pairs = parts.groupBy("item", "i", "j").applyInArrow(_left_of(p, q, turn < ROUNDS), "item bigint, x bigint, y bigint, cx bigint, cy bigint")
        new = step(pairs, "left")  # a pair comes from one block of one key
        if not new.take(1):
            release(new, roots, at)
            break
        more = step(links.union(_check(new.select("x", "y"), sets, p, q)), "links")
        release(links)
        links = more
        # what the sketches leave stays the same, so only components that had something left in a key can have more there
        live = new.select("item", F.col("cx").alias("c")).union(new.select("item", F.col("cy").alias("c"))).distinct()
        left = step(_picked(at, live, "item", "c").select("item", "d", "m"), "keys")
        release(rows, new, roots, at)
        rows = left
    release(rows, about)
    return links


def linked_classes(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, doc_id: str = "doc_id",
                   text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_shingles, d) of every row, and (node, root) of the classes d that are linked with others."""
    rows = pick(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("row_key"), "text")
    own = written(_sets(rows, n), "sets")
    # every signature is dealt to its task once; the minima and the members are taken from that
    sigs = _signatures(rows, n, p, q).repartition("sig")
    many = sigs.groupBy("sig").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 <> d1")
    alike = step(sigs.join(many.hint("shuffle_hash"), "sig").select("sig", "d").distinct(), "alike")
    # copies are gone now, so that m counts unlike sets; the sizes grow with the documents and are never broadcast
    sizes = step(_unlike(alike, "sig"), "sizes")
    members = step(alike.join(sizes.hint("merge"), "sig").select("sig", "d", "m"), "members")
    release(alike, sizes)
    cand = members.select("d").distinct().join(own.groupBy("d").agg(F.min("row_key").alias("row_key")), "d")
    cand = step(cand, "classes")
    # the candidates grow with the documents: they are never broadcast, however few they are
    texts = rows.select("row_key", "text").join(cand.hint("merge"), "row_key").select("d", "text")
    sets = _items(texts, n)
    if own.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").take(1):
        sets = sets.dropDuplicates(["d"])  # rows that are equal in id and text
    sets = step(sets, "items")
    sketches = step(own.join(cand.select("d").distinct(), "d", "left_semi").groupBy("d").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    near = _pairs(members.where(F.col("m") <= SMALL), "sig")
    hot = step(members.where(F.col("m") > LARGE).select("d").distinct(), "hot")
    rare = step(_rarest(sets, hot, p, q), "rarest")
    keyed = step(rare.join(_unlike(rare, "item"), "item"), "keyed")
    near = step(near.union(_pairs(keyed.where(F.col("m") <= SMALL), "item")).distinct(), "near")
    pairs = step(_possible(near, sketches, p, q), "pairs")
    links = step(_check(pairs, sets, p, q), "links")
    release(rare, near, pairs, hot)
    some = members.where((F.col("m") > SMALL) & (F.col("m") <= LARGE)).select(F.col("sig").alias("item"), "d", "m")
    blocks = keyed.where(F.col("m") > SMALL).select("item", "d", "m").union(some)
    if blocks.take(1):
        links = _large(blocks, links, sketches, sets, p, q)
    roots = components(links)
    release(links, members, keyed, cand, sketches, sets)
    return own, roots


def join_components(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): component_id is the least id that links reach, itself included."""
    own, roots = linked_classes(docs, n, p, q, doc_id, text)
    least = own.where("d IS NOT NULL").groupBy("d").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, F.col("d") == F.col("node"), "left").select(
        "d", F.coalesce("root", "d").alias("root"), "least")
    reach = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = written(rooted.join(reach, "root").select(F.col("d").alias("_d"), "root", "component"), "components")
    return own.join(classes, F.col("d") == F.col("_d"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.col("root").alias("class_id"))


def keep_one(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that with the least id stays (ids that are null come
    last), and one row of those that are equal in id and text. Rows without shingles all stay."""
    names = docs.columns
    own, roots = linked_classes(docs, n, p, q, doc_id, text)
    own = own.where("d IS NOT NULL")
    rooted = own.join(roots, F.col("d") == F.col("node"), "left").select("doc_id", "row_key", F.coalesce("root", "d").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    chosen = rooted.groupBy("root").agg(first.alias("f")).select("root", F.col("f.row_key").alias("chosen"))
    gone = written(rooted.join(chosen, "root").where("row_key <> chosen").select("row_key").distinct(), "gone")
    again = written(own.groupBy("row_key").count().where("count > 1").select("row_key"), "again")
    rows = packed(docs, doc_id=doc_id, text=text).withColumn(
        "row_key", F.xxhash64(F.col("doc_id").cast("bigint"), "text")).select("_row", "row_key").join(gone, "row_key", "left_anti")
    single = rows.join(again, "row_key", "left_anti")
    # of equal rows one stays: they are few, and are combined before they are shuffled
    one = rows.join(again, "row_key", "left_semi").groupBy("row_key").agg(F.first("_row").alias("_row")).select("_row", "row_key")
    return unpacked(single.unionByName(one), names)
