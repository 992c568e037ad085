"""Phrase collocations from count streams in prefix and suffix order.

Texts are split into pieces at punctuation and line ends, and those into
words; a phrase is 1 to ``most`` consecutive words of a piece. By language,
phrases that occur ``least`` times or more are counted and scored by their
weakest cut into two parts.

1. Words and pairs of words are counted by 64-bit hashes, combined in each
   task first. What is frequent by its hash goes into a bit table of a fixed
   size (BITS), which is broadcast; it can only let too much through.
2. A second pass counts, as strings and exactly, the words that passed, and
   at each place the longest phrase all of whose pairs passed: one row for
   a place at most, however much is frequent. A phrase's count is the sum over
   the longest ones that begin with it. A part of a frequent phrase is as
   frequent, so nothing is lost, and hashes that collide change no count.
3. The counts are kept as two streams: sorted by their words (prefix order),
   and sorted by their words from the last to the first (suffix order).
   A phrase follows all its beginnings in the one and all its endings in the
   other, so each stream is read once, with the counts of the open beginnings on a stack of
   ``most`` places: that gives the left parts of all cuts, or the
   right ones, and for each phrase its share of the phrase that it extends by one word. No
   hash table is built. Partitions are ranges, cut anywhere, also within
   the phrases of one word; what is open where a range starts comes from the
   ends of the ranges before it, a few rows for each.
4. Both streams meet in a merge join by phrase. A phrase is left out if one
   that extends it by a word is nearly as frequent: phrases longer by more words
   are no more frequent than those between.

Rows: ``top`` phrases of each language, or fewer. A null text is empty; a null
language is ``und``; texts without words count nothing; copies and repeated rows count each
time; ties go by count, then by the bytes of the phrase; very long texts
are read piece by piece; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haze.llm.common import SLICE_BYTES, ensure_checkpoint_dir, mix, pick, release, step, trim

#: Least count of a candidate, and its greatest number of words.
LEAST, MOST = 30, 4
#: A phrase is left out if a longer one has this share of its count or more, in hundredths.
COVERED = 80
#: Phrases of a language that are reported.
TOP = 2000
#: Language of texts that declare none.
UNDECLARED = "und"
#: Bits of the table of what is frequent.
BITS = 1 << 26
#: Words that a task gathers before it combines their counts.
TOKENS = 6_000_000
#: Groups that a language's phrases are cut into before the best of all are taken.
GROUPS = 512
BATCH = 100_000
#: A byte that no UTF-8 text has: it stands for what parts pieces.
_END = b"\xff"
_BYTES = bytes(255 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Ids(dict):
    """Numbers of words from 1, in the order of their first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Gathered:
    """The words of a language, as numbers of its own."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, Ids({_END: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def hashes(self) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.ids), np.uint64, len(self.ids))

    def words(self) -> np.ndarray:
        """The words in order."""
        if len(self.parts) > 1:  # one array in place of the parts, which are let go
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]


def _pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a pair of words starts, and the pair there."""
    at = np.nonzero((words[:-1] > 0) & (words[1:] > 0))[0].astype(np.int32)
    codes = words[at].astype(np.int64)
    codes <<= 32
    codes |= words[1:][at]
    return at, codes


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order with their counts; sorts ``codes``."""
    codes.sort()
    starts = np.nonzero(np.r_[True, codes[1:] != codes[:-1]])[0] if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.diff(starts, append=len(codes))


def _numbered(codes: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Places of the codes among the distinct ones, some at once: no other array of their length is made."""
    out = np.empty(len(codes), np.int32)
    for i in range(0, len(codes), BATCH):
        out[i:i + BATCH] = np.searchsorted(distinct, codes[i:i + BATCH])
    return out


def _pair_hashes(own: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mix(own[codes >> 32] * np.uint64(0x9E3779B97F4A7C15) + own[codes & 0xFFFFFFFF])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with ends between its pieces, some megabytes at once."""
    data, at = text.translate(_BYTES), 0
    while at < len(data):
        stop = data.find(_END, at + SLICE_BYTES)
        stop = len(data) if stop < 0 else stop + 1
        yield (data[at:stop] if stop - at < len(data) else data).replace(_END, b" \xff ").split(b" ")
        at = stop


def _gathering(counted: Callable[[Gathered], Iterator[pa.RecordBatch]], tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over (lang, text) that gathers words by language and hands them on, TOKENS of them at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        held: dict[str, Gathered] = {}
        size = 0
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    own = held.setdefault(lang, Gathered(lang))
                    for words in _pieces(text):
                        own.add([w for w in words if w])
                        own.add([_END])
                        size += own.parts[-2].size
                        if size >= tokens:
                            del own
                            while held:  # one after another, as each is let go when it is counted
                                yield from counted(held.popitem()[1])
                            held, size = {lang: (own := Gathered(lang))}, 0
        own = None
        while held:
            yield from counted(held.popitem()[1])
        trim()

    return run


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    rows = pick(docs, lang=lang, text=text).where("text IS NOT NULL")
    return rows.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDECLARED)).alias("lang"), "text")


def _hash_counts(g: Gathered) -> Iterator[pa.RecordBatch]:
    """(h, n) of the words and of the pairs of words."""
    if not g.parts:
        return
    words, own = g.words(), g.hashes()
    counts = np.bincount(words, minlength=len(own))
    codes, n = _counted(_pairs(words)[1])
    for i in range(1, len(own), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(own[i:i + BATCH].view(np.int64)), pa.array(counts[i:i + BATCH])], names=["h", "n"])
    for i in range(0, len(codes), BATCH):
        h = _pair_hashes(own, codes[i:i + BATCH]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[i:i + BATCH])], names=["h", "n"])


def _table(often: DataFrame, size: int) -> np.ndarray:
    """Two of ``size`` bits for each hash, as 64-bit words: size / 64 rows at most, whatever there is."""
    places = F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1))
    bits = often.select(F.explode(places).alias("b"))
    rows = bits.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask, found = np.uint64(64 * len(table) - 1), np.ones(len(h), bool)
    for place in (h & mask, h >> np.uint64(32) & mask):
        found &= (table[(place >> np.uint64(6)).astype(np.intp)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _phrases(g: Gathered, table: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, k, n) of the words in the table, and of the longest phrase of each place all of whose words and pairs
    are: one row for a place at most, those with the same k words combined. The empty phrase has the number of all words."""
    if not g.parts:
        return
    words, own = g.words(), g.hashes()
    names = pa.array([b"", *[*g.ids][1:]], pa.large_binary())
    passed = _in_table(table, own)
    counts = np.bincount(words, minlength=len(own))
    yield _named(g.lang, pa.array([b""], pa.large_binary()), 0, counts[1:].sum(keepdims=True))
    listed = np.nonzero(passed)[0]
    listed = listed[listed > 0]
    for i in range(0, len(listed), BATCH):
        yield _named(g.lang, names.take(pa.array(listed[i:i + BATCH])), 1, counts[listed[i:i + BATCH]])
    at, codes = _pairs(words)
    good = np.empty(len(codes), bool)
    for i in range(0, len(codes), BATCH):
        part = codes[i:i + BATCH]
        good[i:i + BATCH] = passed[part >> 32] & passed[part & 0xFFFFFFFF]
    at, codes = at[good], codes[good]
    distinct, _ = _counted(codes.copy())
    good = np.concatenate([np.empty(0, bool), *(_in_table(table, _pair_hashes(own, distinct[i:i + BATCH])) for i in range(0, len(distinct), BATCH))])
    distinct = distinct[good]
    if not len(distinct):
        return
    number = _numbered(codes, distinct)
    keep = distinct[np.minimum(number, len(distinct) - 1)] == codes
    at, number = at[keep], number[keep]
    del good, codes, keep
    pair = np.zeros(len(words), bool)  # places where a pair starts that is in the table
    pair[at] = True
    # every level numbers the phrases of a task exactly: the number of all but the last word, and that word
    levels = [distinct]
    for size in range(2, max(2, most) + 1):
        longer = pair[np.minimum(at + (size - 1), len(words) - 1)] if size < most else np.zeros(len(at), bool)
        n = np.zeros(len(distinct), np.int32)
        for i in range(0, len(number), BATCH):
            np.add.at(n, number[i:i + BATCH][~longer[i:i + BATCH]], 1)
        yield from _level(g.lang, names, levels, n)
        at, number = at[longer], number[longer]
        del n, longer
        if not len(at):
            break
        codes = number.astype(np.int64)
        codes <<= 32
        codes |= words[at + size]
        distinct, _ = _counted(codes.copy())
        number = _numbered(codes, distinct)
        del codes
        levels.append(distinct)


def _named(lang: str, phrases: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32))), phrases.cast(pa.binary()).cast(pa.string()),
                                       pa.array(np.full(len(n), k, np.int32)), pa.array(n, pa.int64())], names=["lang", "phrase", "k", "n"])


def _level(lang: str, names: pa.Array, levels: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The phrases of the last level that have a count, spelled out some at once: what a task holds of a phrase is its number."""
    for i in range(0, len(n), BATCH):
        counted = n[i:i + BATCH]
        at, counted, spelled = levels[-1][i:i + BATCH][counted > 0], counted[counted > 0], []
        for above in levels[-2::-1]:
            spelled.append(at & 0xFFFFFFFF)
            at = above[at >> 32]
        spelled = [at >> 32, at & 0xFFFFFFFF, *spelled[::-1]]
        del at
        yield _named(lang, pc.binary_join_element_wise(*(names.take(pa.array(w)) for w in spelled), pa.scalar(b" ", pa.large_binary())),
                     len(spelled), counted)


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MOST, text: str = "text", lang: str = "lang", tokens: int = TOKENS,
                  bits: int = BITS) -> DataFrame:
    """(lang, phrase, n): exact counts of all phrases of up to ``most`` words that occur ``least`` times or more; the empty phrase
    has the number of all words of the language."""
    rows = _texts(docs, text, lang)
    hashed = rows.mapInArrow(_gathering(_hash_counts, tokens), "h bigint, n bigint")
    often = step(hashed.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "often")
    table = docs.sparkSession.sparkContext.broadcast(_table(often, bits))  # bits / 8 bytes
    found = rows.mapInArrow(_gathering(lambda g: _phrases(g, table.value, most), tokens), "lang string, phrase string, k int, n bigint")
    longest = step(found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")), "longest")
    table.unpersist()
    # a phrase occurs where it is the longest and where the longest one begins with it
    counts = longest.where("k < 2").select("lang", "phrase", "n")
    for size in range(2, max(2, most) + 1):
        begins = longest.where(F.col("k") >= size).groupBy("lang", F.substring_index("phrase", " ", size).alias("phrase"))
        counts = counts.union(begins.agg(F.sum("n").alias("n")))
    out = step(counts.where((F.col("n") >= least) | (F.col("phrase") == "")), "counts")
    release(often, longest)
    return out


# ------------------------------------------------------------------ the two streams
_Open = list[tuple[tuple[str, ...], int]]  # beginnings of the row that was read last, with their counts


def _opened(held: _Open, path: tuple[str, ...]) -> _Open:
    """Those that ``path`` begins with."""
    return [e for e in held if len(e[0]) < len(path) and path[:len(e[0])] == e[0]]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is open at the end of this partition, of its own rows: at most one row for each number of words."""
    held: _Open = []
    for batch in batches:
        for lang, words, n in zip(*(c.to_pylist() for c in batch.columns)):
            path = (lang, *words)
            held = [*_opened(held, path), (path, n)]
    at = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([at] * len(held), pa.int32()), pa.array([[*p] for p, _ in held], pa.list_(pa.string())),
                                      pa.array([n for _, n in held], pa.int64())], names=["part", "path", "n"])


def _carried(ends: list[tuple[int, tuple[str, ...], int]]) -> dict[int, _Open]:
    """What may be open where each partition starts, as its ranges follow each other."""
    out: dict[int, _Open] = {}
    held: _Open = []
    by_part: dict[int, _Open] = {}
    for part, path, n in sorted(ends, key=lambda e: (e[0], len(e[1]))):
        by_part.setdefault(part, []).append((path, n))
    for part, own in sorted(by_part.items()):
        out[part] = held
        held = [*_opened(held, own[-1][0]), *own]
    return out


def _walk(counts: DataFrame, words: DataFrame, covered: int) -> DataFrame:
    """(lang, phrase, n, parts, covers) of (lang, words, n) in the order of ``words``: the counts of its beginnings, from
    one word on, and the longest of those if the phrase has enough of its count."""
    sc = counts.sparkSession.sparkContext
    ensure_checkpoint_dir(counts.sparkSession)
    stream = words.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words").checkpoint()
    ends = [(r.part, tuple(r.path), r.n) for r in stream.mapInArrow(_ends, "part int, path array<string>, n bigint").collect()]
    carried = sc.broadcast(_carried(ends))  # a few rows for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = carried.value.get(TaskContext.get().partitionId(), [])
        for batch in batches:
            parts, covers = [], []
            for lang, words, n in zip(*(c.to_pylist() for c in batch.columns)):
                path = (lang, *words)
                held = _opened(held, path)
                parts.append([m for _, m in held])
                covers.append([*held[-1][0][1:]] if held and 100 * n >= covered * held[-1][1] else None)
                held.append((path, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int64())), pa.array(covers, pa.list_(pa.string()))],
                                             names=["lang", "words", "n", "parts", "covers"])

    return stream.mapInArrow(run, "lang string, words array<string>, n bigint, parts array<bigint>, covers array<string>")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, covered: int = COVERED, top: int = TOP, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    counts = phrase_counts(docs, least, most, text, lang)
    words = counts.where("phrase <> ''").select("lang", F.split("phrase", " ", -1).alias("words"), "n")
    prefix = _walk(counts, words, covered)
    suffix = _walk(counts, words.withColumn("words", F.reverse("words")), covered).withColumns(
        {"words": F.reverse("words"), "covers": F.reverse("covers")})
    left = step(prefix.select("lang", F.array_join("words", " ").alias("phrase"), "n", "parts", F.array_join("covers", " ").alias("covers")), "prefix")
    right = step(suffix.select("lang", F.array_join("words", " ").alias("phrase"), "parts", F.array_join("covers", " ").alias("covers")), "suffix")
    gone = left.select("lang", "covers").union(right.select("lang", "covers")).where("covers IS NOT NULL").distinct()
    kept = left.where(F.size("parts") > 0).join(gone.withColumnRenamed("covers", "phrase").hint("merge"), ["lang", "phrase"], "left_anti")
    both = kept.select("lang", "phrase", F.col("n").alias("a"), F.col("parts").alias("ls")).join(
        right.select("lang", "phrase", F.col("parts").alias("rs")).hint("merge"), ["lang", "phrase"])
    # cut k has the k-th beginning and the ending of the other words; decimals are exact past 64 bits
    cuts = F.expr("""transform(ls, (l, i) -> named_struct(
        'score', CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))
                 div (CAST(l AS DECIMAL(20, 0)) + CAST(rs[size(rs) - 1 - i] AS DECIMAL(20, 0))),
        'k', i, 'l', l, 'r', rs[size(rs) - 1 - i]))""")
    scored = both.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("bigint").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each group first, so that no task sorts a language
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    total = counts.where("phrase = ''").select("lang", "n")
    out = step(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(counts, left, right)
    return out


def oracle_sql(least: int = LEAST, most: int = MOST, covered: int = COVERED, top: int = TOP) -> str:
    """DuckDB SQL of the rows over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, range(1, {most + 1}) AS t(k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= {least}),
x AS MATERIALIZED (SELECT *, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail
      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
s AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score, j
      FROM x c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(ws[b:b + z - 1], ' ') AS phrase, max(a) AS a
      FROM (SELECT *, unnest(generate_series(1, k - z + 1)) AS b FROM (SELECT *, unnest(generate_series(2, k - 1)) AS z FROM c WHERE k > 2)) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.a IS NULL OR 100 * i.a < {covered} * m.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) QUALIFY rank <= {top}"""
