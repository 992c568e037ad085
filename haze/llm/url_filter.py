"""URL filters by sorted digest arrays.

A rule is a verdict for a host, with all its subdomains, and a path that the
url's path must start with. The 64-bit xxhash of each rule's string (host,
then path) goes into a sorted array, with the strings beside it, in files of
at most SHARD rules in the shared folder. Spark brings the files to each
executor once, where all Python workers map them into memory. For every url
each end of its host, joined with each prefix of its path that is as long as
some rule's path, is hashed; all probes of a batch are looked up by one
vectorised binary search, and hits are confirmed by the stored strings. The
longest rule that fits wins; the first in alphabetical order of those.

Rows: one per input row. A null url, or one without "://", has an empty host
and path, which no rule fits; urls that no rule fits get the method's own
verdict: block without a host, else allow; repeated rules count once (the
first verdict stands); without rules there is nothing to probe; repeated rows
give repeated results; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, pick, shared_dir

#: Rules of one file: at 100 bytes each about half a gigabyte, mapped and not read.
SHARD = 5_000_000
VERDICTS = ("allow", "block")


def digests(strings: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(s.encode()) for s in strings), np.uint64, len(strings))


def packed_rules(rules: dict[str, str]) -> bytes:
    """The number of rules, then by digest: digests, ends of the strings, verdicts, and the strings."""
    strings = list(rules)
    keys = digests(strings)
    order = np.argsort(keys, kind="stable")
    texts = [strings[i].encode() for i in order]
    ends = np.cumsum([len(t) for t in texts]).astype(np.uint64)
    verdicts = np.array([VERDICTS.index(rules[strings[i]]) for i in order], np.uint64)
    return b"".join([np.array([len(texts)], np.uint64).tobytes(), keys[order].tobytes(), ends.tobytes(), verdicts.tobytes(), *texts])


class Rules:
    """One file of rules, mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.uint64)[0])
        self.keys, self.ends, self.verdicts = (raw[8 + i * 8 * n:8 + (i + 1) * 8 * n].view(np.uint64) for i in range(3))
        self.strings = raw[8 + 24 * n:]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0:int(self.ends[i])].tobytes()

    def find(self, keys: np.ndarray, strings: list[str]) -> list[tuple[int, str]]:
        """(probe, verdict) of the probes that are rules."""
        at = np.searchsorted(self.keys, keys)
        inside = np.flatnonzero(at < len(self.keys))
        out = []
        for p in inside[self.keys[at[inside]] == keys[inside]].tolist():
            i, own = int(at[p]), strings[p].encode()
            while i < len(self.keys) and self.keys[i] == keys[p]:  # rules with one digest stand side by side
                if self.string(i) == own:
                    out.append((p, VERDICTS[int(self.verdicts[i])]))
                    break
                i += 1
        return out


@lru_cache(maxsize=16)
def mapped(path: str) -> Rules:
    return Rules(path)


def publish(spark: SparkSession, rules: list[tuple[str, str, str]], shard: int = SHARD) -> tuple[list[str], list[int]]:
    """Names of the files that Spark brings to the executors; the lengths of the rules' paths."""
    every: dict[str, str] = {}
    for verdict, host, path in rules:
        every.setdefault(host + path, verdict)
    names, strings = [], list(every)
    jvm, base = spark.sparkContext._jvm, shared_dir(spark).rstrip("/")
    for i in range(0, len(strings), shard):
        name = f"rules-{uuid.uuid4().hex}"
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(packed_rules({s: every[s] for s in strings[i:i + shard]})))
        out.close()
        spark.sparkContext.addFile(path.toString())
        names.append(name)
    return names, sorted({len(path) for _, _, path in rules})


def split(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    stop = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[stop:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:stop].encode().lower().decode(), path[:end]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url",
          shard: int = SHARD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for rules of (verdict, host, path)."""
    names, lengths = publish(pages.sparkSession, rules, shard)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        parts = [split(u) for u in batch.column(1).to_pylist()]
        strings, owners = [], []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            prefixes = [path[:n] for n in lengths if n <= len(path)]
            end = host
            while end:
                strings += [end + p for p in prefixes]
                owners += [i] * len(prefixes)
                end = end.partition(".")[2]
        best: list[tuple[str, str] | None] = [None] * len(parts)
        keys = digests(strings)
        for name in names:
            for p, verdict in mapped(SparkFiles.get(name)).find(keys, strings):
                own, s = best[owners[p]], strings[p]
                if own is None or (-len(s), s) < (-len(own[0]), own[0]):
                    best[owners[p]] = s, verdict
        verdicts = [b[1] if b else "allow" if host else "block" for b, (host, _) in zip(best, parts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts],
                                                                   [b[0] if b else None for b in best], verdicts))],
            names=["page_id", "host", "path", "rule", "verdict"])

    rows = pick(pages, page_id=page_id, url=url).select(F.col("page_id").cast("bigint").alias("page_id"), "url")
    return arrow_map(rows, run, "page_id bigint, host string, path string, rule string, verdict string")
