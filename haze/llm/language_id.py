"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

log posterior(l) = TEMPER * log P(text | l) + log P(declared | l) + log prior(l | host), where

- P(text | l) is a naive Bayes model of hashed letter trigrams over the whole
  text, fitted on about PER_LANGUAGE labelled rows of each language, chosen
  by a hash (the bound of the sample). Every language of LEAST labelled rows
  or more has a model, however many languages there are; models hold the
  features that were seen only, so that they grow with what is known of them;
- languages of fewer labelled rows have too few for a model. Where there are
  any, one more class stands for them, UNKNOWN: half of its text model is that of
  all their rows together, half has all features alike; its declarations are
  all those that no model has. For a row with such a declaration the text says
  no more for any language than for UNKNOWN, so that declaration and host
  decide. A row of that class has the language that it declares, if no model has that one, or else
  the one that most rows of the class declare on its host, or else UNKNOWN;
- P(declared | l) comes from how often rows whose text says l declare each
  language, over all rows; region tags are cut off ("en-GB" is "en"), and a
  missing declaration is no evidence, nor is one that no class has;
- prior(l | host) is that of the host, smoothed towards that of its address
  suffix (the last label; none without a dot), which is smoothed towards that
  of all rows, each with a strength of SMOOTH rows; counted by a grouped
  aggregation over the text's languages of all rows.

Counts by host are a table that grows with the hosts, of the languages that
each has. It is written, so that the planner broadcasts it only if it is
small, and else joins by host and splits skewed ones. Texts are scored twice
rather than stored again.

Rows: one per input row. A row is rejected if its text has no letters, as a
null or empty one, or if no class has a posterior of LEAST_POSTERIOR. A
null host is the host ""; ties go to the language first in alphabetical
order, UNKNOWN last; repeated rows count as often as they stand; without labelled rows
there are no languages: nothing is rejected and the language is null; an empty table
gives an empty one; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm.common import arrow_map, packed, pick, positions, unpacked, written

PER_LANGUAGE = 500
LEAST = 5
FEATURES = 1 << 15
TEMPER = 0.3
SMOOTH = 20.0
LEAST_POSTERIOR = 0.5
#: The class of languages without a model (ISO 639-2: undetermined), and the declarations of that class.
UNKNOWN = "und"
OTHER = "*"

#: ASCII other than letters parts words.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Hashed trigrams of the bytes of the lower-cased text, blanks for all but letters; the number of letters."""
    a = np.frombuffer(b" " + (text or "").lower().encode().translate(_LETTERS) + b" ", np.uint8)
    filled = a != 0x20
    letters = int((filled & ((a & 0xC0) != 0x80)).sum())
    if not letters:
        return np.empty(0, np.int64), 0
    w = a.astype(np.uint32)
    code = (w[:-2] << 16) | (w[1:-1] << 8) | w[2:]
    code = code[filled[1:-1] | (filled[:-2] & filled[2:])]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64), letters


@dataclass
class Model:
    """Logarithms are kept as one value for all that wasn't seen, by language, and what is added for what was."""

    languages: list[str]
    unknown: int | None  # place of the class of languages without a model
    unseen: np.ndarray  # log P(feature | language) of features that it doesn't have
    start: np.ndarray  # where each feature begins in the next two; its end is the next one's start
    place: np.ndarray  # languages that have the feature
    more: np.ndarray  # log P(feature | language) - unseen
    undeclared: np.ndarray | None = None  # log P(declared | language) of what no row of the language declares
    declared: dict[str, tuple[np.ndarray, np.ndarray]] | None = None  # languages, and what is added for them
    above: np.ndarray | None = None  # prior of each language over all rows

    def text_scores(self, text: str | None) -> tuple[np.ndarray, int]:
        f, letters = features(text)
        size = len(self.languages)
        if not letters:
            return np.zeros(size), 0
        out = len(f) * self.unseen
        times = None
        if len(f) > 2048:
            times = np.bincount(f, minlength=FEATURES)
            f = np.flatnonzero(times)
            times = times[f]
        first = self.start[f]
        n = self.start[f + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        weight = self.more[at] if times is None else self.more[at] * np.repeat(times, n)
        return TEMPER * (out + np.bincount(self.place[at], weight, size)), letters

    def category(self, declared: str | None) -> str | None:
        """The declaration as the model counts it; None if it is no evidence."""
        if not declared:
            return None
        return declared if declared in self.declared else OTHER if self.unknown is not None else None

    def prior(self, host: np.ndarray, host_n: np.ndarray, suffix: np.ndarray, suffix_n: np.ndarray) -> np.ndarray:
        """log prior(language | host) from the languages and counts of the host and of its suffix."""
        out = SMOOTH * self.above
        out[suffix] += suffix_n
        out *= SMOOTH / (suffix_n.sum() + SMOOTH)
        out[host] += host_n
        return np.log(out / (host_n.sum() + SMOOTH))


def _declared(c):
    return F.lower(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1))


def _host(c):
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def _suffix(host):
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def fit_text(labelled: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE,
             seed: int = 42) -> Model:
    """The text model from a sample of the rows; ``fit`` adds declarations and priors."""
    rows = pick(labelled, text=text, label=label).select("text", _declared(F.col("label")).alias("label")).where("label <> ''")
    counts = written(rows.groupBy("label").count(), "labels")
    names = sorted(r["label"] for r in counts.where(F.col("count") >= LEAST).select("label").collect())
    n_rare = counts.where(F.col("count") < LEAST).agg(F.sum("count")).first()[0] or 0
    size = len(names) + (n_rare > 0)
    few = F.col("count") < LEAST
    share = counts.select(F.col("label").alias("_label"), F.when(~few, F.col("label")).otherwise(F.lit(OTHER)).alias("class"),
                          (F.lit(per_language) / F.when(few, F.lit(n_rare)).otherwise(F.col("count")) * F.lit(float(1 << 30))).alias("share"))
    chosen = rows.join(share, F.col("label") == F.col("_label")).where(
        F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < F.col("share")).select("text", "class")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = batch.column(1).dictionary_encode()
        code = own.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = [features(t)[0] + c * FEATURES for t, c in zip(batch.column(0).to_pylist(), code)]
        key, n = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
        names = own.dictionary.take(pa.array(key // FEATURES))
        yield pa.RecordBatch.from_arrays([names, pa.array((key % FEATURES).astype(np.int32)), pa.array(n.astype(np.int64))],
                                         names=["label", "feature", "n"])

    # languages times their features at most
    got = arrow_map(chosen, run, "label string, feature int, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    spot = {name: i for i, name in enumerate([*names, OTHER])}
    place = np.array([spot[x] for x in got.column("label").to_pylist()], np.int32)
    feature, n = got.column("feature").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((place, feature))
    place, n = place[order], n[order]
    start = np.searchsorted(feature[order], np.arange(FEATURES + 1))
    total = np.bincount(place, n, size) + 0.05 * FEATURES
    unseen, seen = 0.05 / total, (n + 0.05) / total[place]
    unknown = len(names) if n_rare else None
    if unknown is not None:
        names = [*names, UNKNOWN]
        unseen[unknown] = (unseen[unknown] + 1 / FEATURES) / 2
        seen = np.where(place == unknown, (seen + 1 / FEATURES) / 2, seen)
    return Model(names, unknown, np.log(unseen), start, place, np.log(seen / unseen[place]).astype(np.float32))


def _by_language(counts: DataFrame, of: str, name: str) -> DataFrame:
    """(of, {name}_l, {name}_n): the languages of each, and their counts; also of those that have none."""
    some = F.when(F.col("l").isNotNull(), F.struct("l", F.col("n").cast("double").alias("n")))
    return (counts.groupBy(of, "l").agg(F.sum("n").alias("n")).groupBy(of).agg(F.collect_list(some).alias("c"))
            .select(of, F.col("c.l").alias(f"{name}_l"), F.col("c.n").alias(f"{name}_n")))


def fit(rows: DataFrame, model: Model, text: str = "text", declared: str = "lang", host: str = "source") -> tuple[Model, DataFrame]:
    """The model with P(declared | language) and the prior of all rows, and (host, host_l, host_n, suffix_l, suffix_n,
    other), counted over all rows; other is the language that most UNKNOWN rows of the host declare."""
    sc = rows.sparkSession.sparkContext
    names, shared = model.languages, sc.broadcast(model)
    fitted = [x for i, x in enumerate(names) if i != model.unknown]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for t in batch.column(2).to_pylist():
            s, letters = shared.value.text_scores(t)
            out.append(int(s.argmax()) if letters else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["host", "declared", "l"])

    own = pick(rows, host=host, declared=declared, text=text).select(
        _host(F.col("host")).alias("host"), _declared(F.col("declared")).alias("declared"), "text")
    said = arrow_map(own, run, "host string, declared string, l int")
    counts = written(said.groupBy("host", "declared", "l").agg(F.count("*").alias("n")), "evidence")
    size = len(names)
    known = counts.where("l IS NOT NULL")
    categories = [*fitted, *([] if model.unknown is None else [OTHER])]
    kind = F.when(F.col("declared").isin(fitted), F.col("declared"))
    if model.unknown is not None:
        kind = F.when(F.col("declared") != "", F.coalesce(kind, F.lit(OTHER)))
    seen: dict[str, tuple[list[int], list[int]]] = {c: ([], []) for c in categories}
    sums = np.full(size, float(len(categories)))
    for r in known.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind", "l").agg(F.sum("n").alias("n")).collect():
        seen[r["kind"]][0].append(r["l"])
        seen[r["kind"]][1].append(r["n"])
        sums[r["l"]] += r["n"]
    every = np.ones(size)
    for r in known.groupBy("l").agg(F.sum("n").alias("n")).collect():
        every[r["l"]] += r["n"]
    model = replace(model, undeclared=-np.log(sums), above=every / every.sum(),
                    declared={c: (np.array(at, np.int64), np.log1p(np.array(n, np.float64))) for c, (at, n) in seen.items()})
    hosts = _by_language(counts, "host", "host").withColumn("suffix", _suffix(F.col("host")))
    suffixes = _by_language(counts.withColumn("_suffix", _suffix(F.col("host"))), "_suffix", "suffix")
    evidence = hosts.join(suffixes, F.col("suffix") == F.col("_suffix")).drop("suffix", "_suffix")
    if model.unknown is None:
        return model, written(evidence.withColumn("other", F.lit(None).cast("string")), "priors")
    rare = known.where((F.col("l") == model.unknown) & (F.col("declared") != "") & ~F.col("declared").isin(fitted))
    rare = rare.groupBy(F.col("host").alias("_host"), "declared").agg(F.sum("n").alias("n")).groupBy("_host").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "declared"))["declared"].alias("other"))
    return model, written(evidence.join(rare, F.col("host") == F.col("_host"), "left").drop("_host"), "priors")


def _lists(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def identify(rows: DataFrame, labelled: DataFrame | None = None, text: str = "text", declared: str = "lang", host: str = "source",
             label: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``_row`` of each row with ``_language``, ``_posterior``, ``_letters`` and ``_kept``; the model is fitted on
    ``labelled`` (the rows themselves by default)."""
    sc = rows.sparkSession.sparkContext
    p = packed(rows, text=text, declared=declared, host=host)
    kind = p.schema["_row"].dataType.simpleString()
    out = f"_row {kind}, _language string, _posterior double, _letters bigint, _kept boolean"
    model = fit_text(rows if labelled is None else labelled, text, label, per_language)
    if not model.languages:
        return p.selectExpr("_row", "CAST(NULL AS STRING) AS _language", "CAST(NULL AS DOUBLE) AS _posterior",
                            "CAST(NULL AS BIGINT) AS _letters", "true AS _kept")
    model, priors = fit(rows, model, text, declared, host)
    shared = sc.broadcast(model)
    at = positions(rows, [text])[0]  # the text is taken from the row, so that it is moved once
    evidence = ["host_l", "host_n", "suffix_l", "suffix_n"]
    joined = p.select("_row", _declared(F.col("declared")).alias("declared"), _host(F.col("host")).alias("_h")).join(
        priors, F.col("_h") == F.col("host")).select("_row", "declared", "other", *evidence)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        best, post, count = [], [], []
        for t, d, other, *counted in zip(batch.column(0).field(at).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                         *[_lists(batch.column(i)) for i in range(3, 7)]):
            s, letters = m.text_scores(t)
            c = m.category(d)
            if c == OTHER:
                s[m.unknown] = s.max()
            s = s + m.prior(*counted)
            if c is not None:
                s += m.undeclared
                places, more = m.declared[c]
                s[places] += more
            s = np.exp(s - s.max())
            s /= s.sum()
            i = int(s.argmax())
            if i == m.unknown:
                best.append(d if c == OTHER else other or UNKNOWN)
            else:
                best.append(m.languages[i])
            post.append(float(s[i]))
            count.append(letters)
        kept = [n > 0 and x >= LEAST_POSTERIOR for n, x in zip(count, post)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(post, pa.float64()),
                                          pa.array(count, pa.int64()), pa.array(kept, pa.bool_())],
                                         names=["_row", "_language", "_posterior", "_letters", "_kept"])

    return arrow_map(joined, run, out)


def keep_identified(rows: DataFrame, **columns) -> DataFrame:
    """The rows that aren't rejected, all columns as they were."""
    return unpacked(identify(rows, **columns).where("_kept"), rows.columns)
