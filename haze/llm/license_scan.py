"""License scans by diagonal voting.

Every run of K words of a text is hashed; Spark joins the hashes to the
positions of the same runs in license templates. Each match votes for the
diagonal (position in the text less position in the template) of its text
and template. Diagonals at most NEAR apart are merged, as a word added or
left out moves the rest by one; spans whose votes cover enough of the
template are verified word by word against the text.

Beside that, the phrases of BASE are looked for as they stand; their labels
are always given.

Votes, spans and verification are by distinct text (two 64-bit hashes), so
that a group of copies is one. The planner knows the size of the templates'
table and broadcasts it if it is small. Spans are written, so that it knows
their size too when it joins them to the texts.

Rows: one per input row. A null or empty text has no words, labels or spans;
equal spans are given once; repeated rows give repeated results; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haze.llm.common import WordHashes, arrow_map, pick, plain_words, rolling, written

#: Words of a hashed run.
K = 4
#: Diagonals at most this far apart are merged.
NEAR = 4
#: Share of a template's runs that must vote, and share of its words that must be found in order.
VOTES = 0.4
VERIFIED = 0.7

#: Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licenses word them, and short statements of use.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("proprietary", "All rights reserved. No part of this may be reproduced without permission"),
]

_words = WordHashes()


def runs(words: list[bytes], k: int) -> np.ndarray:
    return rolling(_words.of(words), k).view(np.int64)


def template_positions(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(run, template, at, runs): every run of every template."""
    rows = []
    for i, (_, text) in enumerate(templates):
        own = runs(plain_words(text.encode()), k)
        rows += [(int(r), i, at, len(own)) for at, r in enumerate(own)]
    columns = [*zip(*rows)] or [()] * 4
    kinds = [("run", pa.int64()), ("template", pa.int32()), ("at", pa.int32()), ("runs", pa.int32())]
    # an Arrow table is a local relation, whose size the planner knows: it is broadcast only if it is small
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns)}))


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, near: int = NEAR, votes: float = VOTES,
          text: str = "text") -> DataFrame:
    """(key, spans): merged diagonals with votes enough, not verified yet, by text."""
    templates = TEMPLATES if templates is None else templates

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [runs(plain_words((t or "").encode()), k) for t in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*own, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "runs"])

    rows = arrow_map(pick(docs, text=text).where("text IS NOT NULL").select(_key(), "text"), run,
                     "key struct<a:bigint,b:bigint>, runs array<bigint>")
    said = rows.select("key", F.posexplode("runs").alias("pos", "run"))
    matches = said.join(template_positions(docs.sparkSession, templates, k), "run").select(
        "key", "template", "runs", "pos", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    lines = matches.groupBy("key", "template", "runs", "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True)).cast("int")
    merged = (lines.withColumn("far", far).withColumn("part", F.sum("far").over(order))
              .groupBy("key", "template", "runs", "part")
              .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + k).alias("stop"))
              .where(F.col("votes") >= F.col("runs") * F.lit(votes)))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "template"))).alias("spans"))


def _key():
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("key")


def phrase_places(words: list[bytes], phrase: bytes) -> list[int]:
    """Places of a phrase among the words."""
    joined = b" " + b" ".join(words) + b" "
    wanted, at, out = b" " + phrase + b" ", 0, []
    count, since = 0, 0
    while (at := joined.find(wanted, at)) >= 0:
        count += joined.count(b" ", since, at)
        since = at
        out.append(count)
        at += 1
    return out


def verify(words: list[bytes], template: list[bytes]) -> float:
    """Share of the template's words that the span has in the template's order."""
    return sum(m.size for m in SequenceMatcher(None, words, template, False).get_matching_blocks()) / len(template)


FOUND = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
         "score double, spans array<struct<first:int,stop:int,label:string,share:double>>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None, k: int = K,
         verified: float = VERIFIED, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id and FOUND: counts and places of the base phrases, labels, the best verified share, verified spans."""
    templates = TEMPLATES if templates is None else templates
    phrases = {p.encode(): label for p, label in (BASE if base is None else base).items()}
    parts = [(label, plain_words(t.encode())) for label, t in templates]
    seen = written(spans(docs, templates, k, text=text, **options), "spans")
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _key())
    rows = rows.join(seen.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("share", pa.float64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for t, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = plain_words((t or "").encode())
            places, labels = [], set()
            flat = b" ".join(words)
            for phrase, label in phrases.items():
                if phrase in flat and (own := phrase_places(words, phrase)):
                    places += own
                    labels.add(label)
            fine = []
            for s in marked or []:
                label, template = parts[s["template"]]
                share = verify(words[s["first"]:s["stop"]], template)
                if share >= verified:
                    fine.append({"first": s["first"], "stop": s["stop"], "label": label, "share": share})
            every = labels | {s["label"] for s in fine}
            out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
                        ",".join(sorted(every)), max((s["share"] for s in fine), default=0.0), fine))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))],
                                         names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return arrow_map(rows, run, f"doc_id bigint, {FOUND}")
