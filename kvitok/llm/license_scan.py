"""Licence notices in texts by diagonal voting.

Every run of k words of every text is hashed and joined with the runs of the templates. A run that stands at
word p of a text and at word t of a template votes for the diagonal ``p - t``, where that template would begin.
Votes are counted per text, template and diagonal; diagonals at most ``drift`` apart, as words left out or
put in between make them, are merged; and the words of each span that has enough votes are compared with
the template's. A phrase is a template without drift all of whose words must stand there.

Templates are a parameter of at most ``MOST_RUNS`` runs, so their table is broadcast and texts do not move
to be joined. A vote is a few numbers, and votes of one text are counted by its template's words, at most
that many a diagonal. Equal texts are scanned alike but verified once, by their MD5; only texts that may have a
span, by a bitmap of fixed size, are sent to be verified. Long texts are hashed segment by segment.

Null texts count as empty and have no words and no spans. Rows of null or repeated ids get a row each. Other
columns are not read, and an empty table gives no rows. Among spans that overlap by more than half of
the shorter one, those of the largest share stay; ties all stay. Phrases always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvitok.llm.common import ALNUM, LOWER, Words, chained, lists, pieces, signed, small_batches, stored, table
from kvitok.llm.lines import maybe_among

#: Words of a run; a shorter template is one run.
RUN = 4
#: Share of a template's runs that must vote, and share of its words that must stand in the span.
MIN_VOTES = 0.25
MIN_SHARE = 0.7
#: Runs of all templates together: at most some 20 MB are broadcast.
MOST_RUNS = 1 << 19
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20

# Phrases that count by themselves, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The customary wording of notices, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        "lgpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)

#: A byte that no word holds.
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

SPAN = "struct<label:string,template:int,base:boolean,first_word:long,n_words:int,share:double>"


@dataclass(frozen=True)
class Template:
    """Words to look for; ``base`` ones must stand there whole."""

    words: tuple[bytes, ...]
    label: str
    base: bool

    @property
    def run(self) -> int:
        return len(self.words) if self.base else min(RUN, len(self.words))

    @property
    def drift(self) -> int:
        return 0 if self.base else max(1, len(self.words) // 8)

    @property
    def least_votes(self) -> int:
        runs = len(self.words) - self.run + 1
        return runs if self.base else max(1, int(np.ceil(MIN_VOTES * runs)))


def template_list(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> list[Template]:
    out = []
    for base, given in ((True, phrases), (False, notices)):
        for text, label in given:
            w = Words([text.encode()], ALNUM)
            words = tuple(w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends))
            if not words:
                raise ValueError("a template needs words")
            out.append(Template(words, label, base))
    return out


def template_runs(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """``hash, template, at``: every run of every template."""
    rows = []
    for number, t in enumerate(templates):
        h = Words([b" ".join(t.words)], ALNUM).hashes()
        runs = chained(h, t.run)[: len(h) - t.run + 1]
        rows += [(int(x), number, at) for at, x in enumerate(signed(runs))]
    if len(rows) > MOST_RUNS:
        raise ValueError(f"templates have {len(rows)} runs, more than {MOST_RUNS}")
    return spark.createDataFrame(rows, "hash long, template int, at int")


def segments(text: bytes, overlap: int, size: int = SEGMENT) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long text between words, each with the number of its first word; neighbours share ``overlap`` words."""
    begin, number = 0, 0
    while True:
        end = begin + size
        gap = _GAP.search(text, end)
        end = gap.start() if gap else len(text)
        piece = text[begin:end]
        yield number, piece
        if end >= len(text):
            return
        starts = Words([piece], ALNUM).starts - 1
        keep = min(overlap, max(0, len(starts) - 1))
        number += len(starts) - keep
        begin = end if not keep else begin + int(starts[len(starts) - keep])


def _hash_runs(batches: Iterable[pa.RecordBatch], sizes: Sequence[int], segment: int) -> Iterator[pa.RecordBatch]:
    most = max(sizes)
    for batch, texts in pieces(batches):
        if len(texts) == 1 and texts[0] and len(texts[0]) > segment:
            groups = [(np.zeros(1, int), number, [piece]) for number, piece in segments(texts[0], most - 1, segment)]
        else:
            groups = [(np.arange(len(texts)), 0, texts)]
        for rows, number, group in groups:
            words = Words(group, ALNUM)
            h, room = words.hashes(), words.room()
            for k in sizes:
                whole = room >= k
                counts = np.bincount(words.doc[whole], minlength=len(group))
                some = np.flatnonzero(counts)
                if len(some):
                    columns = [batch.column(0).take(pa.array(rows[some])), pa.array(np.full(len(some), number, np.int64)), lists(signed(chained(h, k)[whole]), counts[some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "first", "hashes"])


def votes(texts: DataFrame, templates: Sequence[Template], segment: int = SEGMENT) -> DataFrame:
    """``key, template, diagonal, runs``: which runs of a template vote for a diagonal of a text."""
    sizes = sorted({t.run for t in templates})
    hashed = texts.select("key", "text").mapInArrow(lambda b: _hash_runs(b, sizes, segment), "key binary, first long, hashes array<long>")
    placed = hashed.select("key", "first", F.posexplode("hashes").alias("_at", "hash"))
    known = F.broadcast(template_runs(texts.sparkSession, templates))
    hits = placed.join(known, "hash").select("key", "template", (F.col("first") + F.col("_at") - F.col("at")).alias("diagonal"), "at")
    return hits.groupBy("key", "template", "diagonal").agg(F.collect_set("at").alias("runs"))


def candidate_spans(voted: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``key, template, first, last``: merged diagonals with enough votes, and the words where the template would stand."""
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))
    by_text = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_text) > of([t.drift for t in templates])
    numbered = voted.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_no", F.sum("_new").over(by_text))
    merged = numbered.groupBy("key", "template", "_no").agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum(F.size("runs")).alias("n"))
    enough = merged.where(F.col("n") >= of([t.least_votes for t in templates]))
    return enough.select("key", "template", F.greatest("first", F.lit(0)).alias("first"), (F.col("last") + of([len(t.words) for t in templates])).alias("last"))


def common_words(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """Length of the longest common subsequence, a bit of a number for each word of ``b``."""
    at: dict[bytes, int] = {}
    for k, word in enumerate(b):
        at[word] = at.get(word, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        hit = row & at.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def verified_spans(text: bytes | None, found: Iterable[dict], templates: Sequence[Template]) -> list[dict]:
    """Spans whose words are those of their template, in the order of the text."""
    words = Words([text], ALNUM)
    spans = []
    for span in found:
        t = templates[span["template"]]
        first, last = span["first"], min(span["last"], len(words))
        here = [words.data[a:b].tobytes() for a, b in zip(words.starts[first:last], words.ends[first:last])]
        share = common_words(here, t.words) / max(len(here), len(t.words))
        if share >= (1 if t.base else MIN_SHARE):
            spans.append({"label": t.label, "template": span["template"], "base": t.base, "first_word": first, "n_words": len(here), "share": share})
    spans.sort(key=lambda s: (s["first_word"], s["template"]))
    notices = [s for s in spans if not s["base"]]
    kept, open_ = [], []
    for k, s in enumerate(notices):
        # Only spans that reach this far, and those that begin before its end, can overlap it.
        open_ = [o for o in open_ if o["first_word"] + o["n_words"] > s["first_word"]]
        later = []
        for o in notices[k + 1 :]:
            if o["first_word"] >= s["first_word"] + s["n_words"]:
                break
            later.append(o)
        if not any(o["share"] > s["share"] and _overlap(o, s) * 2 > min(o["n_words"], s["n_words"]) for o in open_ + later):
            kept.append(s)
        open_.append(s)
    return sorted([s for s in spans if s["base"]] + kept, key=lambda s: (s["first_word"], s["template"]))


def _overlap(a: dict, b: dict) -> int:
    return min(a["first_word"] + a["n_words"], b["first_word"] + b["n_words"]) - max(a["first_word"], b["first_word"])


def _verify(batches: Iterable[pa.RecordBatch], templates: Sequence[Template]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64())])
    for batch, texts in pieces(batches):
        spans = [verified_spans(t, found.as_py(), templates) for t, found in zip(texts, batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["key", "spans"])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches):
        inside = [ALNUM[LOWER[np.frombuffer(b"\n" + (t or b""), np.uint8)]] for t in texts]
        n = [int(np.count_nonzero(x[1:] & ~x[:-1])) for x in inside]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "key", "n_words"])


def scan_licenses(docs: DataFrame, templates: Sequence[Template] | None = None, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, n_words, spans``: for every row of ``docs`` its words and the licence spans found in it."""
    spark = docs.sparkSession
    small_batches(spark)
    templates = list(templates or template_list())
    texts = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), "text")
    found = candidate_spans(votes(texts, templates, segment), templates)
    by_text = found.groupBy("key").agg(F.collect_list(F.struct("template", "first", "last")).alias("found"))
    by_text = stored(by_text.withColumn("hash", F.xxhash64("key")), "license-spans")
    some = maybe_among(texts.select("key", "text", F.xxhash64("key").alias("hash")), by_text.select("hash"))
    once = some.groupBy("key").agg(F.first("text").alias("text"))
    spans = once.join(by_text.drop("hash"), "key").select("key", "text", "found").mapInArrow(lambda b: _verify(b, templates), f"key binary, spans array<{SPAN}>")
    spans = spans.where(F.size("spans") > 0)
    layout = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.BinaryType()), T.StructField("n_words", T.LongType())])
    counted = texts.mapInArrow(_count, layout)
    none = F.array().cast(f"array<{SPAN}>")
    return counted.join(spans, "key", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the places of the phrases, the labels of phrases and notices, and the best share of a template."""
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
