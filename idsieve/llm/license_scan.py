"""Licence scans by diagonal voting.

Every rolling word k-gram of every text is joined to the positions at which a template has it. A hit
at word i of the text and word j of the template votes for the diagonal i - j; a copied passage fills
one diagonal, and each inserted or dropped word moves it to a neighbouring one. Runs of hits on
neighbouring diagonals are merged where they go on in both the text and the template, in the way that covers
most of the template, and the span that they give is verified: it counts when the words that both have
are enough of the template and of the span. What stands beside a notice, such as a second copy of it or
stray words of it, makes spans of its own.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as B

GRAM_WORDS = 2
MAX_SHIFT = 3  # words between neighbouring diagonals of one span
MIN_COVER = 0.8
MAX_TEMPLATE_WORDS = 100_000  # all templates together; they are sent to every task


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


# Phrases that must stand as they are, and their labels.
PHRASES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
]
# Sentences of public licences and usual notices.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "This software is released under the MIT License"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    Template("reserved", "All rights reserved"),
]
TEMPLATES = [*PHRASES, *NOTICES]
_DOCUMENT = -1  # the template number of the row that each text has of itself


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return B.word_hashes(raw, np.array([0, len(raw)]))[0]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    return B.gram_hashes(words, np.array([0, len(words)]), k)[0].view(np.int64) if len(words) >= k else np.zeros(0, np.int64)


def template_positions(spark: SparkSession, templates: list[Template], k: int) -> tuple[DataFrame, list[int]]:
    """(hash, template, at) for every k-gram of every template, and the templates' numbers of words."""
    words = [_words(t.text) for t in templates]
    if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
    if short := [t.text for t, w in zip(templates, words, strict=True) if len(w) < k]:
        raise ValueError(f"templates need {k} words or more: {short}")
    rows = [(h, n, at) for n, w in enumerate(words) for at, h in enumerate(_grams(w, k).tolist())]
    return spark.createDataFrame([*rows, (0, _DOCUMENT, 0)], "hash long, template int, at int"), [len(w) for w in words]


def rolling_grams(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest of the text, n_words and the hashes of all k-grams; the first hash is always 0, for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.chunked(B.as_strings(batch.column("text"))):
                words, first = B.word_hashes(data, offsets)
                grams, begin = B.gram_hashes(words, first, k)
                counts = np.diff(first)
                grams[grams == 0] = 1
                short = np.flatnonzero((counts < k) & (counts > 0))
                grams[begin[short]] = 1  # no k-gram: matches nothing
                cut = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "digest")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(counts.astype(np.int64)), B.lists(np.insert(grams.view(np.int64), begin[:-1], 0), begin + np.arange(hi - lo + 1))], ["doc_id", "digest", "n_words", "grams"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, n_words long, grams array<long>")


@dataclass(frozen=True)
class Run:
    """Words that a text and a template have in common, one after the other: from ``i`` in the text and ``j`` in the template."""

    i: int
    j: int
    size: int


def runs_of(diagonal: int, at: list[int], k: int) -> list[Run]:
    """The runs on a diagonal, from the template positions of its hits."""
    out, first = [], None
    at = sorted(at)
    for n, j in enumerate(at):
        first = j if first is None else first
        if n + 1 == len(at) or at[n + 1] != j + 1:
            out.append(Run(diagonal + first, first, j - first + k))
            first = None
    return out


def added(a: Run, b: Run, shift: int) -> int:
    """Words that b adds to a span that ends with a; 0 if b does not go on from there."""
    if not (a.i < b.i and a.j < b.j and a.i + a.size < b.i + b.size and a.j + a.size < b.j + b.size and abs((b.i - b.j) - (a.i - a.j)) <= shift):
        return 0
    return max(0, b.size - max(0, a.i + a.size - b.i, a.j + a.size - b.j))


def spans_of(runs: list[Run], size: int, shift: int, cover: float) -> list[tuple[int, int, float]]:
    """(start, words, score) of the spans of a template of ``size`` words, in the order of the text.

    A span begins and ends with a run and holds runs of which each goes on from the one before; its score is
    the number of words in the runs over that of the template or the span, whichever is larger. Of spans that
    overlap, the one with the higher score counts, or else the first, or else the shorter.
    """
    runs = sorted(runs, key=lambda r: (r.i, r.j))
    found = []
    for n, head in enumerate(runs):
        end = head.i + size / cover + 1e-9  # a longer span cannot be covered enough
        best = {n: head.size}
        for m in range(n + 1, len(runs)):
            if runs[m].i >= end:
                break
            if runs[m].i + runs[m].size <= end:
                most = max((b + new for p, b in best.items() if (new := added(runs[p], runs[m], shift))), default=0)
                if most:
                    best[m] = most
        for m, covered in best.items():
            length = runs[m].i + runs[m].size - head.i
            score = covered / max(size, length)
            if score >= cover - 1e-9:
                found.append((-score, head.i, length))
    starts: list[int] = []
    out: list[tuple[int, int, float]] = []
    for score, start, length in sorted(found):
        at = bisect(starts, start)
        if (at == 0 or out[at - 1][0] + out[at - 1][1] <= start) and (at == len(out) or start + length <= out[at][0]):
            starts.insert(at, start)
            out.insert(at, (start, length, -score))
    return out


_SPAN = pa.struct([("template", pa.int32()), ("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("size", pa.int64()), ("score", pa.float64())])


def merged(votes: DataFrame, templates: list[Template], sizes: list[int], k: int, shift: int, cover: float) -> DataFrame:
    """Rows with votes (template, diagonal, at and n) of one text, to its number of words, copies and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("votes")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            template, diagonal, n, at = (flat.field(f) for f in ("template", "diagonal", "n", "at"))
            template, diagonal, n = (x.to_numpy() for x in (template, diagonal, n))
            at_from = at.offsets.to_numpy()
            hits = np.diff(at_from)
            at = at.values.to_numpy()
            n_words, copies = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            of = template == _DOCUMENT
            n_words[rows[of]], copies[rows[of]] = diagonal[of], n[of]
            size = np.array([*sizes, 0])[template]
            exact = np.array([*(t.exact for t in templates), True])[template]
            spans: dict[int, list] = {}
            for v in np.flatnonzero(exact & ~of & (hits == size - k + 1)).tolist():
                t = int(template[v])
                spans.setdefault(int(rows[v]), []).append((t, templates[t].label, True, int(diagonal[v]), sizes[t], 1.0))
            # a template whose hits cannot cover enough of it has no span
            group, back = np.unique(rows * len(sizes) + template, return_inverse=True)
            likely = ~exact & (np.bincount(back, hits)[back] * k >= cover * size - 1e-9) if len(group) else exact
            order = np.flatnonzero(likely)
            order = order[np.argsort(back[order], kind="stable")]
            for own in np.split(order, np.flatnonzero(np.diff(back[order])) + 1):
                if len(own):
                    t = int(template[own[0]])
                    runs = [r for v in own.tolist() for r in runs_of(int(diagonal[v]), at[at_from[v] : at_from[v + 1]].tolist(), k)]
                    spans.setdefault(int(rows[own[0]]), []).extend((t, templates[t].label, False, *s) for s in spans_of(runs, sizes[t], shift, cover))
            made = [sorted(spans.get(r, ()), key=lambda s: (s[3], s[0])) for r in range(batch.num_rows)]
            names = [f.name for f in _SPAN]
            made = pa.array([[dict(zip(names, s, strict=True)) for s in own] for own in made], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n_words), pa.array(copies), made], ["doc_id", "digest", "n_words", "copies", "spans"])

    return votes.mapInArrow(run, "doc_id long, digest long, n_words long, copies long, spans array<struct<template: int, label: string, exact: boolean, start: long, size: long, score: double>>")


def scan(docs: DataFrame, templates: list[Template] | None = None, k: int = GRAM_WORDS, shift: int = MAX_SHIFT, cover: float = MIN_COVER) -> DataFrame:
    """doc_id, digest, n_words, copies and spans (template, label, exact, start, size, score) of each different row.

    Rows of equal doc_id and text are one row, with their number in ``copies``. A null text is an empty one.
    """
    templates = templates or TEMPLATES
    places, sizes = template_positions(docs.sparkSession, templates, k)
    key = ["doc_id", "digest"]
    hits = (
        rolling_grams(docs, k)
        .select(*key, "n_words", F.posexplode("grams").alias("word", "hash"))
        .join(F.broadcast(places), "hash")
        .select(*key, "template", F.when(F.col("template") == _DOCUMENT, F.col("n_words")).otherwise(F.col("word") - 1 - F.col("at")).alias("diagonal"), "at")
    )
    votes = hits.groupBy(*key, "template", "diagonal").agg(F.collect_set("at").alias("at"), F.count("*").alias("n"))
    votes = votes.groupBy(*key).agg(F.collect_list(F.struct("template", F.col("diagonal").cast("long").alias("diagonal"), "at", "n")).alias("votes"))
    return merged(votes, templates, sizes, k, shift, cover)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every text.

    Null or empty text: no words, no labels, score 0. Repeated rows: a result each. Null doc_id: kept.
    An empty table gives no rows; further columns are left aside.
    """
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    rows = rows.withColumn("base", base).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
