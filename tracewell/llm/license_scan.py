"""License scans: an exact set-similarity join of license templates against every block of words of every text.

A template is the set of its distinct words; a block is any run of consecutive words one quarter longer than the template. A block
meets a template if it holds at least `threshold` of the template's words. Words are ordered by how many documents hold them,
rarest first, counted over the whole corpus. Since a match may miss only |T| - need words, it holds one of the first |T| - need + 1
in that order (prefix filter); shorter texts are passed over (length filter); and a place is left when the words of the template
that are still to come can't make up what is missing (positional filter). What remains is counted exactly by a sliding window.

Templates are a short list that travels with the code; texts never leave their task.

Beside the join, `base` finds the fixed phrases word by word; its labels are always part of `labels`.

Nulls and edge cases: a null or blank text has no words, labels "" and score 0; repeated rows are scanned each; long texts are
scanned whole, each place once a phrase and once a template that may be there; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base rule with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Sentences by which public licenses are declared, with the label of each.
TEMPLATES = (
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Distributed under the Boost Software License, Version 1.0", "bsl-1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2"),
)

#: Lowers A-Z and makes every ASCII character that is no digit or letter a space; bytes of other characters stay.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_blocks bigint, spans array<struct<first:bigint,last:bigint,label:string,score:double>>"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def base(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES:
        needle, at, word = b" " + phrase.encode() + b" ", 0, 0
        while (next_ := line.find(needle, at)) >= 0:
            word += line.count(b" ", at, next_)
            found.append((word, label))
            at, word = next_ + 1, word + 1
    return found


class Template:
    def __init__(self, text: str, label: str, threshold: float, order: dict[bytes, tuple]) -> None:
        words = split_words(text)
        self.label, self.block = label, math.ceil(1.25 * len(words))
        self.words = sorted(set(words), key=order.__getitem__)
        self.need = math.ceil(threshold * len(self.words) - 1e-9)
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.prefix = self.words[: len(self.words) - self.need + 1]

    def scan(self, places: list[tuple[int, bytes]]) -> list[tuple[int, int, float]]:
        """(first, last, containment) of the maximal runs in which every block meets the threshold. places: the template's words in the text."""
        held: Counter = Counter()
        runs: list[list] = []
        left = 0
        for i, (at, word) in enumerate(places):
            held[word] += 1
            while places[left][0] <= at - self.block:
                w = places[left][1]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                left += 1
            if len(held) >= self.need:
                share = len(held) / len(self.words)
                if runs and runs[-1][1] >= places[left][0]:
                    runs[-1][1:] = [at, max(runs[-1][2], share)]
                else:
                    runs.append([places[left][0], at, share])
        return [tuple(r) for r in runs]


class Scanner:
    def __init__(self, threshold: float, frequency: dict[bytes, int]) -> None:
        vocabulary = {w for t, _ in TEMPLATES for w in split_words(t)}
        order = {w: (frequency.get(w, 0), w) for w in vocabulary}
        self.templates = [Template(t, label, threshold, order) for t, label in TEMPLATES]
        self.vocabulary = vocabulary
        self.by_prefix: dict[bytes, list[Template]] = {}
        for t in self.templates:
            for w in t.prefix:
                self.by_prefix.setdefault(w, []).append(t)

    def __call__(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        here = self.vocabulary.intersection(words)
        if not here:
            return []
        candidates = {id(t): t for w in here if w in self.by_prefix for t in self.by_prefix[w]}
        found = []
        for t in candidates.values():
            if len(words) < t.need:
                continue  # length filter
            ranks = sorted(t.rank[w] for w in here if w in t.rank)
            # positional filter: after the rarest word that is here, no more than the rest of the template can follow
            if not ranks or min(len(ranks), len(t.words) - ranks[0]) < t.need:
                continue
            places = [(i, w) for i, w in enumerate(words) if w in t.rank]
            found += [(a, b, t.label, s) for a, b, s in t.scan(places)]
        return sorted(found)


def frequencies(docs: DataFrame, *, text: str = "text") -> dict[bytes, int]:
    """Documents that hold each template word; the keys are bounded by the templates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {w for t, _ in TEMPLATES for w in split_words(t)}
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0):
                counts.update(vocabulary.intersection(split_words(body.as_py())))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(task, "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    frequency = frequencies(docs, text=text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(threshold, frequency)
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))]
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(body.as_py())
                places, blocks = base(words), scanner(words)
                own = {label for _, label in places}
                starts = [at for at, _ in places]
                score = max([1.0] * bool(places) + [s for *_, s in blocks], default=0.0)
                rows.append(
                    (doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in blocks})), score, len(blocks))
                    + ([{"first": a, "last": b, "label": label, "score": s} for a, b, label, s in blocks],)
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(task, SCHEMA)
