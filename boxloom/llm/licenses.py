"""License scans by a positional index of license texts' rarest words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import pack
from boxloom.llm.decontam import words_of

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, notice text, phrases that must stand near it.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", ("in compliance with the license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("free software", "gnu general public license")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)


class Index:
    """Postings of template words and their weights by rarity in the corpus."""

    def __init__(self, templates: tuple, counts: dict[str, int], n_docs: int) -> None:
        self.label = [t[0] for t in templates]
        self.words = [words_of(t[1].encode()) for t in templates]
        self.phrases = [[words_of(p.encode()) for p in t[2]] for t in templates]
        self.idf = {w: math.log((n_docs + 1) / (counts.get(w.decode(), 0) + 1)) + 1.0 for ws in self.words for w in ws}
        self.total = [sum(self.idf[w] for w in ws) for ws in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, ws in enumerate(self.words):
            for place, w in enumerate(ws):
                self.postings.setdefault(w, []).append((t, place))
        self.rarest = sorted(self.postings, key=lambda w: (-self.idf[w], w))

    def lookups(self, have: set[bytes], share: float) -> dict[bytes, set[int]]:
        """Words to look up in a file that has these licence words, each with the templates it is looked up for.

        They are the file's rarest: for a template, as many as it takes until the others that the
        file has can't weigh ``share`` of it any more. So whatever stretch of the file weighs
        enough has one of them. Templates that all of the file's words don't weigh enough for get none.
        """
        spare = [-share * total for total in self.total]
        order = [w for w in self.rarest if w in have]
        for w in order:
            for t, _ in self.postings[w]:
                spare[t] += self.idf[w]
        found: dict[bytes, set[int]] = {}
        for w in order:
            for t in {t for t, _ in self.postings[w]}:
                # A hair's breadth of weight is kept against rounding.
                if spare[t] >= -1e-9:
                    found.setdefault(w, set()).add(t)
            for t, _ in self.postings[w]:
                if t in found.get(w, ()):
                    spare[t] -= self.idf[w]
        return found


def vocabulary(templates: tuple = TEMPLATES) -> set[bytes]:
    return {w for t in templates for w in words_of(t[1].encode())}


def document_counts(docs: DataFrame, templates: tuple = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all documents each template word occurs, and the number of documents.

    The answer has a number for each template word; only those reach the driver.
    """
    known = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            counts[""] += batch.num_rows
            for text in batch.column(0).cast(pa.large_binary()):
                counts.update(w.decode() for w in known.intersection(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    rows = docs.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {r["w"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def _phrase_starts(words: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
    """Starts of a phrase's words standing consecutively in words[low:high]."""
    found, at, k = [], low, len(phrase)
    high = len(words) if high is None else min(high, len(words))
    while True:
        try:
            at = words.index(phrase[0], at, high)
        except ValueError:
            return found
        if at + k <= high and words[at : at + k] == phrase:
            found.append(at)
        at += 1


def weight(words: list[bytes], index: Index, t: int, start: int, drift: int) -> float:
    """Share of a template's weight that stands within ``drift`` words of its places if it starts at ``start``."""
    agree = 0.0
    for k, w in enumerate(index.words[t]):
        if w in words[max(0, start + k - drift) : max(0, start + k + drift + 1)]:
            agree += index.idf[w]
    return agree / index.total[t]


def align(words: list[bytes], index: Index, drift: int, share: float) -> list[tuple[str, int, int, float]]:
    """Label, first word, last word and weight of every stretch that is a template.

    The file's rarest licence words are looked up; each place of one, less its places in a
    template's postings, says where the template would start, give or take ``drift`` words. Where
    starts of a template agree closely the heaviest counts, the first of equals.
    """
    found: list[tuple[str, int, int, float]] = []
    lookups = index.lookups(index.postings.keys() & set(words), share)
    starts: dict[int, set[int]] = {}
    for at, w in enumerate(words if lookups else ()):
        for t, place in index.postings[w] if w in lookups else ():
            if t in lookups[w]:
                starts.setdefault(t, set()).update(range(at - place - drift, at - place + drift + 1))
    for t, places in starts.items():
        n, best = len(index.words[t]), None
        for start in sorted(places):
            score = weight(words, index, t, start, drift)
            low, high = max(0, start - drift), start + n + drift
            if score < share or not all(_phrase_starts(words, p, low, high) for p in index.phrases[t]):
                continue
            if best is not None and start > best[0] + n - 1:
                found.append((index.label[t], max(best[0], 0), min(best[0] + n, len(words)) - 1, best[1]))
                best = None
            if best is None or score > best[1]:
                best = (start, score)
        if best is not None:
            found.append((index.label[t], max(best[0], 0), min(best[0] + n, len(words)) - 1, best[1]))
    return found


def scan(text: bytes, index: Index, drift: int = 2, share: float = 0.6) -> dict:
    """Base phrases and aligned templates of one text.

    A template counts where words at their places, within ``drift`` words, weigh at least ``share``
    of it and every mandatory phrase stands in that stretch.
    """
    words = words_of(text)
    base: dict[str, list[int]] = {}
    first, last, n = None, None, 0
    if b"license" in text.lower():
        for phrase, label in BASE.items():
            if places := _phrase_starts(words, phrase.encode().split()):
                base.setdefault(label, []).extend(places)
        if starts := [p for x in base.values() for p in x]:
            first, last, n = min(starts), max(starts), len(starts)
    found = align(words, index, drift, share)
    labels = sorted({*base, *(f[0] for f in found)})
    score = 1.0 if base else max((f[3] for f in found), default=0.0)
    return {"n_words": len(words), "n_base": n, "first_word": first, "last_word": last, "base_labels": sorted(base), "labels": labels, "score": min(1.0, score), "spans": sorted(found, key=lambda f: (f[1], f[0]))}


NAMES = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCANNED = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,first:long,last:long,score:double>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each document: base phrases, labels, score and the aligned notices.

    Words weigh by their rarity in all documents, counted first. ``first_word`` and ``last_word``
    are the base phrases' smallest and largest start, or null. Null texts count as empty, with no
    labels and score 0. Ids are not read, so null and repeated ids are fine; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = pack(docs, id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    counts, n_docs = document_counts(rows.select("text"), templates)
    index = Index(templates, counts, n_docs)
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t.as_py() or b"", index) for t in batch.column(1).cast(pa.large_binary())]
            columns = [batch.column(0)]
            columns += [pa.array([g[k] for g in got], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
            columns += [pa.array([",".join(g[k]) for g in got], pa.string()) for k in ("base_labels", "labels")]
            columns += [pa.array([g["score"] for g in got], pa.float64())]
            columns += [pa.array([[dict(zip(("label", "first", "last", "score"), s, strict=True)) for s in g["spans"]] for g in got], span)]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return rows.mapInArrow(run, SCANNED)
