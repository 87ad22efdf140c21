"""Licence scans by a positional index of rare words.

The index has, for each word of the licence texts, its places in them. Of a file's licence words those with the highest IDF are
looked up first, until each text is served; places in the file less places in the text give where the text would begin, and
these are intersected. Phrases are found when all their words agree; longer texts when enough of their rare words agree within
a slack, their mandatory phrases stand where they should, and enough of their words, weighed by IDF, are in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, steps

# The phrases and labels of the contract, and the wording of public licences with the phrases that each must have.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": ("released under the MIT License", ["under the mit license"]),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ["apache license version 2 0", "in compliance with the license"],
    ),
    "gpl-3.0": ("licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    "gpl-text": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ["gnu general public license", "free software foundation"],
    ),
    "lgpl": ("the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    "agpl-3.0": ("the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    "cc-by-nc-4.0": ("licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-4.0": ("licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international"]),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "following conditions are met"],
    ),
    "isc-text": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
}
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at once.
CHUNK = 1 << 20
#: Rare words that a text longer than a phrase is looked up by, and how many places they may be apart from where they should be.
ANCHORS, SLACK = 5, 8


def split_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part at a time: runs of ASCII letters, lower-cased, digits and characters beyond ASCII."""
    text = text.translate(_TO_WORDS)
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[int, ...]
    keys: tuple[tuple[tuple[int, ...], int], ...] = ()  # mandatory phrases and their places; none: the template is a phrase
    base: bool = False

    @cached_property
    def must(self) -> frozenset[int]:
        """Words that a file must have: those of the mandatory phrases."""
        return frozenset(w for key, _ in self.keys for w in key) if self.keys else frozenset(self.words)


@dataclass
class Index:
    """Licence words by number, templates, and where each word stands in which: word -> template -> places."""

    number: dict[bytes, int] = field(default_factory=dict)
    templates: list[Template] = field(default_factory=list)
    postings: list[dict[int, list[int]]] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, phrases: dict[str, str], templates: dict[str, tuple[str, list[str]]]) -> Index:
        out = cls()
        for phrase, label in phrases.items():
            out._add(Template(label, out._words(phrase), base=True))
        for label, (text, keys) in templates.items():
            words = out._words(text)
            found = []
            for key in map(out._words, keys):
                place = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
                if place is None:
                    raise ValueError(f"{label}: a mandatory phrase isn't part of the text")
                found.append((key, place))
            out._add(Template(label, words, tuple(found)))
        out.weight = [1.0] * len(out.number)
        return out

    def _words(self, text: str) -> tuple[int, ...]:
        words = [w for part in split_words(text.encode()) for w in part]
        if not words:
            raise ValueError("a licence text without words")
        return tuple(self.number.setdefault(w, len(self.number)) for w in words)

    def _add(self, template: Template) -> None:
        self.postings += [{} for _ in range(len(self.number) - len(self.postings))]
        for place, word in enumerate(template.words):
            self.postings[word].setdefault(len(self.templates), []).append(place)
        self.templates.append(template)

    def places(self, text: bytes) -> tuple[int, dict[int, np.ndarray]]:
        """Number of words, and the places of each licence word."""
        n, at, word = 0, [], []
        for words in split_words(text):
            numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
            hit = np.flatnonzero(numbers >= 0)
            at.append(hit + n)
            word.append(numbers[hit])
            n += len(words)
        if not at:
            return n, {}
        at, word = np.concatenate(at), np.concatenate(word)
        order = np.argsort(word, kind="stable")
        at, word = at[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else []
        return n, {int(word[a]): p for a, p in zip(first, np.split(at, first[1:]) if len(word) else [], strict=True)}

    def phrase(self, words: tuple[int, ...], found: dict[int, np.ndarray]) -> np.ndarray:
        """Where all these words stand one after another: rare words' places first, the others' intersected."""
        if any(w not in found for w in words):
            return np.empty(0, np.int64)
        order = sorted(range(len(words)), key=lambda i: (-self.weight[words[i]], i))
        start = found[words[order[0]]] - order[0]
        for i in order[1:]:
            if not len(start):
                break
            start = start[_is_in(start + i, found[words[i]])]
        return start

    def anchors(self, found: dict[int, np.ndarray]) -> dict[int, list[int]]:
        """For each template that the file may hold, its words that the file's rarest licence words are: one for a phrase, else up to ``ANCHORS``."""
        out: dict[int, list[int]] = {}
        open_ = {i: 1 if not t.keys else ANCHORS for i, t in enumerate(self.templates) if t.must <= found.keys()}
        for word in sorted(found, key=lambda w: (-self.weight[w], w)):
            if not open_:
                break
            for t in self.postings[word]:
                if t in open_:
                    out.setdefault(t, []).append(word)
                    open_[t] -= 1
                    if not open_[t]:
                        del open_[t]
        return out

    def scan(self, text: bytes, least: float) -> tuple[int, list[tuple[str, bool, int, int, float]]]:
        """Number of words, and matches (label, whether of a base phrase, first word, end, share), by label, then place."""
        n, found = self.places(text)
        out = []
        for t, words in self.anchors(found).items():
            template = self.templates[t]
            if not template.keys:
                out += [(template.label, template.base, s, s + len(template.words), 1.0) for s in self.phrase(template.words, found).tolist()]
            else:
                out += self._aligned(template, t, words, found, n, least)
        return n, sorted(out)

    def _aligned(self, template: Template, t: int, anchors: list[int], found: dict[int, np.ndarray], n: int, least: float) -> list[tuple[str, bool, int, int, float]]:
        # Each rare word votes for where the text begins, in windows of twice the slack that overlap by half.
        votes = [np.unique(np.concatenate([(found[w] - p) // SLACK + d for p in self.postings[w][t] for d in (0, 1)])) for w in anchors]
        windows, count = np.unique(np.concatenate(votes), return_counts=True)
        windows = windows[count >= min(len(set(template.words)), ANCHORS) * 0.6]
        if not len(windows):
            return []
        # Mandatory phrases must stand where they should; the first says where the text begins.
        begin = np.unique(self.phrase(template.keys[0][0], found) - template.keys[0][1])
        begin = begin[_near(begin, windows * SLACK, 2 * SLACK)]
        for key, place in template.keys[1:]:
            begin = begin[_near(begin + place, self.phrase(key, found), 2 * SLACK)]
        total, inside = 0.0, np.zeros(len(begin))
        for place, word in enumerate(template.words):
            total += self.weight[word]
            if word in found:
                inside += self.weight[word] * _near(begin + place, found[word], SLACK)
        share = inside / total
        return [(template.label, template.base, max(b, 0), min(b + len(template.words), n), s) for b, s in zip(begin.tolist(), share.tolist(), strict=True) if s >= least]


def _is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _near(x: np.ndarray, ordered: np.ndarray, within: int) -> np.ndarray:
    """Which x have one of ``ordered`` within so many places."""
    return np.searchsorted(ordered, x + within, "right") > np.searchsorted(ordered, x - within, "left")


def weighed(docs: DataFrame, index: Index) -> Index:
    """``index`` with the IDF of its words in all documents: log(1 + (N + 1) / (df + 1)). The driver gets one count a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(index.number) + 1, np.int64)
        for batch in steps(batches):
            for text in batch.column("text").to_pylist():
                held[-1] += 1
                held[list({index.number[w] for part in split_words(text or b"") for w in index.number.keys() & set(part)})] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["word", "n"])

    counts = {r.word: r.n for r in docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(len(index.number), 0)
    weight = [log(1 + (n + 1) / (counts.get(w, 0) + 1)) for w in range(len(index.number))]
    return Index(index.number, index.templates, index.postings, weight)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, list[str]]] = TEMPLATES, least: float = 0.75) -> DataFrame:
    """``docs`` with n_words and licences: an array of (label, base, start, end, share), by label and place; places count words from 0.

    Every place of a phrase of ``phrases`` is found, with a share of 1. A longer text is found where its mandatory phrases
    stand and at least ``least`` of its words, weighed by IDF, are within ``SLACK`` words of their places; a stretch that is
    changed so that none of the mandatory phrases is left is not.
    A null or empty text has no words. A very long text is split a MB at a time, and only places of licence words are held.
    Rows stay as they are, repeated ones, null doc_ids and columns of any name too, but for columns named n_words and licences,
    which are replaced. An empty table gives no rows.
    """
    index = weighed(docs, Index.of(phrases, templates))
    kept = docs.drop("n_words", "licences")
    given, names, own = numbered(kept)
    at = names[[c.lower() for c in kept.columns].index("text")]
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    fields = [f.name for f in match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            found = [index.scan(t or b"", least) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            lists = pa.array([[dict(zip(fields, m, strict=True)) for m in ms] for _, ms in found], pa.list_(match))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([n for n, _ in found], pa.int64()), lists], names=[*names, "n_words", "licences"])

    return own(given.mapInArrow(run, f"{kinds}, n_words bigint, licences array<struct<label:string,base:boolean,start:bigint,end:bigint,share:double>>"))
