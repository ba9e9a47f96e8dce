"""Licences by a positional index of rare template words."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

# Base phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label -> (public notice text, phrases of which one must stand there). Words as in ta.ALNUM, lower case.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
            ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    "mit-notice": ("released under the mit license", ["the mit license", "mit licensed"]),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    "cc-by-nc": ("licensed under creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    "cc-by-nc-notice": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
}
#: Notices that count as the label before the dash.
SHORT = {"mit-notice": "mit", "cc-by-nc-notice": "cc-by-nc"}

#: Words that an alignment may be off; share of a template's weight that must be aligned.
SLACK, COVERED = 3, 0.6

#: Rows that a table of templates may have; a larger one is refused, not cut.
TEMPLATE_ROWS = 20_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _split(text: str | None) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Notices(NamedTuple):
    """Templates as word numbers: (label, words, mandatory phrases); and the words by number."""

    words: list[str]
    number: dict[str, int]
    templates: list[tuple[str, np.ndarray, list[tuple[int, ...]]]]


def notices(templates: list[tuple[str, str, list[str]]]) -> Notices:
    """The templates (label, text, phrases); one without words or without a phrase of words is left out."""
    split = [(label, _split(text), [p for p in map(_split, phrases or []) if p]) for label, text, phrases in templates]
    words = sorted({w for _, text, phrases in split for t in (text, *phrases) for w in t} | {w for p in BASE for w in p.split()})
    number = {w: i for i, w in enumerate(words)}
    coded = [(label, np.array([number[w] for w in text]), [tuple(number[w] for w in p) for p in phrases]) for label, text, phrases in split if label and text and phrases]
    return Notices(words, number, coded)


KNOWN = notices([(SHORT.get(label, label), text, phrases) for label, (text, phrases) in TEMPLATES.items()])
WORDS, NUMBER = KNOWN.words, KNOWN.number


def read_notices(table: DataFrame, rows: int = TEMPLATE_ROWS) -> Notices:
    """The templates of a table (label string, text string, phrases array<string>) of at most `rows` rows."""
    found = [tuple(r) for r in table.select("label", "text", "phrases").limit(rows + 1).collect()]
    if len(found) > rows:
        raise ValueError(f"more than {rows} templates")
    return notices(sorted(found, key=repr))


def _key(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(ta.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _licence_words(column, words: list[str] = WORDS):
    """(first row, rows, row of each word, number of each word or -1)."""
    keys = np.array([_key(w) for w in words], np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    longest = max(len(w.encode()) for w in words)
    for first, data, offsets in ta.blocks(column):
        data = ta.LOWER[data]
        starts, ends, rows = ta.words(data, offsets, ta.ALNUM)
        number = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(ends - starts <= longest)
        hashes = ta.word_hashes(data, starts[short], ends[short])
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        same = keys[at] == hashes
        number[short[same]] = order[at[same]]
        yield first, len(offsets) - 1, rows, number


def _frequencies(words: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for _, n, rows, number in _licence_words(batch.column(0), words):
                documents += n
                pairs = np.unique(rows[number >= 0] * len(words) + number[number >= 0])
                total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words))), pa.array(np.concatenate([[documents], total]))], names=["word", "n"])

    return run


def rarity(docs: DataFrame, known: Notices = KNOWN) -> np.ndarray:
    """Inverse document frequency of each licence word over all texts; one number a word comes to the driver."""
    counts = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(_frequencies(known.words), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    documents = counts.get(-1, 0)
    return np.array([math.log((documents + 1) / (counts.get(i, 0) + 1)) + 0.01 for i in range(len(known.words))])


def _runs(number: np.ndarray, rows: np.ndarray, phrase: tuple[int, ...]) -> np.ndarray:
    """Where the words of a phrase stand one behind the other in one row."""
    n = len(number) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:n] == phrase[0])
    at = at[rows[at + len(phrase) - 1] == rows[at]]
    for i, w in enumerate(phrase[1:], 1):
        at = at[number[at + i] == w]
    return at


def _matcher(weights: np.ndarray, known: Notices = KNOWN) -> Callable:
    postings: dict[int, list[tuple[int, int]]] = {}  # word -> (template, place)
    totals = np.array([weights[numbers].sum() for _, numbers, _ in known.templates])
    anchors = np.zeros(len(known.words) + 1, bool)  # the rarest word of each mandatory phrase
    anchored: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for k, (_, numbers, phrases) in enumerate(known.templates):
        for place, w in enumerate(numbers.tolist()):
            postings.setdefault(w, []).append((k, place))
        for phrase in phrases:
            rarest = max(phrase, key=lambda w: weights[w])
            anchors[rarest] = True
            anchored.setdefault(rarest, []).append((k, phrase))
    base_phrases = [(tuple(known.number[w] for w in phrase.split()), label) for phrase, label in BASE.items()]

    def matched(number: np.ndarray) -> dict[str, float]:
        """Label -> share of the template's weight at the right relative places, for one text."""
        where: dict[int, np.ndarray] = {}

        def places(w: int) -> np.ndarray:
            if w not in where:
                where[w] = np.flatnonzero(number == w)
            return where[w]

        def within(sorted_: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return np.searchsorted(sorted_, low, "left") < np.searchsorted(sorted_, high, "right")

        own = np.unique(number[number >= 0])
        here = np.zeros(len(known.words), bool)
        here[own] = True
        same, hits = np.zeros(len(number), np.int8), {}
        for w in own[anchors[own]].tolist():
            for k, phrase in anchored[w]:
                if here[list(phrase)].all() and len(at := _runs(number, same, phrase)):
                    hits.setdefault(k, []).append(at)
        # What an alignment that counts may still miss of each template, after the words that the text lacks.
        spare = {k: (1 - COVERED) * totals[k] + 1e-9 - weights[known.templates[k][1][~here[known.templates[k][1]]]].sum() for k in hits}
        open_ = {k for k, left in spare.items() if left >= 0}
        votes: dict[int, list[np.ndarray]] = {k: [] for k in open_}
        for w in own[np.argsort(-weights[own], kind="stable")].tolist():
            if not open_:
                break
            named = [(k, place) for k, place in postings.get(w, ()) if k in open_]
            for k, place in named:
                votes[k].append(places(w) - place)
                spare[k] -= weights[w]
            open_ -= {k for k, _ in named if spare[k] < 0}
        out: dict[str, float] = {}
        for k, starts in votes.items():
            label, numbers, _ = known.templates[k]
            if not starts:
                continue
            found = np.sort(np.concatenate(hits[k]))
            # Every cell whose reach holds the start that a rare word votes for.
            cells = np.unique(np.concatenate([np.concatenate(starts) // (SLACK + 1) + j for j in range(-2, 2)]))
            low, high = cells * (SLACK + 1) - SLACK, (cells + 1) * (SLACK + 1) + SLACK
            near = within(found, low, high + len(numbers))
            low, high = low[near], high[near]
            covered = np.zeros(len(low))
            for place, w in enumerate(numbers.tolist()):
                covered += weights[w] * within(places(w), low + place, high + place)
            share = float(covered.max(initial=0.0) / totals[k])
            if share >= COVERED:
                out[label] = max(out.get(label, 0.0), min(1.0, share))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, rows, number in _licence_words(batch.column(1), known.words):
                bounds = np.searchsorted(rows, np.arange(n + 1))
                counts, base = np.zeros(n, np.int64), [set() for _ in range(n)]
                least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for phrase, label in base_phrases:
                    at = _runs(number, rows, phrase)
                    of = rows[at]
                    place = at - bounds[of]
                    counts += np.bincount(of, minlength=n)
                    np.minimum.at(least, of, place)
                    np.maximum.at(most, of, place)
                    for row in np.unique(of).tolist():
                        base[row].add(label)
                found: list[dict[str, float]] = [{label: 1.0 for label in labels} for labels in base]
                for row in np.unique(rows[anchors[number]]).tolist():
                    for label, share in matched(number[bounds[row] : bounds[row + 1]]).items():
                        found[row][label] = max(share, found[row].get(label, 0.0))
                listed = pa.array([sorted(x) for x in base], pa.list_(pa.string()))
                labels = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
                scores = pa.array([max(x.values(), default=0.0) for x in found], pa.float64())
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(bounds), pa.int64()), pa.array(counts, pa.int64()), pa.array(least, pa.int64(), mask=~some), pa.array(most, pa.int64(), mask=~some), listed, labels, scores],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score.

    Each text looks up its licence words, the rarest over all texts first, in a
    positional index of the templates, and their postings vote for the places
    where a template may start. A text goes on until the words it has looked up,
    and those it lacks, weigh more than an alignment may miss, so that no place
    is lost. A template counts if one of its mandatory phrases stands there and
    enough of its weight is aligned, whatever else the text holds. Base phrases
    are found at every place and always count.

    `templates` is a table (label, text, phrases) of at most TEMPLATE_ROWS rows
    that stands in for the built-in one; rows without label, words or phrases
    are left out, and several texts may share a label.

    A null or empty text has no words, no labels and score 0. Repeated rows,
    and rows without doc_id, are scanned each. An empty table gives no rows.
    Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double"
    known = KNOWN if templates is None else read_notices(templates)
    return docs.mapInArrow(_matcher(rarity(docs, known), known), schema)
