r"""License scans: fuzzy search for short notices, and exact phrases.

A text is lower-cased (A-Z), cut to its words and joined by single spaces, so that
punctuation, line ends and case make no difference. A notice of m characters may
differ by k = m // ``SLACK`` edits. Pigeonhole: cut in k + 1 pieces, one of them is
untouched by k edits, so its pieces are exact seeds; one Aho-Corasick pass over a
text finds the seeds of all notices and the exact phrases. Around each seed lies one
window of m + 2k characters in which its notice can stand, and there the ``regex``
library's bounded-error matching decides and gives the match of fewest edits.
Windows that read alike are matched once a worker (a bounded memory).

Nothing is shuffled: a row's result is of its text alone, so a document is one task's
work whatever the table's size, and a lost executor's rows are read again.

Defined results: a null text is empty; texts without words have no places, no labels
and score 0; texts of any length are searched whole; places of a phrase may overlap
(each counts); of one notice's matches that overlap the one with fewest edits stays,
then the first; matches of different notices may overlap; the score is 1 with an
exact phrase or an exact notice, else 1 less the least share of edits, else 0;
repeated rows are all returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Characters of a notice for each edit that it bears.
SLACK = 12
#: Windows whose match a worker remembers.
REMEMBERED = 20_000

#: Exact phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Openings and core sentences of public notices, as words.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Span(NamedTuple):
    """A match: ``start`` and ``stop`` in code points of the text, ``first`` and ``last`` its words, ``size`` the notice's characters."""

    label: str
    start: int
    stop: int
    first: int
    last: int
    errors: int
    size: int


class Found(NamedTuple):
    n_words: int
    places: list[tuple[int, str]]
    spans: list[Span]


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(place, piece): ``errors`` + 1 pieces that make up the notice."""
    cuts = [i * len(notice) // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds phrases and notices in texts."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, slack: int = SLACK) -> None:
        self.labels = [label for label, _ in notices]
        self.notices = [" ".join(_WORD.findall(text.lower())) for _, text in notices]
        self.errors = [len(n) // slack for n in self.notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n)}){{e<={k}}}") for n, k in zip(self.notices, self.errors)]
        wanted: dict[str, list[tuple[int, int | str]]] = {}
        for phrase, label in phrases:
            wanted.setdefault(f" {phrase} ", []).append((-1, label))
        for j, (n, k) in enumerate(zip(self.notices, self.errors)):
            for place, piece in seeds(n, k):
                wanted.setdefault(piece, []).append((j, place))
        self.automaton = ahocorasick.Automaton()
        for s, what in wanted.items():
            self.automaton.add_word(s, (len(s), what))
        if wanted:
            self.automaton.make_automaton()
        self.best = lru_cache(REMEMBERED)(self._best)

    def _best(self, j: int, window: str) -> tuple[int, int, int] | None:
        """The notice's match of fewest edits: (start, stop, edits)."""
        m = self.patterns[j].search(window)
        return m and (m.start(), m.end(), sum(m.fuzzy_counts))

    def scan(self, text: str | None) -> Found:
        words = (text or "").encode("utf-8", "replace").translate(_BYTES).split()
        if not words or not len(self.automaton):
            return Found(len(words), [], [])
        s = f" {b' '.join(words).decode()} "
        at, windows = [], {}
        for end, (size, what) in self.automaton.iter(s):
            start = end + 1 - size
            for j, x in what:
                if j < 0:
                    at.append((start, x))
                else:
                    low = start - x - self.errors[j]
                    windows.setdefault((j, max(low, 0)), low + len(self.notices[j]) + 2 * self.errors[j])
        if not at and not windows:
            return Found(len(words), [], [])
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for (j, low), high in windows.items():
            if m := self.best(j, s[low:high]):
                matches.setdefault(j, []).append((m[2], low + m[0], low + m[1]))
        spaces = [m.start() for m in re.finditer(" ", s)]
        # the word that begins behind the i-th space is word i
        places = sorted((bisect_left(spaces, start), label) for start, label in at)
        return Found(len(words), places, self._spans(text, s, spaces, matches))

    def _spans(self, text: str, s: str, spaces: list[int], matches: dict[int, list[tuple[int, int, int]]]) -> list[Span]:
        kept = []
        for j, found in matches.items():
            taken: list[tuple[int, int]] = []
            for errors, a, b in sorted(set(found)):
                i = bisect_left(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                    taken.insert(i, (a, b))
                    kept.append((j, errors, a, b))
        if not kept:
            return []
        own = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        out = []
        for j, errors, a, b in kept:
            a, b = a + len(s[a:b]) - len(s[a:b].lstrip(" ")), a + len(s[a:b].rstrip(" "))
            first, last = bisect_left(spaces, a) - 1, bisect_left(spaces, b) - 1
            out.append(Span(self.labels[j], own[first][0], own[last][1], first, last, errors, len(self.notices[j])))
        return sorted(out, key=lambda x: (x.start, x.stop, x.label, x.size))


@lru_cache(4)
def scanner(phrases: tuple, notices: tuple, slack: int) -> Scanner:
    return Scanner(phrases, notices, slack)


_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
_SPAN = pa.struct([("label", pa.string()), *((n, pa.int64()) for n in Span._fields[1:])])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES, slack: int = SLACK) -> DataFrame:
    """(id, n_words, places, spans): every place of a phrase (word, label) and every match of a notice."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = scanner(phrases, notices, slack).scan
        for b in batches:
            found = [search(t.as_py()) for t in b.column(1)]
            places = pa.array([[{"word": w, "label": x} for w, x in f.places] for f in found], pa.list_(_PLACE))
            spans = pa.array([[x._asdict() for x in f.spans] for f in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.n_words for f in found], pa.int64()), places, spans], ["id", "n_words", "places", "spans"])

    spans = ", ".join(f"{n}: {'string' if n == 'label' else 'bigint'}" for n in Span._fields)
    schema = f"id {kind}, n_words long, places array<struct<word: bigint, label: string>>, spans array<struct<{spans}>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def labelled(scanned: DataFrame) -> DataFrame:
    """Adds base_labels, labels (distinct, sorted, comma-joined) and score (0 to 1) to what :func:`scan` gives."""
    of = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    likeness = F.array_max(F.transform("spans", lambda x: 1 - x["errors"] / x["size"]))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(likeness, F.lit(0.0)))
    return scanned.withColumns({"base_labels": joined(of("places")), "labels": joined(F.concat(of("places"), of("spans"))), "score": score})


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, words = labelled(scan(table(spark, sf_dir, "documents"))), F.transform("places", lambda x: x["word"])
    spans = F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["stop"].cast("string"), x["errors"].cast("string")))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        "base_labels", "labels", "score", F.array_join(spans, ",").alias("spans"),
    )
