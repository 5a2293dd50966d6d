"""License scan with a generalised suffix automaton of licence words.

The automaton holds every word sequence of all templates.  A text is streamed
through it once; at each word it gives the longest sequence ending there that
some template contains (matching statistics).  Matches that cannot grow and are
long enough are chained, in order and with small gaps, into spans of one
template; a template is reported when its words are covered well.

Words: A-Z as a-z, then runs of letters, digits and non-ASCII.

Edge cases: null and empty texts have no words, no labels, score 0 and null
first and last words; every text is streamed whole; repeated rows are judged
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence texts, notices and statements by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies.",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "Licensed under the GNU General Public License v3.0"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


@dataclass(frozen=True)
class Settings:
    """min_match: words of a match that counts. gap: words that a chain may skip. cover: least share of a template's words."""

    min_match: int = 3
    gap: int = 12
    cover: float = 0.8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``places[state]`` holds (template, end position) of every occurrence of
    the state's sequences.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        own: list[list[tuple[int, int]]] = [[]]
        for template, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word, own)
                own[last].append((template, end))
        self.places: list[list[tuple[int, int]]] = [list(x) for x in own]
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        self.places = [sorted(set(x)) for x in self.places]

    def _new(self, length: int, own: list, copy_of: int | None = None) -> int:
        self.next.append({} if copy_of is None else dict(self.next[copy_of]))
        self.link.append(0 if copy_of is None else self.link[copy_of])
        self.length.append(length)
        own.append([])
        return len(self.next) - 1

    def _split(self, at: int, word: int, own: list) -> int:
        """The state of the longest suffix of ``at`` + word that ends with ``at``, made its own if it is not."""
        target = self.next[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        clone = self._new(self.length[at] + 1, own, target)
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = clone
            at = self.link[at]
        self.link[target] = clone
        return clone

    def _extend(self, last: int, word: int, own: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, own)
        state = self._new(self.length[last] + 1, own)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        self.link[state] = 0 if at < 0 else self._split(at, word, own)
        return state

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest suffix matched after every word."""
        state = length = 0
        for word in sequence:
            while word not in self.next[state] and state:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    """Templates, their automaton, and scans of texts."""

    def __init__(self, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, settings: Settings = Settings()) -> None:
        self.settings = settings
        self.number: dict[bytes, int] = {}
        as_numbers = lambda text: [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
        self.labels = [label for label, _ in templates]
        self.templates = [as_numbers(text) for _, text in templates]
        self.phrases = [(np.array(as_numbers(text)), label) for text, label in phrases.items()]
        self.automaton = Automaton(self.templates)

    def matches(self, sequence: list[int], offset: int) -> Iterator[tuple[int, int, int]]:
        """(first word, length, state) of matches that the next word cannot grow."""
        before = (0, 0)
        for i, now in enumerate([*self.automaton.statistics(sequence), (0, 0)]):
            if now[1] != before[1] + 1 and before[1] >= self.settings.min_match:
                yield offset + i - before[1], before[1], before[0]
            before = now

    def spans(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, words covered) of chains, in one pass over the matches.

        A match extends, of the template's chains that it lies ahead of within
        the gap on both sides, the one that then covers most; else it begins
        one.  A chain stays open until the matches are past its gap, so one out
        of order does not end it.
        """
        gap = self.settings.gap
        open_: dict[int, list[list[int]]] = {}  # template -> chains of first, end, template end, covered
        out: list[tuple[int, int, int, int]] = []
        for first, length, state in found:
            by_template: dict[int, list[int]] = {}
            for template, end in self.automaton.places[state]:
                by_template.setdefault(template, []).append(end)
            for template, ends in by_template.items():
                chains = open_.setdefault(template, [])
                out += [(template, c[0], c[1], c[3]) for c in chains if first - c[1] > gap]
                chains[:] = [c for c in chains if first - c[1] <= gap]
                ways = [
                    (c[3] + min(length, e - c[2], first + length - c[1]), -e, i)
                    for i, c in enumerate(chains) for e in ends if c[2] < e and e - length - c[2] <= gap and first + length > c[1]
                ]
                if ways:
                    covered, end, i = max(ways)
                    chains[i][1:] = [first + length, -end, covered]
                else:
                    chains += [[first, first + length, e, length] for e in ends]
        out += [(t, c[0], c[1], c[3]) for t, chains in open_.items() for c in chains]
        return sorted(set(out))

    def base(self, numbers: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.phrases:
            n = len(numbers) - len(phrase) + 1
            if n > 0:
                here = np.ones(n, dtype=bool)
                for i, word in enumerate(phrase):
                    here &= numbers[i : i + n] == word
                out += [(int(p), label) for p in np.flatnonzero(here)]
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        """The result row of one text."""
        words = words_of(text)
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        inside = np.concatenate(([False], numbers >= 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        found: list[tuple[int, int, int]] = []
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.settings.min_match:
                found += self.matches(numbers[a:b].tolist(), a)
        spans = self.spans(found) if found else []
        rated = [(covered / len(self.templates[t]), self.labels[t], first, end) for t, first, end, covered in spans]
        good = [r for r in rated if r[0] >= self.settings.cover]
        base = self.base(numbers) if len(edges) else []
        base_labels = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": base[0][0] if base else None,
            "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | {r[1] for r in good})),
            "score": round(max((r[0] for r in rated), default=0.0), 6),
            "spans": ",".join(f"{label}:{first}:{end}" for label, first, end in sorted({r[1:] for r in good})),
        }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``Scanner.scan`` for every row: one narrow stage, no shuffle.

    The scanner is broadcast; its size is that of the templates.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "spans": pa.string(), "score": pa.float64()}
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names)], names=["doc_id", *names])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over the whole ``documents`` table."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
