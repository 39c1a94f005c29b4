"""License scan by templates with optional and replaceable regions.

A template is license wording with two kinds of markup:

* ``<<beginOptional>> ... <<endOptional>>`` - words that may be missing (nests);
* ``<<var;name;0-12>>`` - any 0 to 12 words.

It is compiled to an automaton over word hashes (case and punctuation do not
count).  A place matches only if all mandatory words stand there in order, with
nothing in between that the markup does not allow.  Plain phrases are a second,
simpler kind of rule: their words must stand consecutively.

Texts are read whole.  Places where a template may start are found on arrays by
its first two words; only those places are walked in Python, each walk bounded
by its template's length, so the time does not depend on where a text repeats
its license.

Edge cases: a null or empty text has no words and no hits; repeated rows are
scanned each; rules with equal labels add up; columns other than the text are
carried or left as asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm import textbytes as tb

# The phrases of the base scan and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Published license wordings, with the markup above.
TEMPLATES = (
    ("mit", "<<beginOptional>>this work<<endOptional>> <<beginOptional>>is<<endOptional>> "
            "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> "
            "<<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included "
            "in all copies or substantial portions of the Software."),
    ("apache-2", "licensed under <<beginOptional>>the<<endOptional>> apache license, version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                 "compliance with the License. You may obtain a copy of the License at <<var;url;1-12>> Unless required by "
                 "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                 "BASIS"),
    ("gpl-3", "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license "
              "<<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either"
              "<<endOptional>> version 3 <<beginOptional>>of the license<<endOptional>>"),
    ("gpl-2", "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license "
              "<<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either"
              "<<endOptional>> version 2 <<beginOptional>>of the license<<endOptional>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> "
                 "<<beginOptional>>the<<endOptional>> cc by nc <<beginOptional>><<var;version;1-2>><<endOptional>>"),
    ("cc-by-nc", "creative commons attribution noncommercial <<beginOptional>><<var;version;1-2>> international<<endOptional>> "
                 "license"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> creative commons attribution <<var;version;0-2>> "
              "<<beginOptional>>international<<endOptional>> license"),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
              "the following conditions are met: <<var;bullet;0-1>> Redistributions of source code must retain the above "
              "copyright notice, this list of conditions and the following disclaimer. <<var;bullet;0-1>> Redistributions in "
              "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
              "the documentation and/or other materials provided with the distribution. "
              "<<beginOptional>><<var;bullet;0-1>> Neither the name of <<var;holder;1-12>> nor the names of its contributors may "
              "be used to endorse or promote products derived from this software without specific prior written permission."
              "<<endOptional>> This software is provided by"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("all-rights-reserved", "all rights reserved <<beginOptional>>worldwide<<endOptional>>"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def text_words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """States 0..n-1, n - 1 accepts.  ``steps[s]``: {word hash: next}, ``any_word[s]``: next or -1, ``free[s]``: no word."""

    label: str
    steps: list[dict[int, list[int]]]
    any_word: list[list[int]]
    free: list[list[int]]

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def advance(self, states: set[int], word: int) -> set[int]:
        out: set[int] = set()
        for s in states:
            out.update(self.any_word[s])
            out.update(self.steps[s].get(word, ()))
        return self.closure(out)

    def first_pairs(self) -> set[tuple[int, int]]:
        pairs = set()
        for s in (start := self.closure({0})):
            if self.any_word[s]:
                raise ValueError("a template starts with two fixed words")
        for a in {w for s in start for w in self.steps[s]}:
            after = self.advance(start, a)
            if any(self.any_word[s] for s in after):
                raise ValueError("a template starts with two fixed words")
            pairs.update((a, w) for s in after for w in self.steps[s])
        return pairs

    def longest_match(self, words: np.ndarray) -> int:
        """Words of the longest match that starts at the first word, 0 if there is none."""
        states, last, goal = self.closure({0}), 0, len(self.steps) - 1
        for i, word in enumerate(words.tolist(), 1):
            states = self.advance(states, word)
            if not states:
                break
            if goal in states:
                last = i
        return last


def compile_template(label: str, template: str) -> Automaton:
    steps, any_word, free = [{}], [[]], [[]]

    def state() -> int:
        steps.append({})
        any_word.append([])
        free.append([])
        return len(steps) - 1

    opened: list[int] = []
    at = 0
    for i, part in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            for word in text_words(part):
                nxt = state()
                steps[at].setdefault(int(tb.word_hash(word)), []).append(nxt)
                at = nxt
        elif part == "beginOptional":
            opened.append(at)
        elif part == "endOptional":
            nxt = state()
            free[at].append(nxt)
            free[opened.pop()].append(nxt)
            at = nxt
        else:
            least, most = map(int, part.rsplit(";", 1)[1].split("-"))
            skips = []
            for k in range(most):
                if k >= least:
                    skips.append(at)
                nxt = state()
                any_word[at].append(nxt)
                at = nxt
            end = state()
            free[at].append(end)
            for s in skips:
                free[s].append(end)
            at = end
    if opened:
        raise ValueError("beginOptional without endOptional")
    goal = state()
    free[at].append(goal)
    return Automaton(label, steps, any_word, free)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tb.mix(a ^ (tb.mix(b) + np.uint64(3)))


class Scanner:
    """Phrases and templates ready for arrays of word hashes."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(label, np.array([tb.word_hash(w) for w in text_words(p)], np.uint64)) for p, label in phrases]
        self.automata = [compile_template(label, t) for label, t in templates]
        self.starts = []
        for a in self.automata:
            pairs = np.array(sorted(a.first_pairs()), np.uint64).reshape(-1, 2)
            self.starts.append(np.sort(_pair(pairs[:, 0], pairs[:, 1])))
        self.all_starts = np.unique(np.concatenate(self.starts)) if self.starts else np.zeros(0, np.uint64)
        # A word joins states by one step at most, so no match is longer than the number of states.
        self.longest = [len(a.steps) for a in self.automata]

    def base(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, str]]:
        """(text, first word counted in the text, word after the last, label)."""
        hits = []
        for label, want in self.phrases:
            k = len(want)
            at = np.flatnonzero(hashes[: max(0, len(hashes) - k + 1)] == want[0])
            for i in range(1, k):
                at = at[hashes[at + i] == want[i]]
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + k <= bounds[text + 1]
            hits += [(int(t), int(p - bounds[t]), int(p - bounds[t]) + k, label) for t, p in zip(text[inside], at[inside])]
        return sorted(hits)

    def templated(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, str]]:
        if len(hashes) < 2 or not len(self.all_starts):
            return []
        pairs = _pair(hashes[:-1], hashes[1:])
        slot = np.minimum(np.searchsorted(self.all_starts, pairs), len(self.all_starts) - 1)
        hits = []
        for p in np.flatnonzero(self.all_starts[slot] == pairs):
            t = int(np.searchsorted(bounds, p, "right")) - 1
            for automaton, first, longest in zip(self.automata, self.starts, self.longest):
                j = int(np.searchsorted(first, pairs[p]))
                if j < len(first) and first[j] == pairs[p]:
                    n = automaton.longest_match(hashes[p: min(bounds[t + 1], p + longest)])
                    if n:
                        hits.append((t, int(p - bounds[t]), int(p - bounds[t]) + n, automaton.label))
        return sorted(hits)


def _hit_lists(hits: list[tuple[int, int, int, str]], n: int) -> pa.Array:
    counts = np.bincount(np.array([h[0] for h in hits], np.int64), minlength=n) if hits else np.zeros(n, np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    fields = [pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()),
              pa.array([h[3] for h in hits], pa.string())]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["first", "end", "label"]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, phrases=PHRASES,
         templates=TEMPLATES) -> DataFrame:
    """The columns ``keep`` (default: all) with ``scan``: n_words, phrase hits and template hits (first, end, label)."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "scan"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), *([] if text in names else [F.col(text).alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for row, end, raw, offsets in tb.chunks(tb.text_column(batch, names, text)):
                data = tb.lower_ascii(raw)
                starts, ends, bounds = tb.words(data, offsets)
                hashes = tb.span_hashes(data, starts, ends)
                n = end - row
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, n), pa.array(np.diff(bounds), pa.int64()),
                    _hit_lists(scanner.base(hashes, bounds), n), _hit_lists(scanner.templated(hashes, bounds), n)],
                    names=["_doc", "n_words", "phrases", "templates"])

    hits = "array<struct<first: bigint, end: bigint, label: string>>"
    schema = f"_doc {packed.schema['_doc'].dataType.simpleString()}, n_words bigint, phrases {hits}, templates {hits}"
    return packed.mapInArrow(run, schema).select("_doc.*", F.struct("n_words", "phrases", "templates").alias("scan"))
