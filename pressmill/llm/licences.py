"""Licence scans: matching statistics against a suffix automaton of licence templates, chained into covered spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressmill.llm.blocks import MARKS, Block, blocks, bounds, hashes, words

# Phrases whose places are counted, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Passages of public licence texts and notices, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "All rights reserved"),
]

#: Words from which a match counts, words that two chained matches may lie apart, and covered share from which a span is a label.
LONG, GAP, COVERED = 3, 6, 0.6


class Automaton:
    """Generalised suffix automaton of word sequences: every path from state 0 is a run of words of some sequence.

    ``length``: words of the longest run of a state; ``link``: state of its longest suffix that lies elsewhere too;
    ``ends``: where one occurrence ends, as (sequence, words up to there), for each sequence that holds the run.
    """

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: list[dict[int, int]] = [{}]
        whole = []
        for number, sequence in enumerate(sequences):
            state = 0
            for n, word in enumerate(sequence):
                state = self._add(state, word, ends)
                ends[state].setdefault(number, n + 1)
            whole.append(state)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for number, n in ends[state].items():
                ends[self.link[state]].setdefault(number, n)
        self.ends = ends
        #: Sequences that are a suffix of the state's runs, with the words that must have matched.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for number, state in enumerate(whole):
            if sequences[number]:
                self.whole[state].append((number, len(sequences[number])))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.whole[state] = self.whole[state] + self.whole[self.link[state]] if self.link[state] > 0 else self.whole[state]

    def _new(self, length: int, follow: dict[int, int], link: int, ends: list) -> int:
        self.length.append(length), self.next.append(follow), self.link.append(link), ends.append({})
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int, ends: list) -> int:
        """The state of the longest run of ``state`` followed by ``word``, taken out of ``target`` where that is longer."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target], ends)
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        self.link[target] = part
        return part

    def _add(self, state: int, word: int, ends: list) -> int:
        if word in self.next[state]:
            return self._split(state, word, self.next[state][word], ends)
        new = self._new(self.length[state] + 1, {}, 0, ends)
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word], ends)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest suffix of what has been read, ``word`` included, that is a run of some sequence."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, matched + 1)


class Scanner:
    """Finds phrases and templates in blocks of texts."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.phrases = len(phrases)
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        texts = [text for text, _ in phrases] + [text for _, text in templates]
        block = next(blocks(pa.array(texts, pa.string()), 1 << 30))
        start, end, doc = words(block, MARKS)
        self.words, number = np.unique(hashes(block, start, end), return_inverse=True)
        at = bounds(doc, len(block))
        self.sequences = [number[at[i] : at[i + 1]].tolist() for i in range(len(block))]
        self.automaton = Automaton(self.sequences)

    def __call__(self, block: Block) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]], int]]:
        """For every text with a hit: its number, the places (phrase, first word) of phrases, and the spans (label, first word,
        word after the last, covered share of the template) of templates. Then, for all texts, see ``counts``."""
        start, end, doc = words(block, MARKS)
        self.counts = np.diff(bounds(doc, len(block)))
        if not len(start):
            return
        first = bounds(doc, len(block))[doc]
        h = hashes(block, start, end)
        k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[k] == h
        # Runs of template words; a word that no template has leads back to the start.
        cut = np.ones(len(h) + 1, bool)
        cut[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
        edge = np.flatnonzero(cut)
        least = min([LONG, *(len(s) for s in self.sequences[: self.phrases] if s)])
        a, b = edge[:-1], edge[1:]
        keep = known[a] & (b - a >= least)
        places: dict[int, list] = {}
        matches: dict[int, list] = {}
        for lo, hi in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            self._run(k[lo:hi].tolist(), lo - int(first[lo]), places.setdefault(int(doc[lo]), []), matches.setdefault(int(doc[lo]), []))
        for text in places:
            spans = list(self._chain(matches[text]))
            if places[text] or spans:
                yield text, places[text], spans

    def _run(self, run: list[int], offset: int, places: list, matches: list) -> None:
        """Matching statistics of one run: phrases wherever they end, and every match that cannot be longer."""
        auto, state, matched = self.automaton, 0, 0
        for i, word in enumerate(run):
            before = state, matched
            state, matched = auto.step(state, matched, word)
            if before[1] >= LONG and matched <= before[1]:
                matches.append((offset + i, *before))
            for number, size in auto.whole[state]:
                if number < self.phrases and matched >= size:
                    places.append((number, offset + i + 1 - size))
        if matched >= LONG:
            matches.append((offset + len(run), state, matched))

    def _chain(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Chains matches of one template that follow each other in both, at most GAP words apart, and keeps those that cover it."""
        open_: dict[int, list[int]] = {}

        def close(number: int) -> Iterator[tuple[str, int, int, float]]:
            lo, hi, _, covered = open_.pop(number)
            share = covered / len(self.sequences[number])
            if share >= COVERED:
                yield self.labels[number], lo, hi, share

        for end, state, matched in matches:
            for number, upto in self.automaton.ends[state].items():
                if number < self.phrases:
                    continue
                lo, held = end - matched, open_.get(number)
                if held and (lo - held[1] > GAP or upto <= held[2]):
                    yield from close(number)
                    held = None
                if held is None:
                    open_[number] = [lo, end, upto, matched]
                else:
                    held[3] += min(matched, upto - held[2])
                    held[1], held[2] = end, upto
        for number in list(open_):
            yield from close(number)


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, places, spans, score`` of every whole text.

    ``places``: (label, first word) of every phrase that stands there in full; ``spans``: (label, first word, word after the
    last, covered share) of templates of which at least COVERED is covered by matches of LONG words or more that follow each
    other; ``score``: the largest covered share, 1 where a phrase stands. Words are runs of letters, digits and bytes beyond
    ASCII, in lower case. Texts are read once, word by word; only runs of words that templates have are stepped through.

    Cases: a null text has no words and score 0. A null id stays null, repeated rows are scanned alike, an empty table gives no
    rows. Phrases and templates are parameters of a few kB; empty ones never match. Other columns are ignored.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                places, spans, score = [[] for _ in range(len(block))], [[] for _ in range(len(block))], np.zeros(len(block))
                for i, phrase, covered in find(block):
                    places[i] = [{"label": find.labels[p], "word": w} for p, w in phrase]
                    spans[i] = [{"label": label, "start": a, "end": b, "covered": c} for label, a, b, c in covered]
                    score[i] = 1.0 if phrase else max(c for *_, c in covered)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.rows], pa.array(find.counts), pa.array(places, place), pa.array(spans, span), pa.array(score)],
                    ["id", "n_words", "places", "spans", "score"])

    return rows.mapInArrow(run, f"id {kind}, n_words bigint, places array<struct<label:string,word:bigint>>, "
                                "spans array<struct<label:string,start:bigint,end:bigint,covered:double>>, score double")
