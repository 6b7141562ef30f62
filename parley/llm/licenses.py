"""License scans: a generalised suffix automaton over license templates gives matching statistics of streamed files.

A word that no template has ends every match, so only stretches in which each pair of neighbouring words is a pair of some
template are fed to the automaton; they are found with vectorised lookups. Matches that cannot be extended are chained, per
template, into increasing spans, and the share of the template's words that the chain covers is its coverage.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm import textkit as T

#: Phrases that always count, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening or notice texts of public licenses, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "artistic-2": "This copyright license is granted under the Artistic License 2.0: everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
}


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of small integers."""

    def __init__(self):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0
        #: (template, position) of the ends that a state was made for; further ends are in the states that link to it
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the longest string of p's followed by word, made if it is not the longest of its state."""
        q = self.next[p][word]
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy], self.link[q] = dict(self.next[q]), self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for at, word in enumerate(words):
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                self.link[new] = self._split(p, word) if p >= 0 else 0
                last = new
            self.ends[last].append((template, at))

    def finish(self) -> None:
        """Make `ends` of each state complete: all places of templates where its strings end."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])

    def statistics(self, words: list[int]):
        """(state, length) of the longest match that ends at each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Catalogue:
    """Templates and phrases compiled for scanning; a few hundred words, sent to tasks as it is."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = 4):
        texts = [*phrases, *templates.values()]
        self.labels = [*phrases.values(), *templates]
        self.n_phrases, self.least = len(phrases), least
        split = [[bytes(w) for w in self._words(t.encode())] for t in texts]
        hashes = {w: T.hash_bytes(w) for s in split for w in s}
        self.vocabulary = np.array(sorted(set(hashes.values())), dtype=np.uint64)
        code = {w: int(np.searchsorted(self.vocabulary, T.U(h))) for w, h in hashes.items()}
        self.sequences = [[code[w] for w in s] for s in split]
        self.automaton = SuffixAutomaton()
        for k, s in enumerate(self.sequences):
            self.automaton.add(k, s)
        self.automaton.finish()
        pairs = np.zeros((len(self.vocabulary), len(self.vocabulary)), dtype=bool)
        single = np.zeros(len(self.vocabulary), dtype=bool)
        for k, s in enumerate(self.sequences):
            pairs[s[:-1], s[1:]] = True
            single[s[0]] |= len(s) == 1
        self.pairs, self.single = pairs, single
        #: phrases by the state of the whole phrase: a phrase ends where the match is as long and its state lies below
        self.phrase_ends: dict[int, list[int]] = defaultdict(list)
        for k in range(self.n_phrases):
            state = 0
            for w in self.sequences[k]:
                state = self.automaton.next[state][w]
            self.phrase_ends[state].append(k)

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        data = np.frombuffer(text, np.uint8)
        low = T.LOWER[data]
        starts, ends, _ = T.spans(T.ALNUM[low], np.array([0, len(data)]))
        return [low[a:b].tobytes() for a, b in zip(starts, ends)]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, codes: np.ndarray, at: np.ndarray):
        """(text, first word, end word) of the runs that can hold a match: two words or more, or a phrase of one word."""
        if not len(codes):
            return
        joined = np.zeros(len(codes), dtype=bool)  # whether a word goes on from the word before
        joined[1:] = (codes[1:] >= 0) & (codes[:-1] >= 0) & self.pairs[codes[:-1], codes[1:]]
        firsts = at[:-1]
        joined[firsts[firsts < len(codes)]] = False
        alone = (codes >= 0) & self.single[np.maximum(codes, 0)]
        inside = joined | alone
        inside[:-1] |= joined[1:]
        cut = np.flatnonzero(inside & ~joined)
        stop = np.flatnonzero(inside & ~np.append(joined[1:], False)) + 1
        for row, a, b in zip(np.searchsorted(at, cut, "right") - 1, cut, stop):
            yield int(row), int(a), int(b)

    def scan(self, words: list[int]):
        """Phrase places [(phrase, first word)] and long matches [(template, first of template, first of text, length)]."""
        automaton, phrases, matches = self.automaton, [], []
        found = list(automaton.statistics(words))
        for end, (state, length) in enumerate(found):
            below = state
            while below > 0:
                for k in self.phrase_ends.get(below, ()):
                    n = len(self.sequences[k])
                    if length >= n and automaton.length[automaton.link[below]] < n:
                        phrases.append((k, end - n + 1))
                below = automaton.link[below]
            if length >= self.least and (end + 1 == len(found) or found[end + 1][1] <= length):
                matches += [(k, at - length + 1, end - length + 1, length) for k, at in automaton.ends[state] if k >= self.n_phrases]
        return phrases, matches

    def coverage(self, matches: list[tuple[int, int, int, int]]) -> dict[str, float]:
        """Largest share of each label's template that a chain of its matches covers: both places increase, overlaps count once."""
        best: dict[str, float] = {}
        by_template = defaultdict(list)
        for k, t, p, n in matches:
            by_template[k].append((p, t, n))
        for k, own in by_template.items():
            # matches that end before the present one are kept by place and length in the template only, so that a file of
            # very many notices costs no more than its matches times those
            past: dict[tuple[int, int], int] = {}
            near: list[tuple[int, int, int, int]] = []
            most = 0
            for p, t, n in sorted(set(own)):
                for pj, tj, nj, total in near:
                    if pj + nj <= p:
                        past[tj, nj] = max(past.get((tj, nj), 0), total)
                near = [x for x in near if x[0] + x[2] > p]
                # a later match may begin inside the former one; then only its new words count
                before = [total - max(0, tj + nj - t) for (tj, nj), total in past.items() if tj < t]
                before += [total - max(0, pj + nj - p, tj + nj - t) for pj, tj, nj, total in near if pj < p and tj < t]
                near.append((p, t, n, n + max([0, *before])))
                most = max(most, near[-1][3])
            best[self.labels[k]] = max(best.get(self.labels[k], 0.0), min(1.0, most / len(self.sequences[k])))
        return best


def _scan_task(catalogue, share: float, keep_spans: bool):
    def run(batches):
        cat: Catalogue = catalogue.value
        for batch in batches:
            out = []
            for first, last, data, offsets in T.texts(batch.column("text")):
                hashes, at, *_ = T.word_hashes(data, offsets, T.ALNUM)
                codes = cat.codes(hashes)
                places, matches = defaultdict(list), defaultdict(list)
                for row, a, b in cat.stretches(codes, at):
                    phrases, found = cat.scan(codes[a:b].tolist())
                    a -= int(at[row])
                    places[row] += [(k, a + p) for k, p in phrases]
                    matches[row] += [(k, t, a + p, n) for k, t, p, n in found]
                for row in range(last - first):
                    n = int(at[row + 1] - at[row])
                    starts = [p for _, p in places.get(row, ())]
                    base = {cat.labels[k] for k, _ in places.get(row, ())}
                    covered = cat.coverage(matches[row]) if row in matches else {}
                    labels = base | {k for k, c in covered.items() if c >= share}
                    spans = sorted({(cat.labels[k], p, p + m) for k, _, p, m in matches.get(row, ())}) if keep_spans else []
                    score = max([0.0, *covered.values(), *([1.0] if base else [])])
                    out.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": k, "first": a, "end": b} for k, a, b in spans]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, catalogue: Catalogue | None = None, share: float = 0.5, keep_spans: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are lower-cased runs of ASCII letters and digits and of everything beyond ASCII. n_base counts the places of the
    catalogue's phrases (a place per phrase), first_word and last_word are the smallest and largest word they start at.
    labels adds those with a template of which matches of at least `least` words, chained in order, cover `share`. score is
    the largest coverage, 1 with a phrase, else 0. spans lists the long matches by words. Null and empty texts have 0
    words, null places, empty labels and score 0. Repeated rows and null doc_ids give a row each; nothing is shuffled.
    """
    sent = spark.sparkContext.broadcast(catalogue or Catalogue())
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, end long>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan_task(sent, share, keep_spans), schema)
