"""License scan: a generalised suffix automaton over the words of license templates.

Each text's words run through the automaton, which gives for every place the longest match that
ends there (matching statistics); long matches are chained into covered template spans. Only runs
of words whose neighbouring pairs all occur in some template are walked: no match of three or more
words lies elsewhere. Every base phrase is found where the automaton has read it whole.

Defined cases: null and empty texts have no words, no labels and score 0; overlapping places all
count; texts of any length are read whole; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echoledger.llm.shared import MARKS, documents_of, steps, text_buffer, word_hash, words

#: Phrases whose every place counts, with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Customary wordings of license notices, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


class SuffixAutomaton:
    """All substrings of several sequences; each state knows in which of them it occurs and where it first ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(which, at)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            above = self.ends[self.link[s]]
            for which, at in self.ends[s].items():
                above[which] = min(at, above.get(which, at))

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # read before, in this sequence or another
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest match that ends at each place."""
        state = length = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            out.append((state, length))
        return out


@dataclass
class Scanner:
    """Phrases, templates and the limits of a chain: least words of a match, most words between two, least share."""

    phrases: tuple[tuple[str, str], ...] = BASE_PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    least_match: int = 3
    most_gap: int = 12
    least_share: float = 0.6
    least_words: int = 5
    automaton: SuffixAutomaton = field(init=False)

    def __post_init__(self):
        texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t, _ in (*self.phrases, *self.templates)]
        vocabulary = sorted({w for t in texts for w in t}, key=word_hash)
        self.known = np.array([word_hash(w) for w in vocabulary], np.uint64)
        number = {w: k for k, w in enumerate(vocabulary)}
        sequences = [[number[w] for w in t] for t in texts]
        self.sizes = [len(s) for s in sequences]
        self.pairs = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        self.automaton = SuffixAutomaton(sequences)
        if min(self.sizes) < 2:
            raise ValueError("a phrase or template has two words or more")
        # Phrases that a state's longest string ends with: their own states lie on its suffix links.
        own: dict[int, list[int]] = {}
        for k in range(len(self.phrases)):
            own.setdefault(self.automaton.statistics(sequences[k])[-1][0], []).append(k)
        self.endings: list[list[int]] = [[] for _ in self.automaton.next]
        for s in sorted(range(1, len(self.endings)), key=lambda s: self.automaton.length[s]):
            self.endings[s] = self.endings[self.automaton.link[s]] + own.get(s, [])

    def scan(self, offsets: np.ndarray, data: np.ndarray, i: int, j: int):
        """Per row: (words, base places as (start, phrase), chained spans as (template, first word, last word, share))."""
        at, hashes, _, _ = words(offsets, data, i, j, MARKS)
        base: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        matches: list[dict[int, list[tuple[int, int, int, int]]]] = [{} for _ in range(j - i)]
        if len(hashes) > 1:
            k = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            symbol = np.where(self.known[k] == hashes, k, len(self.known))
            fits = self.pairs[symbol[:-1], symbol[1:]]
            ends = at[1:-1]
            fits[ends[(ends > 0) & (ends <= len(fits))] - 1] = False
            edge = np.flatnonzero(np.diff(np.concatenate(([False], fits, [False])).astype(np.int8)))
            for first, last in zip(edge[::2].tolist(), edge[1::2].tolist()):  # words first..last, both included
                row = int(np.searchsorted(at, first, side="right")) - 1
                self._run(symbol[first : last + 1].tolist(), first - int(at[row]), base[row], matches[row])
        return np.diff(at), base, [self._chains(m) for m in matches]

    def _run(self, run: list[int], start: int, base: list, matches: dict) -> None:
        found = self.automaton.statistics(run)
        for k, (state, length) in enumerate(found):
            for p in self.endings[state]:
                if self.sizes[p] <= length:
                    base.append((start + k - self.sizes[p] + 1, p))
            longest = k + 1 == len(found) or found[k + 1][1] != length + 1
            if longest and length >= self.least_match:
                for which, end in self.automaton.ends[state].items():
                    if which >= len(self.phrases):
                        matches.setdefault(which, []).append((start + k - length + 1, start + k, end - length + 1, end))

    def _chains(self, matches: dict) -> list[tuple[int, int, int, float]]:
        out = []
        for which, found in matches.items():
            found.sort()
            todo = [found]
            while todo:  # the best chain, and then those before and after it
                some = todo.pop()
                cover, first, last = self._best_chain(some)
                share = cover / self.sizes[which]
                if share >= self.least_share and cover >= self.least_words:
                    out.append((which - len(self.phrases), first, last, min(1.0, share)))
                    todo += [x for x in ([m for m in some if m[0] > last], [m for m in some if m[1] < first]) if x]
        return out

    def _best_chain(self, found: list[tuple[int, int, int, int]]) -> tuple[int, int, int]:
        """(words covered, first word, last word) of the best chain of sorted matches."""
        best: list[tuple[int, int]] = []  # (words covered, first word) of the best chain that ends with each match
        reach = 0
        for k, (a, b, ta, tb) in enumerate(found):
            cover, first = b - a + 1, a
            while found[reach][1] < a - self.most_gap - 1 and reach < k:
                reach += 1
            for m in range(reach, k):
                if a - self.most_gap <= found[m][1] + 1 <= a and found[m][3] < ta and best[m][0] + b - a + 1 > cover:
                    cover, first = best[m][0] + b - a + 1, best[m][1]
            best.append((cover, first))
        k = max(range(len(found)), key=lambda k: (best[k][0], -k))
        return (*best[k], found[k][1])


def spans(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each chained span: doc_id, label, template, first_word, last_word, share."""
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(1))
            ids, rows = b.column(0).to_pylist(), []
            for i, j in steps(offsets):
                _, _, chains = scanner.scan(offsets, data, i, j)
                rows += [(ids[i + k], scanner.templates[t][1], t, x, y, s) for k, c in enumerate(chains) for t, x, y, s in c]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                ["doc_id", "label", "template", "first_word", "last_word", "share"])

    return documents_of(docs, "doc_id", "text").mapInArrow(
        run, "doc_id bigint, label string, template int, first_word bigint, last_word bigint, share double")


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Per document: words, places of base phrases, labels, and the best share of a template (1 for a base phrase)."""
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(1))
            for i, j in steps(offsets):
                count, base, chains = scanner.scan(offsets, data, i, j)
                own = [sorted({scanner.phrases[p][1] for _, p in r}) for r in base]
                every = [sorted({*o, *(scanner.templates[t][1] for t, *_ in c)}) for o, c in zip(own, chains)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array([len(r) for r in base], pa.int64()),
                    pa.array([min(r)[0] if r else None for r in base], pa.int64()),
                    pa.array([max(r)[0] if r else None for r in base], pa.int64()),
                    pa.array([",".join(o) for o in own]), pa.array([",".join(e) for e in every]),
                    pa.array([1.0 if r else max([0.0, *(s for *_, s in c)]) for r, c in zip(base, chains)]),
                ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return documents_of(docs, "doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
