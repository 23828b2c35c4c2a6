"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates' token sequences. A text's tokens are streamed through it;
after each token it knows the longest run ending there that stands in some template. Maximal long runs are
chained along their template's diagonal into covered spans. Words are hashed a batch at a time, and only runs of
words that the templates know are streamed, since any other word empties the match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8
from .textkit import ALNUM, LOWER, PIECE, pieces, run_hashes, words

#: Phrases whose every place counts, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short, well-known notices in our own selection; each is one template of its label.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal"),
    ("proprietary", "no part of this publication may be reproduced without prior written permission"),
)


def bodies(folder: Path = Path(__file__).with_name("licenses")) -> tuple[tuple[str, str], ...]:
    """(label, text) of whole licences: one file each, named by its label."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt")))


def spelled(text: str) -> tuple[str, ...]:
    """The words of a template, as they are taken from a document."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return tuple(data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True))


#: Notices, and whole licences by the same labels; where versions differ, the label of the body has the version.
TEMPLATES = NOTICES + bodies()


@dataclass(frozen=True)
class Chain:
    """A template is found where chained runs of at least ``run`` words cover ``cover`` of its words, within a stretch of
    text of three times its length at most."""

    run: int = 3
    cover: float = 0.8


class Automaton:
    """Generalised suffix automaton over integer tokens. Each state knows all (template, end) of its substrings; the
    templates are a parameter of bounded size."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(sequences):
            last = 0
            for place, t in enumerate(tokens):
                last = self._extend(last, t)
                self.ends[last].add((number, place + 1))
        # the places of a state's substrings are those of all states below it in the link tree
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length of the longest known run that ends here, its state) after each token."""
        out, state, size = [], 0, 0
        after, link, length = self.next, self.link, self.length
        for t in tokens:
            while state and t not in after[state]:
                state = link[state]
                size = length[state]
            if t in after[state]:
                state, size = after[state][t], size + 1
            out.append((size, state))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, chain: Chain = Chain()):
        self.chain = chain
        self.phrases = [(spelled(p), label) for p, label in phrases]
        self.templates = [(spelled(t), label) for label, t in templates]
        every = [w for w, _ in self.phrases + self.templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({x for ws in every for x in ws}))}
        self.spelling = [w.encode() for w in self.vocabulary]
        raw = np.frombuffer(b"".join(self.spelling), np.uint8)
        ends = np.cumsum([len(w) for w in self.spelling])
        hashes = run_hashes(raw, ends - [len(w) for w in self.spelling], ends)
        order = np.argsort(hashes)
        self.hashes, self.tokens = hashes[order], np.arange(len(order))[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[hashes >> np.uint64(48)] = True
        self.automaton = Automaton([[self.vocabulary[x] for x in ws] for ws in every])
        if min(len(w) for w in every) < 2 or chain.run < 2:
            raise ValueError("phrases, templates and runs have two words at least")
        # which words stand side by side in some template, and which begin a phrase
        self.beside = np.zeros((len(order) + 1, len(order) + 1), bool)
        self.opens = np.zeros_like(self.beside)
        for ws in every:
            at = [self.vocabulary[w] for w in ws]
            self.beside[at[:-1], at[1:]] = True
        self.closing: dict[int, list[tuple[tuple[int, ...], str]]] = {}
        for ws, label in self.phrases:
            at = tuple(self.vocabulary[w] for w in ws)
            self.closing.setdefault(at[-1], []).append((at, label))
            self.opens[self.vocabulary[ws[0]], self.vocabulary[ws[1]]] = True

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The templates' token of each word, or -1. A word that hashes like a token is compared byte by byte."""
        h = run_hashes(data, starts, ends)
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(48)])
        place = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        same = self.hashes[place] == h[maybe]
        out[maybe[same]] = self.tokens[place[same]]
        return out

    def runs(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the stretches of words whose neighbours are neighbours in some template too; all
        matches of two words or more lie inside. Stretches that hold no phrase and are shorter than a run go."""
        pair = np.zeros(len(tokens) + 1, bool)
        if len(tokens) > 1:
            pair[1:-1] = self.beside[tokens[:-1], tokens[1:]]
            pair[bounds] = False
        edge = np.diff(np.append(pair, False).astype(np.int8), prepend=np.int8(0))
        begins, ends = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        opening = np.zeros(len(tokens) + 1, np.int64)
        if len(tokens) > 1:
            opening[1:-1] = np.cumsum(self.opens[tokens[:-1], tokens[1:]])
            opening[-1] = opening[-2]
        good = (ends - begins >= self.chain.run) | (opening[ends - 1] > opening[begins])
        return begins[good], ends[good]

    def scan(self, tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray, spell) -> tuple:
        """Of one text, whose words that ``tokens`` and the stretches hold: places of phrases, the first and last of
        them, base labels, all labels, the score, and the spans of templates."""
        n_phrases = len(self.phrases)
        places, base = [], set()
        runs: dict[int, set[tuple[int, int, int, int]]] = {}
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            run = tokens[begin:end].tolist()
            # a word that merely hashes like one of the templates is no word of theirs
            run = [t if spell(begin + i) == self.spelling[t] else -1 for i, t in enumerate(run)]
            stats = self.automaton.statistics(run)
            for i, (size, state) in enumerate(stats):
                # phrases that end here: longest known run covers the phrase's words
                for words_, label in self.closing.get(run[i], ()):
                    if size >= len(words_) and tuple(run[i + 1 - len(words_) : i + 1]) == words_:
                        places.append(begin + i + 1 - len(words_))
                        base.add(label)
                # a maximal run: the next token does not lengthen it
                if size >= self.chain.run and (i + 1 == len(stats) or stats[i + 1][0] <= size):
                    first = begin + i + 1 - size
                    for number, stop in self.automaton.ends[state]:
                        if number >= n_phrases:
                            runs.setdefault(number, set()).add((first, first + size, stop - size, stop))
        labels, score, spans = set(base), 0.0, []
        for number, found in sorted(runs.items()):
            words_, label = self.templates[number - n_phrases]
            for covered, first, last in chains(found, len(words_)):
                share = min(1.0, covered / len(words_))
                score = max(score, share)
                if share >= self.chain.cover:
                    labels.add(label)
                    spans.append({"label": label, "first": first, "last": last - 1, "covered": share})
        spans.sort(key=lambda x: (x["first"], x["last"], x["label"]))
        return len(places), min(places, default=None), max(places, default=None), base, labels, score, spans


def chains(runs: set[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(words covered, first word, end) of the best chains of runs (from, to, from in the template, to there): in each
    stretch of text of three times the template's ``size`` the one that covers most; of those that overlap the better
    one, or the earlier of equals. Runs of a chain follow one another in both; a Fenwick tree over the template's places
    holds the best chain that ends at each or before."""
    if len(runs) == 1:
        ((at, to, s, e),) = runs
        return [(e - s, at, to)]
    ordered = sorted(runs)
    best = []
    for window in sorted({max(at // size - d, 0) for at, *_ in ordered for d in range(3)}):
        low, high = window * size, (window + 3) * size
        inside = [x for x in ordered[bisect_left(ordered, (low,)) :  bisect_left(ordered, (high,))] if x[1] <= high]
        tree: dict[int, tuple[int, int]] = {}  # at a node: the most words covered, and minus the first word
        waiting: list[tuple[int, int, int, int]] = []
        top = None
        for at, to, s, e in inside:
            while waiting and waiting[0][0] <= at:
                _, place, covered, first = heappop(waiting)
                while place <= size:
                    tree[place] = max(tree.get(place, (0, 0)), (covered, first))
                    place += place & -place
            covered, first, place = 0, -at, s
            while place:
                if place in tree and tree[place][0] > covered:
                    covered, first = tree[place]
                place &= place - 1
            covered += e - s
            heappush(waiting, (to, e, covered, first))
            if top is None or covered > top[0]:
                top = (covered, -first, to)
        if top:
            best.append(top)
    out: list[tuple[int, int, int]] = []
    for covered, first, end in sorted(best, key=lambda x: (-x[0], x[1])):
        if all(end <= a or b <= first for _, a, b in out):
            out.append((covered, first, end))
    return out


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,covered:double>>"
EMPTY = (0, None, None, set(), set(), 0.0, [])
SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))


@lru_cache(2)
def scanner_of(phrases, templates, chain: Chain) -> Scanner:
    """One for all tasks of a Python worker."""
    return Scanner(phrases, templates, chain)


def _scanner(phrases, templates, chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(phrases, templates, chain)
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            counts, found = [], []
            for a, b in pieces(offsets, PIECE):
                part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends, n = words(part, at, ALNUM)
                ids = scanner.ids(part, starts, ends)
                bounds = np.concatenate([[0], np.cumsum(n)])
                counts += n.tolist()
                begins, stops = scanner.runs(ids, bounds)
                first = np.searchsorted(begins, bounds)
                for k in range(b - a):
                    lo, x, y = int(bounds[k]), int(first[k]), int(first[k + 1])
                    if x == y:
                        found.append(EMPTY)
                        continue
                    got = ids[lo : int(bounds[k + 1])]
                    found.append(scanner.scan(got, begins[x:y] - lo, stops[x:y] - lo, lambda i, lo=lo: part[starts[lo + i] : ends[lo + i]].tobytes()))
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            joined = [[",".join(sorted(x)) for x in columns[k]] for k in (3, 4)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), pa.array(counts, pa.int64()), *(pa.array(columns[k], pa.int64()) for k in range(3)),
                    pa.array(joined[0], pa.string()), pa.array(joined[1], pa.string()), pa.array(columns[5], pa.float64()),
                    pa.array(columns[6], SPANS),
                ],
                ["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return run


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=TEMPLATES, chain: Chain = Chain()) -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every whole text.

    Words are runs of ASCII letters, digits and bytes above 0x7F, with A-Z lower-cased. ``score`` is the
    largest share of a template that is covered; a phrase alone adds nothing to it. ``spans`` are the places of templates, first and
    last word; several templates of one label, or of several, may hold the same words, and each has its span. A very
    long text stands in one task, as arrays of some fifty bytes a word. Null and empty texts have no word and
    no label; repeated rows get equal results; a phrase that stands twice counts twice; an empty table gives an
    empty result; other columns, whatever their names, travel inside ``row``. Nothing is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("int").alias("none"))
    slim = docs.select(row.alias("_row"), F.col(text).alias("_text"))
    return slim.mapInArrow(_scanner(phrases, templates, chain), f"row {slim.schema['_row'].dataType.simpleString()}, {RESULT}")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))
