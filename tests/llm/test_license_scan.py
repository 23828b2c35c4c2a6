import random
import re

import pytest

from fieldproof.llm import license_scan as L

from . import helpers as H

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = WORD.findall((text or "").encode().translate(H.LOWER))
    places, labels = [], set()
    for phrase, label in L.PHRASES:
        p = [x.encode() for x in phrase.split()]
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_against_plain_search(spark):
    r = random.Random(2)
    pieces = ["CC-BY", "cc by", "all", "rights", "reserved", "ALL Rights Reserved.", "general public license", "gnu", "the", "éa", "by cc by", "Licensed under the Apache License, Version 2.0.", "x y", "1"]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 30)))) for i in range(150)] + [(900, None), (901, ""), (902, "cc"), (903, "by"), (901, "cc by")]
    out = L.scan(H.docs(spark, rows)).select("row.doc_id", "*").collect()
    assert len(out) == len(rows)
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"] if r["first_word"] is not None else -1, r["last_word"] if r["last_word"] is not None else -1, r["base_labels"]) for r in out)
    want = sorted((i, n, k, -1 if a is None else a, -1 if z is None else z, ls) for (i, t) in rows for n, k, a, z, ls in [plain(t)])
    assert got == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)


TEXTS = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files", "mit"),
    ("permission is hereby granted", ""),
    ("free of charge to any person", ""),
    ("A licence of mine.", ""),
]


@pytest.mark.parametrize("text, labels", TEXTS)
def test_templates(spark, text, labels):
    padded = "Start here. " * 50 + text + " And so on." * 50
    row = L.scan(H.docs(spark, [(1, padded)])).first()
    assert row["labels"] == labels
    assert (row["score"] >= 0.8) == bool(labels)


def test_whole_licences(spark):
    """Every whole licence is found in its own words, also with every fortieth word changed, and where it stands."""
    rows, want = [], []
    for i, (label, text) in enumerate(L.bodies()):
        ws = list(L.spelled(text))
        for changed in (False, True):
            body = [f"zz{j}" if changed and j % 40 == 39 else w for j, w in enumerate(ws)]
            rows.append((2 * i + changed, "one two three " * 5 + " ".join(body) + " four five" * 9))
            want.append((label, len(ws)))
    out = {r["row"]["doc_id"]: r for r in L.scan(H.docs(spark, rows)).collect()}
    for k, (label, size) in enumerate(want):
        assert label in out[k]["labels"].split(",")
        span = max((s for s in out[k]["spans"] if s["label"] == label), key=lambda s: s["last"] - s["first"])
        assert abs(span["first"] - 15) <= 2 and abs(span["last"] - (14 + size)) <= 2 and span["covered"] >= (0.8 if k % 2 else 0.99)


def best_chain(runs):
    """The most words that a chain of runs covers, by trying all."""

    def longest(k, to, done):
        return max((longest(j + 1, *(runs[j][1], runs[j][3])) + runs[j][3] - runs[j][2] for j in range(len(runs)) if runs[j][0] >= to and runs[j][2] >= done), default=0)

    return longest(0, 0, 0)


@pytest.mark.parametrize("seed", range(30))
def test_chains(seed):
    r = random.Random(seed)
    runs = set()
    for _ in range(r.randint(1, 9)):
        n, at, s = r.randint(3, 6), r.randint(0, 45), r.randint(0, 14)
        runs.add((at, at + n, s, s + n))
    size = 20  # all runs lie within three times that
    found = L.chains(runs, size)
    assert max(c for c, _, _ in found) == best_chain(sorted(runs))
    assert all(a < b for _, a, b in found)


def test_words_that_only_hash_alike(spark, monkeypatch):
    scanner = L.Scanner()
    token = scanner.vocabulary["cc"], scanner.vocabulary["by"]
    import numpy as np

    got = scanner.scan(np.array(token), np.array([0]), np.array([2]), lambda i: [b"cc", b"other"][i])
    assert got[0] == 0 and got[3] == set()
    got = scanner.scan(np.array(token), np.array([0]), np.array([2]), lambda i: [b"cc", b"by"][i])
    assert got[:4] == (1, 0, 0, {"cc-by"})


def test_empty_and_clashing(spark):
    assert L.scan(H.docs(spark, [])).count() == 0
    more = spark.createDataFrame([(1, "cc by", 7)], "doc_id long, text string, score int")
    row = L.scan(more).first()
    assert row["row"]["score"] == 7 and row["score"] == 0.0 and row["base_labels"] == "cc-by"


@pytest.mark.parametrize("seed", range(10))
def test_matching_statistics(seed):
    r = random.Random(seed)
    known = [[r.randrange(3) for _ in range(r.randint(1, 8))] for _ in range(4)]
    automaton = L.Automaton(known)
    text = [r.randrange(4) for _ in range(60)]
    parts = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
    for i, (size, state) in enumerate(automaton.statistics(text)):
        best = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in parts), default=0)
        assert size == best
        if size:
            run = text[i + 1 - size : i + 1]
            assert automaton.ends[state] == {(k, e) for k, t in enumerate(known) for e in range(size, len(t) + 1) if t[e - size : e] == run}


def test_score_is_the_covered_share(spark):
    """A phrase in prose scores below a template that nearly all stands; a whole template scores one."""
    body = L.spelled(max((text for _, text in L.bodies()), key=lambda x: len(L.spelled(x))))
    nearly = " ".join(f"other{i}" if i % 20 == 10 else w for i, w in enumerate(body))
    rows = [(1, "Some prose, cc by, all rights reserved."), (2, nearly), (3, " ".join(body))]
    out = {r["doc_id"]: r for r in L.scan(H.docs(spark, rows)).select("row.doc_id", "*").collect()}
    assert out[1]["base_labels"] == "cc-by,reserved" and out[1]["score"] < 0.8 < out[2]["score"] < out[3]["score"] == 1.0
