import random

import numpy as np
import pytest

from fieldproof.llm import minhash as M
from fieldproof.llm.common import connected

from ..oracle import same
from . import helpers as H


def test_sql(spark):
    assert same(spark, M.op3_minhash, M.ORACLE) == 200


@pytest.mark.parametrize("shingle, options", [(2, {}), (5, {}), (2, {"chunk": 4, "set_chunk": 3, "first_tries": 1, "broadcast": 0})])
def test_against_all_pairs(spark, shingle, options):
    rows = list(enumerate(H.prose(5, 120)))
    out = {r["id"]: r for r in M.components(H.docs(spark, rows), params=M.Params(shingle=shingle, **options)).collect()}
    want = H.components(rows, shingle)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(H.shingles(rows[i][1], shingle)) for i, r in out.items())


@pytest.mark.parametrize("size", [1, 2, 9, 64, 65, 300, 1500])
@pytest.mark.parametrize("width, matches, share", [(64, 78, 0.0), (64, 78, 0.45), (64, 78, 0.9), (8, 9, 0.5), (8, 16, 0.8), (8, 7, 0.3)])
@pytest.mark.parametrize("small, listed", [(0, 1 << 40), (None, None)])
def test_skip_merging_counts_all_collisions(size, width, matches, share, small, listed, monkeypatch):
    """Rows are drawn around three centres; whoever agrees in enough coordinates is met, as comparing all with all says."""
    if small is not None:
        monkeypatch.setattr(M._Merge, "SMALL", small)
        monkeypatch.setattr(M._Merge, "LISTED", listed)
    r = np.random.default_rng(size + matches)
    nibbles = r.integers(0, 16, (size, 2 * width))
    centres = r.integers(0, 16, (3, 2 * width))
    taken = r.random((size, 2 * width)) < share
    nibbles = np.where(taken, centres[r.integers(0, 3, size)], nibbles)
    sketches = (nibbles[:, 0::2] | nibbles[:, 1::2] << 4).astype(np.uint8)
    merge = M._Merge(sketches, matches)
    for i in range(0, size, max(size // 40, 1)):
        equal = (nibbles == nibbles[i]).sum(axis=1)
        rows, match = merge.of(i)
        assert rows.tolist() == np.flatnonzero(equal >= matches).tolist() and match.tolist() == equal[rows].tolist()


@pytest.mark.parametrize("seed", range(2))
def test_lists_that_unlike_documents_share(spark, seed, monkeypatch):
    """Half of every document is the same, the rest its own: lists are long, and few of those in them are linked."""
    r = random.Random(seed)
    said = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(60)) for _ in range(n))
    common = said(60)
    rows = []
    for i in range(90):
        rows.append((len(rows), common + " " + said(r.randint(20, 70))))
        if i % 6 == 0:
            words = rows[-1][1].split(" ")
            words[r.randrange(60, len(words))] = "other"
            rows.append((len(rows), " ".join(words)))
    want = H.components(rows, 2)
    assert len(set(want.values())) < len(rows)
    called = []
    refined = M._refined
    monkeypatch.setattr(M, "_refined", lambda *a: called.append(1) or refined(*a))
    for options in ({}, {"chunk": 6, "set_chunk": 4, "first_tries": 2}):
        out = {x["id"]: x["component_id"] for x in M.components(H.docs(spark, rows), params=M.Params(shingle=2, **options)).collect()}
        assert out == want and bool(called) == bool(options)


def test_parts_keep_pairs_together(spark):
    """Whoever shares enough coordinates shares a part of every crowded list that both are in."""
    r = random.Random(5)
    p = M.Params(posted=12, meets=5)
    values = {i: [r.randrange(3) for _ in range(12)] for i in range(60)}
    reps = spark.createDataFrame([(i, np.array(v, "<u4").tobytes()) for i, v in values.items()], "id long, sig binary")
    keys = {i: {j << 32 | x for j, x in enumerate(v)} for i, v in values.items()}
    for base in (0, 3 << 32 | 1):
        rows = [(i, i, base * 256 + 7) for i in keys if base in keys[i]]
        parts = {}
        for x in M._refined(spark.createDataFrame(rows, "id long, label long, key long"), reps, p).collect():
            parts.setdefault(x["id"], set()).add(x["key"])
        ids = [i for i, *_ in rows]
        for i in ids:
            assert all(parts.get(i, set()) & parts.get(j, set()) for j in ids if i < j and len(keys[i] & keys[j]) >= p.meets)
        assert sum(not parts.get(i, set()) & parts.get(j, set()) for i in ids for j in ids if i < j) > 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (6, long), (7, long + " end"), (None, "one"), (8, long), (8, long), (9, "x y"), (9, "one")]
    out = M.components(H.docs(spark, rows), params=M.Params(shingle=2)).collect()
    got = sorted((r["id"] is None, r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["id"] is not None)
    assert [g[1:] for g in got] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 2999, 6, True), (7, 3000, 6, False),
        (8, 2999, 6, False), (8, 2999, 6, False), (9, 1, 3, False), (9, 1, 3, False),
    ]
    null = [r for r in out if r["id"] is None]
    assert [(r["component_id"], r["kept"]) for r in null] == [(None, True)]


def test_empty_and_clashing(spark):
    assert M.components(H.docs(spark, [])).count() == 0
    more = H.docs(spark, [(1, "a b c d e f", "k"), (2, "a b c d e f", "l")], "doc_id long, text string, id string")
    kept = M.keep(more)
    assert kept.columns == more.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_components_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (200, 150), (150, 160), (160, 200)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 160: 150, 200: 150}
    assert connected(links.where("false")).count() == 0
