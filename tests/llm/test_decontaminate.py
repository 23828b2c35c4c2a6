import random

import numpy as np
import pytest

from fieldproof.llm import decontaminate as D

from . import helpers as H

LETTERS = "abcd"


def altered(r, text, edits):
    x = list(text)
    for _ in range(edits):
        k = r.randrange(len(x))
        kind = r.choice("sid")
        if kind == "s":
            x[k] = r.choice(LETTERS)
        elif kind == "i":
            x.insert(k, r.choice(LETTERS))
        else:
            x.pop(k)
    return "".join(x)


@pytest.mark.parametrize("seed", range(40))
def test_against_edit_distance(seed):
    r = random.Random(seed)
    said = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    item = said(r.randint(40, 90))
    limit = int(0.08 * len(item))
    text = said(r.randint(0, 40)) + altered(r, item, r.randint(0, limit + 4)) + said(r.randint(0, 40))
    data = np.frombuffer(text.encode(), np.uint8)
    squeezed, at = D.squeeze(data, np.array([0, len(data)]))
    found = D.scan(squeezed, at, D.Index([(1, item.encode())], D.Budget()))
    best = H.edits(item, text)
    assert bool(found) == (best <= limit)
    assert not found or min(f[4] for f in found) == best


ITEM = "Which river flows through the old town before it meets the sea at noon?"


def test_documents(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (None, None), (9, ITEM.upper())], "item_id long, text string")
    rows = [
        (1, "Intro. " + ITEM + " Outro."), (2, "which  RIVER\nflows through the old town before it meets\tthe sea at noon?"), (3, ITEM.replace("old", "odl")),
        (4, "Which river flows through a wide valley and some other town."), (5, None), (6, ""), (7, ITEM + " and " + ITEM), (1, "Intro. " + ITEM + " Outro."), (None, ITEM[:30]),
        (10, "x" * 200_000 + ITEM + "y" * 200_000),
    ]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, spans int")
    for options in ({}, {"block_bytes": 1}):
        out = D.find(docs, bench, **options).collect()
        hit = sorted((r["row"]["doc_id"] or 0, sorted({s["item_id"] for s in r["spans"]}), sorted({s["edits"] for s in r["spans"]})) for r in out if r["spans"])
        assert [h[:2] for h in hit] == [(i, [7, 9]) for i in (1, 1, 2, 3, 7, 10)]
        assert [h[2] for h in hit if h[0] == 3] == [[2]]
        assert len(next(r for r in out if r["row"]["doc_id"] == 7)["spans"]) == 4
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 6]
    assert D.find(docs, bench.where("false")).where("size(spans) = 0").count() == len(rows)
    assert D.find(docs.where("false"), bench).count() == 0


def test_short_items(spark):
    """Items under 40 bytes are found where they stand as whole words, unchanged but for case and white space."""
    items = [(1, "What is the capital of Peru?"), (2, "Who was he"), (3, "2+2=4"), (4, "née"), (5, "Lima, Peru")]
    rows = [
        (1, "Q: what IS\tthe capital  of Peru? A: ..."), (2, "What is the capitol of Peru?"), (3, "who was he"), (4, "who was hers, who was hé"), (5, "so 2+2=4."), (6, "12+2=4 2+2=45"),
        (7, "(Née) X"), (8, "années"), (9, "xWho was he"), (10, "Who was he? Who was he"), (11, "In Lima, Peru."), (12, ""), (13, None), (14, "?"), (15, "who was"),
    ]
    bench = spark.createDataFrame([*items, (6, " "), (7, "")], "item_id long, text string")
    found = {r["row"]["doc_id"]: [(s["item_id"], s["start"], s["end"], s["edits"]) for s in r["spans"]] for r in D.find(H.docs(spark, rows), bench).collect()}
    assert {i: [x[0] for x in v] for i, v in found.items() if v} == {1: [1], 3: [2], 5: [3], 7: [4], 10: [2, 2], 11: [5]}
    assert found[1] == [(1, 3, 31, 0)] and found[10] == [(2, 0, 10, 0), (2, 12, 22, 0)]
    assert sorted(r["doc_id"] for r in D.clean(H.docs(spark, rows), bench.where("item_id <> 4")).collect()) == [2, 4, 6, 7, 8, 9, 12, 13, 14, 15]


@pytest.mark.parametrize("seed", range(20))
def test_short_against_search(seed):
    r = random.Random(seed)
    said = lambda n: "".join(r.choice("ab ,") for _ in range(n))
    squeezed = lambda x: " ".join(x.split())
    items = sorted({x for x in (squeezed(said(r.choice([1, 2, 3, 7, 8, 9, 12]))) for _ in range(12)) if x})
    texts = [squeezed(said(r.randint(0, 400))) for _ in range(8)]
    raw = "".join(texts).encode()
    text, at = D.squeeze(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    got = {(x[0], x[1], x[2]) for x in D.scan(text, at, D.Index([(k, x.encode()) for k, x in enumerate(items)], D.Budget()))}
    alone = lambda t, s, e: not t[s - 1 : s].isalnum() * (s > 0) and not t[e : e + 1].isalnum()
    want = {(i, k, s) for i, t in enumerate(texts) for k, x in enumerate(items) for s in range(len(t) - len(x) + 1) if t[s : s + len(x)] == x and alone(t, s, s + len(x))}
    assert got == want


REPETITIVE = [(1, b"a" * 100), (2, b"a" * 60 + b"b" * 40), (3, b"name: " + b"_" * 80)] + [(10 + i, b"a" * 70 + b"q%d" % i) for i in range(50)]


def test_repetitive_text_is_bounded():
    """Equal letters against items with long runs of their own, exact, near and none: CPU time goes with the bytes, memory doesn't."""
    import resource
    import time

    index = D.Index(REPETITIVE, D.Budget())
    assert len(index.keys) < 25 * len(REPETITIVE)
    spent = {}
    for size in (100_000, 400_000):
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
        data = np.full(size, ord("a"), np.uint8)
        text, at = D.squeeze(data, np.array([0, len(data)]))
        found = D.scan(text, at, index)
        spent[size] = time.process_time() - began
        assert [f[:3] for f in found if f[1] == 0] == [(0, 0, 0)] and found[0][4] == 0 and found[0][3] > size - 1000
        assert not [f for f in found if f[1] in (1, 2)] and all(f[4] <= 5 for f in found) and len({f[1] for f in found}) == 51
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert spent[400_000] < 40 and spent[400_000] < 6 * spent[100_000] + 1


@pytest.mark.parametrize("seed", range(20))
def test_alignment_of_a_stretch(seed):
    """Ends of occurrences in rows of few letters are where plain edit distance has them; none crosses rows."""
    r = random.Random(seed)
    item = "".join(r.choice("ab") for _ in range(r.randint(5, 30)))
    rows = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
    rows += [item[:-1], item[1:] + item, ""]
    raw = "".join(rows).encode()
    text, at = D.squeeze(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, rows)]))
    most = r.randint(0, 9)
    found = list(D._aligned(text, at, np.frombuffer(item.encode(), np.uint8), most, 0, len(text)))
    for k, t in enumerate(rows):
        mine = [f for f in found if f[0] == k]
        best = H.edits(item, t)
        assert bool(mine) == (best <= most), (item, t)
        assert not mine or (min(f[3] for f in mine) == best and all(at[k] <= f[1] <= f[2] <= at[k + 1] - D.Q for f in mine))


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_edit_distance(seed, monkeypatch):
    """Few letters, long runs, small stretches: items are found wherever plain edit distance finds them."""
    r = random.Random(seed)
    monkeypatch.setattr(D, "PIECE", 64)
    monkeypatch.setattr(D, "MOST", r.choice([50, 1000]))
    monkeypatch.setattr(D, "DEAR", r.choice([0, 5, 64, 10_000]))
    monkeypatch.setattr(D, "AT_ONCE", r.choice([16, 1 << 14]))
    run = lambda n: "".join(r.choice("ab") * r.randint(1, 15) for _ in range(n))
    items = [run(12)[: r.randint(40, 70)].ljust(40, "a") for _ in range(3)]
    text = run(30) + altered(r, items[0], r.randint(0, 6)) + run(30)
    data = np.frombuffer(text.encode(), np.uint8)
    squeezed, at = D.squeeze(data, np.array([0, len(data)]))
    found = D.scan(squeezed, at, D.Index([(k, x.encode()) for k, x in enumerate(items)], D.Budget()))
    for k, item in enumerate(items):
        best, mine = H.edits(item, text), [f for f in found if f[1] == k]
        assert bool(mine) == (best <= int(0.08 * len(item)))
        assert not mine or min(f[4] for f in mine) == best


@pytest.mark.parametrize("size", range(56, 80))
def test_stretches_end_anywhere(size, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 8)
    index = D.Index([(1, b"item of forty letters or more, as it is said"), (2, b"Lima")], D.Budget())
    step = 2 * index.reach
    data = np.frombuffer(("x" * (step - size) + " Lima item of forty letters or more, as it is said " + "y" * size).encode(), np.uint8)
    text, at = D.squeeze(data, np.array([0, len(data)]))
    assert sorted(f[1] for f in D.scan(text, at, index)) == [0, 1]


def test_budget_must_leave_something():
    with pytest.raises(ValueError):
        D.Index([(1, b"a" * 100)], D.Budget(rate=0.2))
