import hashlib
import random

import numpy as np
import pytest

from fieldproof.llm import suffix_dedup as S

from ..oracle import same
from . import helpers as H


def test_sql(spark):
    assert same(spark, S.op1_suffix_dedup, S.ORACLE) == 200


def check(spark, rows, length=20, gram=8, **options):
    out = {r["doc_id"]: r for r in S.remove_repeats(H.docs(spark, rows), length=length, gram=gram, **options).collect()}
    for (i, _), (text, gone) in zip(sorted(rows), H.repeats(rows, length), strict=True):
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = [k for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])]
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(text), sum(gone), len(spans)), i
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert bytes(r["kept"]) == kept and [s["start"] for s in r["spans"]] == spans


def test_prose(spark):
    check(spark, list(enumerate(H.prose(1, 60))), 100, 48)
    check(spark, list(enumerate(H.prose(2, 60, 30))))


def test_few_letters(spark):
    r = random.Random(3)
    check(spark, [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(60)])
    check(spark, [(i, ("ab" * 60)[: r.randint(0, 90)]) for i in range(20)] + [(90, "a" * 200), (91, "a" * 19), (92, "")])


@pytest.mark.parametrize("seed", range(2))
def test_crowded_grams(spark, monkeypatch, seed):
    """Every k-gram with two contexts is treated as a crowded one; and tasks deal often."""
    monkeypatch.setattr(S, "HELD", 50)
    line = "this very line stands in every document"
    rows = [(i, t[:200] + line[: 15 + i % 25] + t[-100:]) for i, t in enumerate(H.prose(7 + seed, 40, 30))]
    crowd = S.Crowd(every=1, least=2)
    assert len(S.crowded_grams(H.docs(spark, rows).selectExpr("doc_id as doc", "text"), 20, 8, (1, 2, 3, 4), crowd)) > 3
    check(spark, rows, crowd=crowd)
    check(spark, list(enumerate(["ab" * 30, "ab" * 20 + "c", "x" + "ab" * 25, "ab" * 30])), crowd=crowd)


def test_contexts_that_collide_are_seen(spark, monkeypatch):
    row = np.zeros(2, S.SUFFIX)
    row["gram"], row["context"], row["doc"], row["right"] = 5, 6, [1, 2], 4
    S._same(np.frombuffer(b"abcdabcd", np.uint8), np.array([0]), np.array([4]), np.array([4]))
    with pytest.raises(S.Collision):
        S._same(np.frombuffer(b"abcdabce", np.uint8), np.array([0]), np.array([4]), np.array([4]))
    row["right"] = [4, 5]
    with pytest.raises(S.Collision):
        S.settle(row)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 30), (4, "é" * 30 + "x"), (-5, "q" * 25)]
    check(spark, rows)
    least = -(1 << 63)
    out = S.remove_repeats(H.docs(spark, [(least, "z" * 25), (1, "z" * 25)]), length=20, gram=8).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(least, 24), (1, 25)]
    out = S.remove_repeats(H.docs(spark, [(None, "z" * 25), (1, "z" * 25)]), length=20, gram=8).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in out) == [(False, 25), (True, 24)]


def test_repeated_rows_and_ids(spark):
    same = "the quick brown fox jumps over it"
    out = S.remove_repeats(H.docs(spark, [(1, same), (1, same), (2, same)]), length=20, gram=8).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 0), (1, 0), (2, len(same))]
    out = S.remove_repeats(H.docs(spark, [(1, same), (1, same + "!")]), length=20, gram=8).collect()
    assert sorted(r["n_removed"] > 0 for r in out) == [False, True]


def test_empty_and_clashing(spark):
    assert S.remove_repeats(H.docs(spark, [])).count() == 0
    more = H.docs(spark, [(1, "x" * 30, "d", 5)], "doc_id long, text string, doc string, bucket int")
    assert S.remove_repeats(more, length=20, gram=8).first()["n_removed"] == 29


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 64)
    r = random.Random(4)
    data = "".join(r.choice("abc") for _ in range(900)).encode()
    found = set()
    for doc, base, part, at in S._segments(np.array([7]), np.frombuffer(data, np.uint8), np.array([0, 900]), 20):
        for s in range(len(part) - 19):
            found.add(int(base[0]) + s)
    assert found == set(range(881))


@pytest.mark.parametrize("seed", range(5))
def test_suffix_sort(seed):
    r = random.Random(seed)
    n, width = r.randint(1, 60), 12
    rows = [bytes(r.choice(b"ab") for _ in range(r.randint(0, width))) for _ in range(n)]
    group = np.sort([r.randrange(4) for _ in range(n)])
    text = np.zeros((n, width), np.uint8)
    for i, x in enumerate(rows):
        text[i, : len(x)] = np.frombuffer(x, np.uint8)
    order, common = S.suffix_sort(text, np.array([len(x) for x in rows]), group)
    assert [(group[i], rows[i]) for i in order] == sorted((g, x) for g, x in zip(group, rows, strict=True))
    for k in range(1, n):
        a, b = order[k - 1], order[k]
        want = next((j for j in range(13) if rows[a][j : j + 1] != rows[b][j : j + 1] or j >= min(len(rows[a]), len(rows[b]))), 12)
        assert common[k] == (want if group[a] == group[b] else 0)


def test_collisions_are_seen(monkeypatch):
    monkeypatch.setattr(S, "byte_codes", lambda seed: np.zeros(256, np.uint64))
    text = np.frombuffer(b"abcabd", np.uint8).reshape(2, 3)
    with pytest.raises(S.Collision):
        S.suffix_sort(text, np.array([3, 3]), np.zeros(2, np.int64))
    with pytest.raises(RuntimeError):
        S._sorted(text, np.array([3, 3]), np.zeros(2, np.int64))
