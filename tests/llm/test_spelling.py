import random
import re
import zlib
from collections import Counter

import pytest

from fieldproof.llm import spelling as S

from . import helpers as H
from ..oracle import DATA, connect

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans(S.UPPER, S.LOWER)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=3, chars=5, typo=S.TYPO):
    """All pairs of words, compared one by one."""
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if typo and h % typo == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= chars:
                n[run] += 1
    words = [w for w in n if n[w] >= least]
    near = {w: [o for o in words if o != w and abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def found(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def misspelt(seed, n):
    r = random.Random(seed)
    letters = "abé"  # few letters: most words have near words, and segments are shared by many
    stems = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(6)]
    rows = []
    for i in range(n):
        said = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(stems[: 1 + int(len(stems) * r.random() ** 2)])
            while r.random() < 0.4:
                at = r.randrange(len(w) + 1)
                w = w[:at] + r.choice(letters + "Z") * r.randint(0, 1) + w[at + r.randint(0, 1) :]
            said.append(r.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, r.choice([" ", ", ", "9", "Ā"]).join(said)))
    return rows


@pytest.mark.parametrize("group", [1, 4, 64])
def test_against_all_pairs(spark, group):
    """Groups of a key are cut down to every depth; the result is the same."""
    rows = misspelt(group, 120) + [(7, None), (8, ""), (None, "aaaaa aaaaa aaaaa aaaab aaaab aaaab"), (5, "12 - _")]
    rows += [(6, "chain " * 40 + "chains " * 15 + "chaines " * 6)]
    got = found(S.variants(H.docs(spark, rows), group=group))
    want = plain(rows)
    assert got == want and sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)


def test_every_edit_is_found_once(spark):
    """Every single edit of a word, at both ends, at the cut and of doubled letters, is near it exactly once."""
    base = "aabbccdd"
    kinds = {base[:i] + c + base[i + k :] for i in range(len(base) + 1) for c in ["", *"abcdxé"] for k in (0, 1)} - {base}
    rows = [(0, " ".join([base] * 3 + sorted(kinds) * 3))]
    for group in (1, 1000):
        got = found(S.variants(H.docs(spark, rows), group=group, typo=0))
        assert got == plain(rows, typo=0)
        assert next(x for x in got if x[0] == base)[4] == len(kinds)


def test_no_typos_ties_and_repeated_rows(spark):
    rows = [(1, "shown shown shown shows shows shows showy showy showy"), (2, "spots " * 8 + "spotz " * 4 + "spatz " * 4)] * 2
    got = found(S.variants(H.docs(spark, rows), typo=0))
    assert got == plain(rows, typo=0)
    assert {x[0]: (x[1], x[2]) for x in got}["spatz"] == (None, "spatz")
    assert {x[0]: (x[1], x[2]) for x in got}["spotz"] == ("spots", "spots")


def test_long_words_empty_tables_and_clashing_columns(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long} {long} {long}x {long}x {long}x")]
    assert [x[4] for x in found(S.variants(H.docs(spark, rows), typo=0))] == [1, 1]
    assert found(S.variants(H.docs(spark, []))) == []
    assert found(S.variants(H.docs(spark, [(1, "one two"), (2, None)]))) == []
    clash = spark.createDataFrame([(1, "spell spell spell", "a", 5, 3)], "doc_id long, text string, word string, rank int, n int")
    assert found(S.variants(clash, typo=0)) == [("spell", None, "spell", 3, 0, None)]
    with pytest.raises(ValueError):
        S.variants(H.docs(spark, rows), ratio=1)


def test_equals_sql(spark):
    want = connect("sf0.001").execute(f"SELECT word, form, root, n, n_near, form_n FROM ({S.ORACLE})").fetchall()
    assert found(S.op11_spelling_variants(spark, f"{DATA}/sf0.001")) == sorted(want) and len(want) > 100


def test_groups_do_not_grow_pairs(spark):
    """Words that share a half are cut until few meet: candidates stay in proportion to words, not to their square."""
    r = random.Random(5)
    words = sorted({"stem" + "".join(r.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(3000)})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, rank long")
    keys = S._segments(table, 1).persist()
    assert keys.groupBy("key").count().where(f"count > {S.GROUP}").count() > 0
    got = {x["rank"]: x["n_near"] for x in S.near(table).collect()}
    known = set(words)
    holes = Counter(w[:i] + "_" + w[i + 1 :] for w in words for i in range(len(w)))
    want = {i: k for i, w in enumerate(words) if (k := sum(holes[w[:j] + "_" + w[j + 1 :]] - 1 for j in range(len(w))))}
    assert got == want and len(known) == len(words)
    keys.unpersist()
