import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldproof.llm import fill_middle as M

from . import helpers as H
from ..oracle import same

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+"}


def plain(doc_id, text, fim=M.Fim()):
    """One text at a time, by slices of its units."""
    text = text or ""
    units = re.findall(UNITS[fim.unit], text)
    n = len(units)
    spelled = hashlib.sha256(f"{fim.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(spelled[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    a, b, z = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in fim.marks) or h[2] % 100 >= fim.percent:
        return n, "plain", None, None, text
    if h[3] % 100 < fim.spm_percent:
        return n, "spm", len(a), len(b), fim.suffix + z + fim.prefix + a + fim.middle + b
    return n, "psm", len(a), len(b), fim.prefix + a + fim.suffix + z + fim.middle + b


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "é\nü\n\n中文\n😀", "<P>", "x<S", "S>\nx", "a <M> b\n", "<\n<\n<S\n", "  two  words \n", "\r\n\r\n", "\x00\n\x00"]


def texts(seed, n):
    r = random.Random(seed)
    return [(i, "".join(r.choice(["a", "é", "中", "😀", "\n", " ", "<", "P>", "line\n", "<S"]) for _ in range(r.randint(0, 60)))) for i in range(n)]


def rows_of(df):
    return sorted((r["row"]["doc_id"] if r["row"]["doc_id"] is not None else -1, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect())


@pytest.mark.parametrize("fim", [M.Fim(), M.Fim(unit="word", seed=3, percent=60), M.Fim(unit="char", spm_percent=0, prefix="<|fim_prefix|>", suffix="<|fim_suffix|>", middle="<|fim_middle|>")])
def test_against_slices(spark, fim):
    rows = texts(1, 300) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "of no\nid\n"), (5, "again\nand\nagain\n"), (5, "again\nand\nagain\n")]
    made = M.restore(M.transform(H.docs(spark, rows).repartition(3), fim=fim), fim).persist()
    assert rows_of(made) == sorted(((-1 if i is None else i), *plain(i, t, fim)) for i, t in rows)
    assert {r["form"] for r in made.select("form").collect()} >= {"plain", "psm"}
    texts_back = sorted((r["row"]["doc_id"] if r["row"]["doc_id"] is not None else -1, r["restored"]) for r in made.collect())
    assert texts_back == sorted((-1 if i is None else i, t or "") for i, t in rows)
    made.unpersist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("\n <PSM>aé", max_size=40), max_size=8), st.sampled_from(M.UNITS), st.integers(0, 2**32))
def test_kernel_on_any_text(rows, unit, seed):
    r, fim = random.Random(seed), M.Fim(unit=unit)
    data, offsets = H_utf8(rows)
    h = np.array([[r.randrange(2**32) for _ in rows] for _ in range(4)], np.int64).reshape(4, len(rows))
    n, form, chars, out, at = M.transformed(data, offsets, h, fim)
    for k, text in enumerate(rows):
        units = re.findall(UNITS[unit], text)
        assert n[k] == len(units)
        low, high = sorted([h[0, k] % (len(units) + 1), h[1, k] % (len(units) + 1)])
        a, b, z = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        want = [text, f"<P>{a}<S>{z}<M>{b}", f"<S>{z}<P>{a}<M>{b}"][form[k]]
        assert out[at[k] : at[k + 1]].tobytes().decode() == want
        assert (form[k] == 0) == (not text or any(m in text for m in fim.marks))
        if form[k]:
            assert chars[:, k].tolist() == [len(a), len(b)]


def H_utf8(rows):
    spelled = [t.encode() for t in rows]
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)


def test_long_texts_and_batches(spark):
    """Texts longer than a batch of the kernel, among short ones."""
    rows = [(i, ("line %d\n" % i) * k) for i, k in enumerate([3, 400_000, 2, 0, 70_000, 1])]
    made = M.restore(M.transform(H.docs(spark, rows).coalesce(1)))
    assert rows_of(made) == sorted((i, *plain(i, t)) for i, t in rows)
    assert {r["row"]["doc_id"]: r["restored"] for r in made.collect()} == dict(rows)


def test_empty_tables_and_clashing_columns(spark):
    assert M.transform(H.docs(spark, [])).collect() == []
    clash = spark.createDataFrame([(1, "a\nb\n", "x", 7, "y")], "doc_id long, text string, output string, n int, `od.d` string")
    (got,) = M.restore(M.transform(clash)).collect()
    assert got["row"].asDict() == {"doc_id": 1, "output": "x", "n": 7, "od.d": "y"} and got["restored"] == "a\nb\n"


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "b", "c"), ("xa", "ay", "m")])
def test_sentinels_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        M.Fim(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_equals_sql(spark):
    assert same(spark, M.op12_fill_in_middle, M.ORACLE) >= 200
