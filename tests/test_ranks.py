import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldproof.operators import metrics, ranks, review, select


def quantile(xs, q):
    xs, at = sorted(xs), q * (len(xs) - 1)
    low, high = xs[math.floor(at)], xs[math.ceil(at)]
    return low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))


GROUPS = {
    "even": lambda r: [r.random() for _ in range(700)],
    "ties": lambda r: [r.choice([1.0, 2.0, 2.5]) for _ in range(400)],
    "scales": lambda r: [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(500)],
    "one": lambda r: [7.25],
    "two": lambda r: [1.0, 2.0],
    "zeros": lambda r: [0.0, -0.0, 0.0, 5e-324],
    "ends": lambda r: [-1.7e308, 1.7e308, 0.0, 1.0],
    "near": lambda r: [1.0 + k * 2.0**-52 for k in range(300)],
    None: lambda r: [float(k) for k in range(101)],
}


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PARTS", 1024)
    monkeypatch.setattr(ranks, "FEW", 3)
    r = random.Random(4)
    made = {g: f(r) for g, f in GROUPS.items()}
    rows = [(g, x) for g, xs in made.items() for x in xs] + [("even", None), ("even", float("nan")), ("ties", float("inf")), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x["g"]: x for x in ranks.percentiles(df, "x", ("g",), {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    assert set(got) == set(made)
    for g, xs in made.items():
        assert got[g]["n"] == len(xs)
        assert [got[g][k] for k in "abcd"] == [quantile(xs, q) for q in (0.0, 0.5, 0.95, 1.0)], g


def test_a_hot_group_is_never_gathered(spark, monkeypatch):
    """All rows in one group, with few parts: no list is longer than FEW."""
    monkeypatch.setattr(ranks, "PARTS", 256)
    monkeypatch.setattr(ranks, "FEW", 40)
    df = spark.range(20_000).select((F.xxhash64("id") / 2.0**63).alias("x"))
    xs = np.sort(np.array([r[0] for r in df.collect()]))
    got = ranks.at_ranks(df, "x", (), {"some": tuple(F.lit(k) for k in (0, 17, 9_999, 19_999))}).collect()
    assert [x["some"] for x in got] == [[xs[k] for k in (0, 17, 9_999, 19_999)]]


def test_latency_by_group_and_without_rows(spark):
    rows = [("a", None, 1.0, 3.0), ("a", None, 2.0, 5.0), ("a", "late", 99.0, 9.0), ("b", None, None, 1.0), (None, None, 4.0, None)]
    df = spark.createDataFrame(rows, "g string, error string, wall_seconds double, memory double")
    got = {r["g"]: tuple(r)[1:] for r in metrics.latency(df, ("g",)).collect()}
    assert got == {"a": (1.5, 1.5, 1.95, 5.0), "b": (None, None, None, 1.0), None: (4.0, 4.0, 4.0, None)}
    assert [tuple(r) for r in metrics.latency(df.where("false")).collect()] == [(None, None, None, None)]


def test_rounding_is_of_the_exact_value(spark):
    r = random.Random(1)
    xs = [0.1 + 0.5625, 0.0625, 0.1875, 0.3125, 0.5625, 2.0005, 1.0005, 1e-9, 0.0, 0.0004882812, 0.0005, 0.00049999999999, 123456.7895, 2.675, 1e9 + 0.0005, -0.0625, -2.0015]
    xs += [r.choice([round(r.uniform(0, 10 ** r.randint(0, 6)), 4), r.uniform(0, 50), k / 16 + r.randint(0, 99) / 10]) for k in range(3000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", review.exactly_rounded(F.col("x")).alias("y")).collect()
    assert [(a["x"], a["y"]) for a in got if a["y"] != round(a["x"], 3)] == []


def test_far_offsets(spark, monkeypatch):
    """Selections that begin or end far behind go by rank, and equal those that go by the first rows."""
    rows = spark.range(3000).select((F.col("id") * 3 + 1).alias("line_no"))
    cases = [(0, 2500), (1999, 30), (2990, 30), (3000, 5), (10**9, None), (50, None)]
    ids = lambda: [sorted(r[0] for r in select.offset_limit(rows, *c).collect()) for c in cases]
    monkeypatch.setattr(select, "NEAR", 20)
    far = ids()
    assert far == [[3 * i + 1 for i in range(3000)][low:][: 3000 if n is None else n] for low, n in cases]
    assert select.offset_limit(rows.where("false"), 100, 5).collect() == []
