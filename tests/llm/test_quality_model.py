import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from fieldproof.llm import quality_model as Q

from . import helpers as H
from ..oracle import DATA


def packed(texts):
    spelled = [t.encode() for t in texts]
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)


def test_features_of_a_batch_are_those_of_each_text():
    """All statistics by plain Python; words' cells do not depend on the batch."""
    r = random.Random(1)
    texts = ["", "\n", "a", *H.prose(3, 40), "ABC! ABC! x9 ###\nABC! ABC! x9 ###\nABC! ABC! x9 ###", "é É\n\n\né É", "x" * 1000]
    sizes = np.array([r.randint(0, 99) for _ in texts])
    bucket, value, bounds, statistics = Q.features(*packed(texts), sizes, 512)
    for k, t in enumerate(texts):
        b, v, at, s = Q.features(*packed([t]), sizes[k : k + 1], 512)
        own = slice(bounds[k], bounds[k + 1])
        assert (b == bucket[own]).all() and np.allclose(v, value[own]) and np.allclose(s[0], statistics[k]) and at.tolist() == [0, len(b)]
        raw, words = t.encode(), H.WORDS.findall(t.encode())
        lines = [x for x in raw.split(b"\n")]
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        low = [w.translate(H.LOWER) for w in words]
        letters = lambda w: bytes(c for c in w if chr(c).isascii() and chr(c).isalpha())
        n, some, size = len(words), max(len(words), 1), max(len(raw), 1)
        share = lambda chars: sum(c in chars for c in raw) / size
        want = [
            math.log1p(n) / 8, math.log1p(len(raw)) / 8, math.log1p(len(lines)) / 4, math.log1p(sizes[k]) / 8, math.log1p(len(raw) / some) / 2, math.log1p(n / max(len(lines), 1)) / 4,
            len(b) / some, sum(x == y for x, y in zip(low, low[1:])) / some, share(range(65, 91)), share(range(48, 58)), share(b"#*$%&|<>=+@^~\\_{}[]"), share(b"!?.,;:'\"()-"), share(b" \t\n\x0b\f\r"),
            share(range(128, 256)), sum(bool(letters(w)) and letters(w).isupper() for w in words) / some, sum(w[-1] in b"#*$%&|<>=+@^~\\_{}[]!" for w in words) / some, (len(lines) - len(set(lines))) / max(len(lines), 1),
        ]
        assert np.allclose(s[0], want, atol=1e-6), t
        assert np.isclose((v**2).sum(), 1 if n else 0, atol=1e-5) and len(b) <= len(set(low))


def model_of(seed, buckets, rank, scale=0.3):
    r, size = np.random.default_rng(seed), buckets + len(Q.STATISTICS)
    return Q.Model(0.2, r.normal(0, scale, size).astype(np.float32), r.normal(0, scale, (size, rank)).astype(np.float32), r.normal(0, 0.1, len(Q.STATISTICS)), r.uniform(0.5, 2, len(Q.STATISTICS)))


def plain_score(model, bucket, value, statistics):
    """Every pair of features, one by one."""
    words = len(model.linear) - len(statistics)
    x = [*zip(bucket.tolist(), value.tolist(), strict=True), *enumerate(model.scaled(statistics).tolist(), words)]
    raw = model.bias + sum(model.linear[i] * v for i, v in x)
    raw += sum(float(model.pair[i] @ model.pair[j]) * v * u for a, (i, v) in enumerate(x) for j, u in x[:a])
    return 1 / (1 + math.exp(-raw))


def test_scores_equal_all_pairs():
    texts, model = ["", "a b a", *H.prose(4, 12), "ONE! ONE!\nONE! ONE!"], model_of(1, 128, 5)
    bucket, value, bounds, statistics = Q.features(*packed(texts), np.array([len(t) for t in texts]), 128)
    got = model.scores(bucket, value, bounds, statistics)
    assert np.allclose(got, [plain_score(model, bucket[a:b], value[a:b], s) for a, b, s in zip(bounds, bounds[1:], statistics, strict=False)], atol=1e-5)


def test_a_step_goes_down_the_slope():
    """One small step of training changes weights against the loss's finite differences."""
    texts, r = H.prose(5, 24), np.random.default_rng(2)
    found = Q.features(*packed(texts), np.array([len(t) for t in texts]), 64)
    label = r.integers(0, 2, len(texts)).astype(float)
    machine = Q.Machine(buckets=64, rank=3, epochs=1, steps=1, batch=64, rate=1e-6, decay=0)
    after = Q.train(*found, label, machine)
    start = np.random.default_rng(machine.seed)
    start.permutation  # noqa: B018
    pair = start.normal(0, 0.05, after.pair.shape)
    rate = (label.sum() + 1) / (len(label) + 2)

    def loss(linear, pair):
        p = Q.Model(math.log(rate / (1 - rate)), linear, pair, after.shift, after.scale).scores(*found)
        return -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))

    linear, checked = np.zeros(len(pair)), 0
    for i in [*found[0][:12].tolist(), *range(64, 64 + len(Q.STATISTICS))]:
        for f in range(3):
            up, down = pair.copy(), pair.copy()
            up[i, f] += 1e-4
            down[i, f] -= 1e-4
            slope = (loss(linear, up) - loss(linear, down)) / 2e-4
            if abs(slope) > 1e-5:  # Adam's first step is the rate times the slope's sign
                assert np.sign(pair[i, f] - after.pair[i, f].astype(float)) == np.sign(slope) or abs(pair[i, f] - after.pair[i, f]) < 2e-8
                checked += 1
        up, down = linear.copy(), linear.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (loss(up, pair) - loss(down, pair)) / 2e-4
        if abs(slope) > 1e-5:
            assert np.sign(after.linear[i]) == -np.sign(slope)
    assert checked > 20


def test_pairs_are_learnt():
    """Labels that no single word tells, only which two meet: a linear model can't, pairs can."""
    r = random.Random(4)
    rows = [(r.choice(["left", "right"]), r.choice(["up", "down"]), r.choice("abcdefgh")) for _ in range(1500)]
    label = np.array([float((a == "left") == (b == "up")) for a, b, _ in rows])
    found = Q.features(*packed([" ".join(x) for x in rows]), np.full(len(rows), 10), 256)
    model = Q.train(*found, label, Q.Machine(buckets=256, rate=0.05, epochs=40))
    assert ((model.scores(*found) > 0.5) == (label == 1)).mean() > 0.98


def corpus(n, seed=3):
    r = random.Random(seed)
    texts = H.prose(seed, n)
    rows, labels = [], []
    for i, t in enumerate(texts):
        good = r.random() < 0.7
        rows.append((i, t if good else " ".join(w + r.choice(["###", "$$$", "!!"]) for w in t.split(" ")), len(t)))
        labels.append((i, int(good)))
    return rows, labels


SCHEMA = "doc_id long, text string, n_chars long"


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(700)
    odd = [(9001, None, None), (9002, "", 0), (None, "some words", 10), (5, rows[5][1], rows[5][2]), (9003, "word " * 300_000, 1_500_000)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    tagged = spark.createDataFrame([*labels, (9001, None), (5, labels[5][1]), (None, 1), (10**9, 0)], "doc_id long, quality int")
    model = Q.fit(docs, tagged, Q.Machine(buckets=1024))
    out = Q.score(docs, model).select("row.*", "score").collect()
    assert len(out) == len(rows + odd) and all(0 <= r["score"] <= 1 for r in out)
    by = {}
    for r in out:
        assert by.setdefault(r["doc_id"], r["score"]) == pytest.approx(r["score"])
    assert by[9001] == by[9002]
    held = [(by[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.97


def test_held_out_labels_are_not_used(spark):
    """Turning every held-out label round, and all other columns, changes no score."""
    rows, labels = corpus(150)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    machine = Q.Machine(buckets=128, steps=20, epochs=1)
    one = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), machine)
    two = Q.fit(docs.repartition(7), spark.createDataFrame([(i, 1 - q if held(i) else q) for i, q in reversed(labels)], "doc_id long, quality int"), machine)
    assert one.bias == two.bias and (one.linear == two.linear).all() and (one.pair == two.pair).all()


def test_sample_is_bounded(spark):
    """Also where one id has very many rows."""
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows + [(7, f"row {i}", 3) for i in range(500)], SCHEMA)
    tagged = spark.createDataFrame(labels, "doc_id long, quality int")
    for n in (10, 40):
        got = Q.sampled(docs, tagged, Q.Machine(buckets=64, sample=n), "doc_id", "text", "n_chars", "quality").collect()
        assert len(got) <= n and all(zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_no_labels_no_rows_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b", 3)], SCHEMA)
    assert Q.score(docs, Q.fit(docs, none)).first()["score"] == 0.5
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.score(empty, Q.fit(empty, none)).collect() == []
    clash = spark.createDataFrame([(1, "a b", 0.1, "x")], "doc_id long, text string, score double, `a.b` string")
    (got,) = Q.score(clash, model_of(1, 64, 2), n_chars=None).collect()
    assert got["row"].asDict() == {"doc_id": 1, "score": 0.1, "a.b": "x"}


def test_query(spark):
    """On the labelled rows of sf0.01 that training left out."""
    got = {r["doc_id"]: r for r in Q.op13_quality_classifier(spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    known = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/sf0.01/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], q) for i, q in known if got[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95 and all(p for p, q in held if q)
    assert Counter(q for _, q in held)[0] > 5
