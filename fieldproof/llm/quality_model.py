"""Quality classifier: a factorisation machine over hashed words, statistics of a text's structure and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f ((V_f.x)^2 - V_f^2.x^2)): every pair of features interacts through vectors of low rank,
and the sum-of-squares identity makes that linear in the features that a text has. Words of the whole text are hashed into
buckets; a bucket's value is its share of the text, damped. The model is trained in numpy on a bounded sample of labelled rows;
all rows are scored where they are, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, table, utf8
from .textkit import LOWER, NOT_SPACE, PIECE, mix, pieces, run_hashes, words


@dataclass(frozen=True)
class Machine:
    """Size of the model and of its training. At most ``sample`` labelled rows reach the driver, each as at most ``buckets`` cells of
    six bytes, so 8,192 rows of 4,096 cells are 200 MB at the very most, and some 15 MB for usual texts."""

    buckets: int = 4096
    rank: int = 8
    sample: int = 8192
    epochs: int = 12
    steps: int = 500
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


#: What is measured of a text, besides its words; all are shares or damped counts, so a text of any length has values of like size.
STATISTICS = (
    "log of words", "log of bytes", "log of lines", "log of n_chars", "bytes a word", "words a line", "distinct buckets a word", "repeated neighbours a word",
    "capitals", "digits", "symbols", "marks", "blanks", "beyond ASCII", "words of capitals", "words that end in a symbol", "lines that equal an earlier one",
)
_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 65:91] = True
_KINDS[1, 48:58] = True
_KINDS[2, [ord(c) for c in "#*$%&|<>=+@^~\\_{}[]"]] = True
_KINDS[3, [ord(c) for c in "!?.,;:'\"()-"]] = True
_KINDS[4, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KINDS[5, 0x80:] = True
_ENDS_ODDLY = _KINDS[2] | (np.arange(256) == ord("!"))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of words (bucket, value; of rows between the n + 1 bounds), and an array of STATISTICS, for whole texts."""
    n = len(offsets) - 1
    starts, ends, count = words(data, offsets, NOT_SPACE)
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    hashes = run_hashes(LOWER[data], starts, ends)
    cell, times = np.unique(row * buckets + (hashes >> np.uint64(40)).astype(np.int64) % buckets, return_counts=True)
    bounds = np.searchsorted(cell, np.arange(n + 1) * buckets)
    value = np.sqrt(times / np.maximum(count, 1)[cell // buckets])

    size, some = np.diff(offsets), np.maximum(count, 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1, offsets[1:]])) if len(data) else np.zeros(1, np.int64)
    line_row = np.searchsorted(offsets, edges[:-1], "right") - 1
    lines = np.bincount(line_row, minlength=n)
    # a line's hash is of its bytes with its break; equal ones of a row meet in a sort
    spelled = mix(run_hashes(data, edges[:-1], edges[1:]) + line_row.astype(np.uint64)) if len(edges) > 1 else np.empty(0, np.uint64)
    _, first = np.unique(spelled, return_index=True)
    fresh = np.bincount(line_row[first], minlength=n)
    capitals = np.concatenate([[0], np.cumsum(_KINDS[0][data])])
    letters = np.concatenate([[0], np.cumsum(_KINDS[0][data] | _KINDS[0][data - 32 * (data >= 97)])])
    upper = (letters[ends] - letters[starts] > 0) & (capitals[ends] - capitals[starts] == letters[ends] - letters[starts])
    shares = [_sums(kind[data], offsets) / np.maximum(size, 1) for kind in _KINDS]
    statistics = np.stack(
        [
            np.log1p(count) / 8, np.log1p(size) / 8, np.log1p(lines) / 4, np.log1p(np.maximum(n_chars, 0)) / 8, np.log1p(size / some) / 2, np.log1p(count / np.maximum(lines, 1)) / 4,
            np.diff(bounds) / some, _sums(again, at) / some, *shares, _sums(upper, at) / some, _sums(_ENDS_ODDLY[data[ends - 1]], at) / some, (lines - fresh) / np.maximum(lines, 1),
        ],
        1,
    )
    return (cell % buckets).astype(np.int32), value.astype(np.float32), bounds, statistics.astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    """(batch, first row, end, features) for runs of rows of each batch."""
    for batch in batches:
        data, offsets = utf8(batch.column("_text"))
        n_chars = batch.column("_size").fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in pieces(offsets, PIECE):
            yield batch, a, b, features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_chars[a:b], buckets)


@dataclass(frozen=True)
class Model:
    """Weights of buckets and statistics; ``shift`` and ``scale`` bring statistics to mean 0 and deviation 1."""

    bias: float
    linear: np.ndarray
    pair: np.ndarray
    shift: np.ndarray
    scale: np.ndarray

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        # as the largest statistics of unlike texts lie far out, they are damped beyond four deviations
        z = (statistics - self.shift) / self.scale
        return (4 * np.tanh(z / 4)).astype(np.float32)

    def scores(self, bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        """In linear time: per row the sums of w x, of V x and of its squares."""
        words_, z = len(self.linear) - statistics.shape[1], self.scaled(statistics)
        linear, square, summed = _rows(self.linear, self.pair, bucket, value, bounds)
        vz = self.pair[words_:]
        linear += z @ self.linear[words_:]
        summed += z @ vz
        square += (z * z) @ (vz * vz)
        raw = self.bias + linear + 0.5 * (summed * summed - square).sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _rows(linear: np.ndarray, pair: np.ndarray, bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of w x, (v x)^2 and v x over each row's cells."""
    wx = (linear[bucket] * value).astype(np.float64)
    vx = (pair[bucket] * value[:, None]).astype(np.float64)
    cells = np.concatenate([wx[:, None], vx * vx, vx], 1)
    rank, out = pair.shape[1], np.zeros((len(bounds) - 1, 1 + 2 * pair.shape[1]))
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = np.add.reduceat(cells, bounds[:-1][full], 0)
    return out[:, 0], out[:, 1 : 1 + rank], out[:, 1 + rank :]


def train(bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray, statistics: np.ndarray, label: np.ndarray, machine: Machine) -> Model:
    """Adam over batches of rows, of the log loss and a small decay of the weights: ``epochs`` times all rows, or ``steps`` batches
    where that is more. Without rows, a model that knows nothing: every score is one half."""
    n, draw = len(label), np.random.default_rng(machine.seed)
    width = statistics.shape[1]
    size = machine.buckets + width
    if not n:
        return Model(0.0, np.zeros(size, np.float32), np.zeros((size, machine.rank), np.float32), np.zeros(width), np.ones(width))
    shift, scale = statistics.mean(0), np.maximum(statistics.std(0), 1e-3)
    rate = (label.sum() + 1) / (n + 2)
    bias = np.array([np.log(rate / (1 - rate))])
    linear, pair = np.zeros(size), draw.normal(0, 0.05, (size, machine.rank))
    z = Model(0, linear, pair, shift, scale).scaled(statistics).astype(np.float64)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, linear, pair)]
    step, epochs = 0, max(machine.epochs, -(-machine.steps * machine.batch // n))
    for epoch in range(epochs):
        order = draw.permutation(n)
        for first in range(0, n, machine.batch):
            at = order[first : first + machine.batch]
            counts = bounds[at + 1] - bounds[at]
            ends = np.cumsum(counts)
            cells = np.repeat(bounds[at] - (ends - counts), counts) + np.arange(ends[-1])
            b, x, own = bucket[cells], value[cells].astype(np.float64), np.repeat(np.arange(len(at)), counts)
            wx, square, summed = _rows(linear, pair, b, x, np.concatenate([[0], ends]))
            zs, vz = z[at], pair[machine.buckets :]
            summed += zs @ vz
            square += (zs * zs) @ (vz * vz)
            raw = bias[0] + wx + zs @ linear[machine.buckets :] + 0.5 * (summed * summed - square).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[at]) / len(at)
            to_linear, to_pair = machine.decay * linear, machine.decay * pair
            ex = error[own] * x
            np.add.at(to_linear, b, ex)
            # d/dv of a pair: x (sum of v x) - v x^2
            move = ex[:, None] * summed[own] - (ex * x)[:, None] * pair[b]
            sort = np.argsort(b, kind="stable")
            if len(b):
                cut = np.flatnonzero(np.concatenate([[True], np.diff(b[sort]) > 0]))
                to_pair[b[sort][cut]] += np.add.reduceat(move[sort], cut, 0)
            to_linear[machine.buckets :] += error @ zs
            to_pair[machine.buckets :] += (error[:, None] * zs).T @ summed - (error @ (zs * zs))[:, None] * vz
            step += 1
            pace = machine.rate * (1 - epoch / epochs)
            for value_, slope, (m, s) in zip((bias, linear, pair), (np.array([error.sum()]), to_linear, to_pair), moments, strict=True):
                m *= 0.9
                m += 0.1 * slope
                s *= 0.999
                s += 0.001 * slope * slope
                value_ -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(float(bias[0]), linear.astype(np.float32), pair.astype(np.float32), shift, scale)


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; of a null id 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def sampled(docs: DataFrame, labels: DataFrame, machine: Machine, doc_id: str, text: str, n_chars: str | None, label: str) -> DataFrame:
    """(cells, values, statistics, label) of ``machine.sample`` labelled rows at most, those whose ids and texts hash lowest, so that any
    division of the rows into tasks picks the same ones."""
    known = labels.where(F.col(label).isNotNull() & (remainder(F.col(doc_id)) != 0)).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_label"))
    order = lambda *c: F.xxhash64(F.lit(machine.seed), *c)
    picked = known.orderBy(order("_id"), "_id").limit(machine.sample)
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), _size(text, n_chars))
    rows = slim.join(F.broadcast(picked), "_id").select("_id", "_text", "_size", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, (bucket, value, bounds, statistics) in _featured(batches, machine.buckets):
            packed = lambda x: [x[bounds[k] : bounds[k + 1]].tobytes() for k in range(b - a)]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").slice(a, b - a), pa.array(packed(bucket.astype(np.uint16)), pa.binary()), pa.array(packed(value), pa.binary()), pa.array([s.tobytes() for s in statistics], pa.binary()), batch.column("_label").slice(a, b - a)],
                ["id", "cells", "values", "statistics", "label"],
            )

    kind = slim.schema["_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, cells binary, values binary, statistics binary, label double")
    # an id may have many rows, so the bound holds once more behind the join
    return made.orderBy(order("id", "cells", "values"), "id", "cells", "values", "statistics").limit(machine.sample)


def _size(text: str, n_chars: str | None) -> Column:
    return (F.col(n_chars) if n_chars else F.char_length(text)).cast("long").alias("_size")


def fit(docs: DataFrame, labels: DataFrame, machine: Machine = Machine(), doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", label: str = "quality") -> Model:
    """The model of ``label`` (0 or 1; the mean of an id's labels where it has several), learnt from rows whose remainder is not 0."""
    got = sampled(docs, labels, machine, doc_id, text, n_chars, label).toArrow()
    read = lambda name, kind: [np.frombuffer(x, kind) for x in got.column(name).to_pylist()]
    cells, values, statistics = read("cells", np.uint16), read("values", np.float32), read("statistics", np.float32)
    joined = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
    return train(joined(cells, np.uint16).astype(np.int64), joined(values, np.float32), bounds, joined(statistics, np.float32).reshape(-1, len(STATISTICS)), np.array(got.column("label").to_pylist(), np.float64), machine)


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """(row, score): every row of ``docs``, its text aside, and the probability of label 1 for its whole text.

    Null texts count as empty and have the score of a text without words; a null ``n_chars`` counts as 0. Repeated rows get equal
    scores, an empty table gives an empty result, and other columns, whatever their names, travel inside ``row``. A long text
    stands alone in its batch, as arrays of some hundred bytes a word. Nothing is shuffled; the model (147 kB by default) goes to
    each executor once."""
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    slim = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"), _size(text, n_chars))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, a, b, found in _featured(batches, len(own.linear) - len(STATISTICS)):
            yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array(own.scores(*found), pa.float64())], ["row", "score"])

    return slim.mapInArrow(run, beside(slim.schema["_row"].dataType, "score double"))


#: From this score on a text is called good.
GOOD = 0.3


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("row.doc_id", (remainder(F.col("row.doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
