"""Suffix-array dedup: every byte covered by a ``length``-byte string that also starts earlier is removed.

Suffixes are sampled where a window's least k-gram hash stands (minimizers), so that equal strings of ``length``
bytes are sampled at the same place. Sampled suffixes meet by the hash of that k-gram:

1. Each task takes the minimizers of its texts, with a hash of the bytes around each (its context: all bytes that
   a string containing the k-gram can reach). Equal contexts within a task are settled at once, byte by byte: the later
   ones are covered, and one goes on, so a passage that a third of all documents share costs one row per task.
2. Suffixes are dealt by k-gram hash. Of equal contexts all but the first are asked about: the first's document is to
   give the digest of its bytes there, and the later one is covered only where its own bytes have that digest. Only
   k-grams with several distinct contexts, the edges of repeats, go on, with the bytes of one context each.
3. Those suffixes are sorted: comparisons find the common extension by binary search over prefix polynomial
   hashes, inside a mergesort, once to the right and once to the left of the k-gram. Every sorted neighbour is
   verified byte by byte; a collision starts the sort anew with other hashes. The two orders with their common
   extensions give, for every window around a k-gram, the class of equal strings, and all but its first are covered.
4. Covered stretches are merged per document and cut out.

A k-gram with very many distinct contexts (a line that stands in a third of all documents, each time between other
lines) would gather them in one task. Such k-grams are found beforehand on a share of the documents; each of their
strings then goes on alone, dealt by its own hash, and is asked about in the same way. What is removed does not depend
on which k-grams are treated so.

Hashes are drawn anew for each call, so no text can be made to collide. The texts are shuffled once (both joins read
the same exchange); what else moves are 30 bytes for about every 26 bytes of text.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, labels, partitions, table, utf8
from .textkit import byte_codes, mix, pieces, powers

LENGTH = 100
GRAM = 48
#: Bytes of text per step, and sampled suffixes that a task holds (with their texts) before it deals them out.
STEP, HELD = 1 << 18, 400_000
#: Bits of a place within a step; the rest of a word holds the hash that is compared.
PLACE = 24
NONE = -(1 << 63)


@dataclass(frozen=True)
class Crowd:
    """How crowded k-grams are found: one document of ``every`` is looked at, and a k-gram with ``least`` distinct
    contexts among them is one, so about every * least contexts are what a task may gather. At most ``most`` of them,
    those with most contexts, are sent to the tasks."""

    every: int = 4096
    least: int = 8
    most: int = 1 << 20


SUFFIX = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])
COVER = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
#: A string of a crowded k-gram, by two hashes.
WINDOW = np.dtype([("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])
#: A stretch that is covered if its bytes have this digest.
ASKED = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4"), ("digest", "u1", (32,))])


class Collision(Exception):
    pass


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, seeds: tuple[int, ...] = (0, 99)) -> tuple[np.ndarray, ...]:
    """(row, place, k-gram hash, context hash, bytes to the left, bytes to the right) of each sampled suffix."""
    n, width = len(data), length - gram + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes(seeds[0])[data] * up[:n], out=sums[1:])
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # the place stands in the low bits, so that of equal hashes the leftmost is taken
    low = np.uint64(max(n.bit_length(), PLACE))
    least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    inside = np.zeros(n + 2, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    at = (least[np.cumsum(inside)[: len(least)] > 0] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    row = np.searchsorted(offsets, at, "right") - 1
    start, end = np.maximum(offsets[row], at - (length - gram)), np.minimum(offsets[row + 1], at + length)
    np.cumsum(byte_codes(seeds[1])[data] * up[:n], out=sums[1:])
    shape = ((end - start) * 512 + (at - start)).astype(np.uint64)
    context = mix((sums[end] - sums[start]) * down[start] + shape)
    return row, at - offsets[row], hashes[at], context, at - start, end - at


def _segments(docs: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, first byte within the doc, bytes, offsets) of about STEP bytes. A longer text is cut into stretches
    that overlap by less than a string, so that each string lies in exactly one."""
    for a, b in pieces(offsets, STEP):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= STEP:
            yield docs[a:b], np.zeros(b - a, np.int64), data[lo:hi], offsets[a : b + 1] - lo
            continue
        for s in range(0, hi - lo - length + 1, STEP - length + 1):
            e = min(s + STEP, hi - lo)
            yield docs[a:b], np.array([s], np.int64), data[lo + s : lo + e], np.array([0, e - s], np.int64)


def _merged(covers: np.ndarray) -> np.ndarray:
    """The same bytes as fewer stretches."""
    if not len(covers):
        return covers
    covers = covers[np.lexsort((covers["start"], covers["doc"]))]
    # running ends within a document: shift each document beyond the one before
    document = np.cumsum(np.concatenate([[0], covers["doc"][1:] != covers["doc"][:-1]])).astype(np.int64)
    reach = np.maximum.accumulate(covers["end"].astype(np.int64) + (document << 33))
    fresh = np.concatenate([[True], (covers["start"][1:].astype(np.int64) + (document[1:] << 33)) > reach[:-1]])
    out = covers[fresh].copy()
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(covers) - 1]])
    out["end"] = (reach[last] - (document[last] << 33)).astype(np.uint32)
    return out


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sampled suffixes, as places in ``rows``: the first of each context, in the order of (gram, context); whether
    its k-gram has other contexts too; every later one; and the first of each later one's context. A suffix that was
    sampled twice at one place (in two stretches of a text) is neither."""
    order = np.lexsort((rows["at"], rows["doc"], rows["context"], rows["gram"]))
    if not len(order):
        return order, np.empty(0, bool), order, order
    grams, contexts = rows["gram"][order], rows["context"][order]
    gram = np.ones(len(order), bool)
    gram[1:] = grams[1:] != grams[:-1]
    fresh = gram.copy()
    fresh[1:] |= contexts[1:] != contexts[:-1]
    place = np.flatnonzero(fresh)
    firsts = order[place]
    head = firsts[np.cumsum(fresh) - 1]
    later = ~fresh & ((rows["doc"][order] != rows["doc"][head]) | (rows["at"][order] != rows["at"][head]))
    group = np.cumsum(gram[place]) - 1
    several = np.bincount(group)[group] > 1
    later, head = order[later], head[later]
    if (rows["left"][later] != rows["left"][head]).any() or (rows["right"][later] != rows["right"][head]).any():
        raise Collision("two contexts share both hashes")
    return firsts, several, later, head


def _covers(rows: np.ndarray) -> np.ndarray:
    """All that the contexts of these suffixes reach."""
    out = np.empty(len(rows), COVER)
    out["doc"], out["start"], out["end"] = rows["doc"], rows["at"] - rows["left"], rows["at"] + rows["right"]
    return out


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
    """Verify, byte by byte, that the stretches of ``text`` from a and from b are equal; ``size`` is that of each."""
    if not len(a):
        return
    width = int(size.max())
    columns = np.arange(width)
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    for k in range(0, len(a), 1 << 12):
        part = slice(k, k + (1 << 12))
        if not ((view[a[part]] == view[b[part]]) | (columns >= size[part, None])).all():
            raise Collision("two different contexts share both hashes")


def windows(text: np.ndarray, spot: np.ndarray, rows: np.ndarray, length: int, gram: int, seeds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Every string around the k-grams of ``rows``, which stand at ``spot`` in ``text``: as WINDOW, and its place there."""
    reach = length - gram
    up, down = powers(2 * length)
    padded = np.concatenate([np.zeros(reach, np.uint8), text, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length + reach)
    found, places = [np.empty(0, WINDOW)], [np.empty(0, np.int64)]
    before = np.arange(reach + 1)
    for k in range(0, len(rows), 1 << 11):
        part, at = rows[k : k + (1 << 11)], spot[k : k + (1 << 11)]
        around = view[at]  # from ``reach`` bytes before the k-gram on
        hashes = []
        for seed in seeds[2:4]:
            sums = np.zeros((len(part), length + reach + 1), np.uint64)
            np.cumsum(byte_codes(seed)[around] * up[: length + reach], axis=1, out=sums[:, 1:])
            begin = reach - before
            hashes.append(mix((sums[:, begin + length] - sums[:, begin]) * down[begin]))
        i, o = np.nonzero((part["left"][:, None] >= before) & (part["right"][:, None].astype(np.int64) >= length - before))
        out = np.empty(len(i), WINDOW)
        out["gram"], out["context"], out["doc"] = hashes[0][i, o], hashes[1][i, o], part["doc"][i]
        out["at"], out["left"], out["right"] = part["at"][i] - o, 0, length
        found.append(out)
        places.append(at[i] - o)
    return np.concatenate(found), np.concatenate(places)


def _blobs(key: np.ndarray, buckets: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row per bucket (a label, by the key), holding its rows field by field."""
    bucket = buckets[(key % np.uint64(len(buckets))).astype(np.int64)]
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    blobs = [b"".join(np.ascontiguousarray(rows[f][s:e]).tobytes() for f in rows.dtype.names) for s, e in zip(cuts, ends, strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts], pa.int32()), pa.array(np.full(len(cuts), kind), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "rows"]
    )


def _rows(blob: pa.Scalar, kind: np.dtype) -> np.ndarray:
    data = blob.as_buffer()
    n, at = data.size // kind.itemsize, 0
    out = np.empty(n, kind)
    for f in kind.names:
        t = kind.fields[f][0]
        size = n * t.itemsize
        out[f] = np.frombuffer(data, t.base, n * int(np.prod(t.shape, dtype=np.int64)), at).reshape(n, *t.shape)
        at += size
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[dict[int, np.ndarray]]:
    """The rows of each bucket, by kind; buckets come one after the other."""
    held: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    now = None
    for batch in batches:
        for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
            if bucket != now and now is not None:
                yield {k: np.concatenate([np.empty(0, kinds[k]), *x]) for k, x in held.items()}
                held = {k: [] for k in kinds}
            now = bucket
            held[kind].append(_rows(blob, kinds[kind]))
    if now is not None:
        yield {k: np.concatenate([np.empty(0, kinds[k]), *x]) for k, x in held.items()}


DEALT = "bucket int, kind int, rows binary"
#: A covered stretch of ``doc``; or (gram, at) a context whose bytes are wanted; or (for_doc, for_start) a stretch whose
#: digest is wanted there.
FOUND = "doc long, gram long, at long, start long, end long, for_doc long, for_start long"
NAMES = ["doc", "gram", "at", "start", "end", "for_doc", "for_start"]


def _sampler(length: int, gram: int, buckets: np.ndarray, seeds: tuple[int, ...], crowded: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        spots: list[np.ndarray] = []
        size = 0

        def deal() -> Iterator[pa.RecordBatch]:
            rows, text, spot = np.concatenate(held), np.concatenate(texts), np.concatenate(spots)
            for x in (held, texts, spots):
                x.clear()
            firsts, _, later, head = settle(rows)
            start = spot - rows["left"]
            _same(text, start[later], start[head], rows["left"][later].astype(np.int64) + rows["right"][later])
            covers = [_covers(rows[later])]
            if len(crowded):
                place = np.minimum(np.searchsorted(crowded, rows["gram"][firsts]), len(crowded) - 1)
                dense = crowded[place] == rows["gram"][firsts]
                firsts, dense = firsts[~dense], firsts[dense]
                single, at = windows(text, spot[dense], rows[dense], length, gram, seeds)
                one, _, later, head = settle(single)
                _same(text, at[later], at[head], np.full(len(later), length))
                covers.append(_covers(single[later]))
                yield _blobs(single["gram"][one], buckets, single[one], 2)
            yield _blobs(rows["gram"][firsts], buckets, rows[firsts], 0)
            merged = _merged(np.concatenate(covers))
            yield _blobs(mix(merged["doc"].astype(np.uint64)), buckets, merged, 1)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            docs = batch.column("doc").to_numpy()
            for doc, base, part, at in _segments(docs, data, offsets, length):
                row, place, grams, contexts, left, right = minimizers(part, at, length, gram, seeds)
                rows = np.empty(len(row), SUFFIX)
                rows["gram"], rows["context"], rows["doc"] = grams, contexts, doc[row]
                rows["at"], rows["left"], rows["right"] = place + base[row], left, right
                held.append(rows)
                spots.append(at[row] + place + size)
                texts.append(part.copy())
                size += len(part)
                if sum(map(len, held)) >= HELD:
                    yield from deal()
                    size = 0
        if held:
            yield from deal()

    return run


def _crowds(length: int, gram: int, seeds: tuple[int, ...]):
    """The distinct contexts of each k-gram that has several in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, SUFFIX)]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            docs = batch.column("doc").to_numpy()
            for doc, _, part, at in _segments(docs, data, offsets, length):
                row, _, grams, contexts, _, _ = minimizers(part, at, length, gram, seeds)
                rows = np.zeros(len(row), SUFFIX)
                rows["gram"], rows["context"], rows["doc"] = grams, contexts, doc[row]
                held.append(rows)
        firsts = np.concatenate(held)
        firsts = firsts[settle(firsts)[0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(firsts[c]).view(np.int64)) for c in ("gram", "context")], ["gram", "context"])

    return run


def crowded_grams(texts: DataFrame, length: int, gram: int, seeds: tuple[int, ...], crowd: Crowd) -> np.ndarray:
    """Hashes of crowded k-grams, in order."""
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(crowd.every)) == 0) if crowd.every > 1 else texts
    found = some.mapInArrow(_crowds(length, gram, seeds), "gram long, context long").groupBy("gram").agg(F.countDistinct("context").alias("n"))
    most = found.where(F.col("n") >= crowd.least).orderBy(F.col("n").desc(), "gram").limit(crowd.most).toArrow()
    return np.sort(most.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[c]).astype(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in NAMES], NAMES)


def _settler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket in _by_bucket(batches, {0: SUFFIX, 1: COVER, 2: WINDOW}):
        yield _batch(doc=bucket[1]["doc"], start=bucket[1]["start"], end=bucket[1]["end"])
        for kind in (0, 2):
            rows = bucket[kind]
            firsts, several, later, head = settle(rows)
            there, here = _covers(rows[head]), _covers(rows[later])
            yield _batch(doc=there["doc"], start=there["start"], end=there["end"], for_doc=here["doc"], for_start=here["start"])
            if kind == 0:
                wanted = rows[firsts[several]]
                place = _covers(wanted)
                yield _batch(doc=wanted["doc"], gram=wanted["gram"].view(np.int64), at=wanted["at"], start=place["start"], end=place["end"])


def context_type(length: int, gram: int) -> np.dtype:
    """A suffix with the bytes around it; the k-gram starts at byte ``length - gram``."""
    return np.dtype([("gram", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (2 * length - gram,))])


def _structs(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct of a list column, and its fields."""
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    flat = column.flatten()
    lists = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    return np.repeat(np.arange(len(lists)), lists), [flat.field(i) for i in range(flat.type.num_fields)]


def _numbers(fields: list[pa.Array]) -> list[np.ndarray]:
    return [f.to_numpy(zero_copy_only=False) for f in fields]


def _digests(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Digests of the stretches that are asked about, those of one diagonal merged where they overlap."""
    shift = there - start
    order = np.lexsort((start, shift, doc, of))
    of, start, end, doc, shift = of[order], start[order], end[order], doc[order], shift[order]
    if not len(of):
        return np.empty(0, ASKED)
    line = np.cumsum(np.concatenate([[0], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1])]))
    reach = np.maximum.accumulate(end + (line << 33))
    fresh = np.concatenate([[True], start[1:] + (line[1:] << 33) > reach[:-1]])
    a = np.flatnonzero(fresh)
    b = np.concatenate([a[1:], [len(of)]]) - 1
    out = np.empty(len(a), ASKED)
    stop = reach[b] - (line[b] << 33)
    out["doc"], out["start"], out["end"] = doc[a], start[a] + shift[a], stop + shift[a]
    known: dict[tuple[int, int], bytes] = {}
    made = []
    for lo, hi in zip((offsets[of[a]] + start[a]).tolist(), (offsets[of[a]] + stop).tolist(), strict=True):
        if (lo, hi) not in known:
            known[lo, hi] = hashlib.sha256(data[lo:hi]).digest()
        made.append(known[lo, hi])
    out["digest"] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 32)
    return out


def _fetcher(length: int, gram: int, buckets: np.ndarray):
    """The bytes around the suffixes that were wanted, dealt by k-gram, the digests that were asked for, and the covers
    that are known already."""
    kind = context_type(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.arange(2 * length - gram)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            docs = batch.column("doc").to_numpy()
            of, fields = _structs(batch.column("asked"))
            asked = _digests(data, offsets, of, *_numbers(fields))
            yield _blobs(mix(asked["doc"].astype(np.uint64)), buckets, asked, 1)
            of, fields = _structs(batch.column("own"))
            own = np.empty(len(of), COVER)
            own["doc"], (own["start"], own["end"]) = docs[of], _numbers(fields)
            yield _blobs(mix(own["doc"].astype(np.uint64)), buckets, own, 2)
            of, fields = _structs(batch.column("wanted"))
            g, at, start, end = _numbers(fields)
            for s in range(0, len(g), 1 << 14):
                part = slice(s, s + (1 << 14))
                rows = np.empty(len(g[part]), kind)
                rows["gram"], rows["doc"], rows["at"] = g[part].view(np.uint64), docs[of[part]], at[part]
                rows["left"], rows["right"] = at[part] - start[part], end[part] - at[part]
                from_ = offsets[of[part]] + at[part] - (length - gram)
                place = from_[:, None] + columns
                inside = (columns >= (length - gram) - rows["left"][:, None].astype(np.int64)) & (columns < (length - gram) + rows["right"][:, None].astype(np.int64))
                place[~inside] = 0
                rows["bytes"] = np.where(inside, data[place], 0)
                yield _blobs(rows["gram"], buckets, rows, 0)

    return run


def suffix_sort(text: np.ndarray, size: np.ndarray, group: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``text`` (their first ``size`` bytes) within each group, and the common extension of
    each with the one before it (0 for the first of a group). ``group`` must not decrease.

    Mergesort of all groups at once: each element's rank in the run beside its own is found by binary search. A
    comparison finds the common extension by binary search over prefix polynomial hashes, then looks at one byte.
    Neighbours are verified byte by byte."""
    n, width = text.shape
    size = size.astype(np.int64)
    up, _ = powers(width)
    prefix = np.zeros((n, width + 1), np.uint64)
    np.cumsum(byte_codes(1000 + seed)[text] * up[:width], axis=1, out=prefix[:, 1:])
    steps = int(width).bit_length()

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(i), np.int64), np.minimum(size[i], size[j])
        for _ in range(steps):
            mid = (lo + hi + 1) >> 1
            same = prefix[i, mid] == prefix[j, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def below(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether i comes before j; equal ones don't."""
        e = extension(i, j)
        inner = (e < size[i]) & (e < size[j])
        k = np.minimum(e, width - 1)
        return np.where(inner, text[i, k] < text[j, k], size[i] < size[j])

    first = np.searchsorted(group, group, "left")
    count = np.searchsorted(group, group, "right") - first
    order = np.arange(n)
    run = 1
    most = int(count.max(initial=0))
    while run < most:
        # slots of groups that are longer than a run; a slot's element moves within its pair of runs
        slot = np.flatnonzero(count > run)
        place = slot - first[slot]
        mine = place // run
        beside = mine ^ 1
        lo = np.minimum(beside * run, count[slot])
        hi = np.minimum(lo + run, count[slot])
        start, element, is_left = lo.copy(), order[slot], (mine & 1) == 0
        for _ in range(run.bit_length()):
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            other = order[first[slot] + np.minimum(mid, count[slot] - 1)]
            # an element of the left run goes before equal ones of the right
            before = np.where(is_left, below(other, element), ~below(element, other))
            lo = np.where(open_ & before, mid + 1, lo)
            hi = np.where(open_ & ~before, mid, hi)
        target = first[slot] + (mine & ~1) * run + (place - mine * run) + (lo - start)
        order = order.copy()
        order[target] = element
        run *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        together = group[a] == group[b]
        e = extension(a, b)
        common[1:] = np.where(together, e, 0)
        columns = np.arange(width)
        for s in range(0, n - 1, 1 << 14):
            x, y, c = a[s : s + (1 << 14)], b[s : s + (1 << 14)], e[s : s + (1 << 14)]
            equal = ((text[x] == text[y]) | (columns >= c[:, None])).all(axis=1)
            inner = (c < size[x]) & (c < size[y])
            k = np.minimum(c, width - 1)
            sorted_ = np.where(inner, text[x, k] < text[y, k], size[x] <= size[y])
            if not (equal & sorted_ | ~together[s : s + (1 << 14)]).all():
                raise Collision
    return order, common


def _sorted(text: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for seed in range(16):
        try:
            return suffix_sort(text, size, group, seed)
        except Collision:
            continue
    raise RuntimeError("prefix hashes collide with every seed")


def window_covers(rows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Stretches covered by strings of ``length`` bytes around the rows' k-grams that also start earlier among
    them. Any two strings around one k-gram overlap, so a row's strings make one stretch."""
    reach = length - gram
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["gram"]))]
    n = len(rows)
    group = np.cumsum(np.concatenate([[0], rows["gram"][1:] != rows["gram"][:-1]])) if n else np.empty(0, np.int64)
    right, r_common = _sorted(np.ascontiguousarray(rows["bytes"][:, reach:]), rows["right"], group)
    left, l_common = _sorted(np.ascontiguousarray(rows["bytes"][:, :reach][:, ::-1]), rows["left"], group)
    opens = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.empty(0, bool)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    lefts, rights = rows["left"].astype(np.int64), rows["right"].astype(np.int64)
    for o in range(reach + 1):
        # strings that start o bytes before the k-gram: equal to the left for o bytes, to the right for the rest
        r_class[right] = np.cumsum((r_common < length - o) | opens)
        l_class[left] = np.cumsum((l_common < o) | opens)
        whole = np.flatnonzero((lefts >= o) & (rights >= length - o))
        key = r_class[whole] * (n + 1) + l_class[whole]
        order = np.argsort(key, kind="stable")
        key, element = key[order], whole[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        head = element[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(key) else element
        later = element[(rows["doc"][element] != rows["doc"][head]) | (rows["at"][element] != rows["at"][head])]
        most[later] = o
        least[later] = np.where(least[later] < 0, o, least[later])
    hit = least >= 0
    out = np.zeros(int(hit.sum()), COVER)
    out["doc"] = rows["doc"][hit]
    out["start"] = rows["at"][hit] - most[hit]
    out["end"] = rows["at"][hit] - least[hit] + length
    return out


COVERED = "doc long, start long, end long, digest binary"


def _covered(rows: np.ndarray) -> pa.RecordBatch:
    digests = pa.array([x.tobytes() for x in rows["digest"]], pa.binary()) if "digest" in rows.dtype.names else pa.nulls(len(rows), pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[c]).astype(np.int64)) for c in ("doc", "start", "end")), digests], ["doc", "start", "end", "digest"])


def _sorter(length: int, gram: int):
    kind = context_type(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches, {0: kind, 1: ASKED, 2: COVER}):
            yield _covered(bucket[1])
            yield _covered(bucket[2])
            rows = bucket[0][np.argsort(bucket[0]["gram"], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])) if len(rows) else np.empty(0, np.int64)
            ends = np.append(cuts[1:], len(rows))
            a = 0
            while a < len(cuts):
                # whole groups, about 16384 rows at once
                b = max(a + 1, int(np.searchsorted(ends, cuts[a] + (1 << 14), "right")))
                yield _covered(window_covers(rows[cuts[a] : ends[b - 1]], length, gram))
                a = b

    return run


def _joined(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches (row, start, end) of covered ones; those that touch are one."""
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    if not len(of):
        return of, start, end
    reach = np.maximum.accumulate(end + (of << 33))
    fresh = np.concatenate([[True], start[1:] + (of[1:] << 33) > reach[:-1]])
    a = np.flatnonzero(fresh)
    b = np.concatenate([a[1:], [len(of)]]) - 1
    return of[a], start[a], reach[b] - (of[a] << 33)


def _cutter(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            of, fields = _structs(batch.column("covered"))
            start, end = _numbers(fields[:2])
            for row, lo, hi, digest in zip(of.tolist(), start.tolist(), end.tolist(), fields[2].to_pylist(), strict=True):
                if digest is not None and hashlib.sha256(data[offsets[row] + lo : offsets[row] + hi]).digest() != digest:
                    raise Collision("two different contexts share both hashes; a new call draws others")
            of, start, end = _joined(of, start, end)
            bounds = np.searchsorted(of, np.arange(len(offsets)))
            n = np.diff(offsets)
            removed = np.bincount(of, weights=end - start, minlength=len(n)).astype(np.int64) if len(of) else np.zeros(len(n), np.int64)
            begins, stops, hashes, kept = start.tolist(), end.tolist(), [], []
            for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                cut = range(bounds[row], bounds[row + 1])
                edges = [lo, *(lo + x for k in cut for x in (begins[k], stops[k])), hi]
                left = [data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
                digest = hashlib.sha256()
                for x in left:
                    digest.update(x)
                hashes.append(digest.hexdigest())
                if whole:
                    kept.append(b"".join(x.tobytes() for x in left))
            counts = np.diff(bounds)
            arrays = [batch.column("doc"), pa.array(n.astype(np.int64)), pa.array(removed), pa.array(counts.astype(np.int64)), pa.array(hashes, pa.string())]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if whole:
                spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["start", "end"])
                arrays += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans), pa.array(kept, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, whole: bool = True, crowd: Crowd = Crowd()
) -> DataFrame:
    """One row per row of ``docs``: its doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``whole``, the
    removed ``spans`` and the ``kept`` bytes (which may cut a character).

    A null text is empty; texts shorter than ``length`` lose nothing and still get their digest. A null doc_id sorts
    before all others. Rows with equal doc_id and text are one document: neither is earlier than the other. Rows
    with equal doc_id and different texts are different documents, ordered by a hash of the text. Extra columns
    are ignored; an empty table gives an empty result. A text of any length is sampled in overlapping stretches."""
    if not 0 < length - gram < 128 or length > 255:
        raise ValueError("strings of 2 to 255 bytes, with a k-gram that is shorter by less than 128")
    spark = docs.sparkSession
    n_parts = partitions(docs)
    buckets = labels(n_parts, 4)
    slim = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = None
    twice = slim.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty() or not slim.where((F.col("doc") == NONE) & F.col("id").isNotNull()).isEmpty():
        # number the distinct (doc, text hash) in their order; only tables with repeated ids pay for this. Numbers over
        # sorted partitions rise with the order, and are written before they are used
        tagged = slim.withColumn("tag", F.xxhash64("text"))
        order = durable(tagged.select("doc", "tag").distinct().orderBy("doc", "tag").withColumn("number", F.monotonically_increasing_id()), "order")
        named = durable(tagged.join(order, ["doc", "tag"]).select("id", F.col("number").alias("doc"), "text"), "numbered")
        slim = named.select("doc", "text").distinct()
    texts = slim.select("doc", "text")
    seeds = tuple(secrets.randbits(63) for _ in range(4))
    crowded = crowded_grams(texts, length, gram, seeds, crowd)
    dealt = texts.mapInArrow(_sampler(length, gram, buckets, seeds, crowded), DEALT).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_settler, FOUND)
    lists = {
        "wanted": F.when(F.col("gram").isNotNull(), F.struct("gram", "at", "start", "end")), "asked": F.when(F.col("for_doc").isNotNull(), F.struct("start", "end", "for_doc", "for_start")),
        "own": F.when(F.col("gram").isNull() & F.col("for_doc").isNull(), F.struct("start", "end")),
    }
    wanted = found.groupBy("doc").agg(*[F.collect_list(x).alias(n) for n, x in lists.items()])
    # the lists are far smaller than the texts: hashing them spares the texts a sort
    edges = texts.join(wanted.hint("shuffle_hash"), "doc").select("doc", "text", *lists).mapInArrow(_fetcher(length, gram, buckets), DEALT)
    sorted_ = edges.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sorter(length, gram), COVERED)
    covers = sorted_.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "digest")).alias("covered"))
    out = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:bigint,end:bigint>>, kept binary" * whole
    cut = texts.join(covers.hint("shuffle_hash"), "doc", "left").select("doc", "text", "covered").mapInArrow(_cutter(whole), out)
    if named is not None:
        return named.select("id", "doc").join(cut, "doc").drop("doc").withColumnRenamed("id", doc_id)
    return cut.select(F.when(F.col("doc") != NONE, F.col("doc")).alias(doc_id), *cut.columns[1:])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=False)


#: Every string by its hash, in the order of documents and places; islands of covered strings are cut out.
ORACLE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS p FROM b),
k AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM p),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM k),
c AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS opens FROM f WHERE r > 1),
i AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM c),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z FROM g GROUP BY doc_id),
x AS (SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM g JOIN b USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * z + 1), h))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""
