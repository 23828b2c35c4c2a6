"""MinHash near-dedup by a signature-coordinate inverted join, with links confirmed on full shingle sets.

A document is posted under the (coordinate, value) pairs of the first m coordinates of its signature. Two
documents that share at least t of them must meet under one of their m - t + 1 rarest pairs (pigeonhole in an order
that all documents share), so only that prefix is posted. Where a list's documents meet, in blocks, collisions over all coordinates
are counted by skip merging: the block's postings are merged but for each document's longest lists, in which only those
that can still reach the threshold are looked up. Pairs at or above it are confirmed on their whole sets.

Documents with equal sets are one class, found by a digest of the set, so copies are never paired. Groups of near
copies are not paired out either: a list is first swept by leaders, each a document that follows no leader before
it, and a document follows all leaders that it matches. The followers of a leader meet with their whole sets, and
only those that the leader's own links leave out look for links, by counting shared shingles; what leaves a task is
a forest of links. Links are closed into components, and last, pairs across components that share a list but no
leader are tried, the best ones first, until none that meets the threshold is left. So no link between components
is lost but by the signatures: m = 40, t = 17 and 78 of all 128 coordinates (by four bits each)
miss a pair of similarity 0.8 with a probability of 1e-7, and a more similar one less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, drop, durable, few, partitions, table, utf8
from .textkit import LOWER, NOT_SPACE, PIECE, mix, pieces, run_hashes, words


@dataclass(frozen=True)
class Params:
    """``shingle`` words a shingle; linked where 100 * intersection >= ``percent`` * union. ``posted`` coordinates
    have lists, of which ``meets`` must be shared; of all ``coordinates``, ``matches``. ``chunk`` rows of a list, or ``set_chunk`` whole sets, meet in a task at most,
    and longer lists are dealt block by block. Ids that pick texts, with what goes to them, are sent to the executors where
    they take up to ``broadcast`` bytes; more are joined by a shuffle."""

    shingle: int = 5
    percent: int = 80
    posted: int = 40
    meets: int = 17
    coordinates: int = 128
    matches: int = 78
    chunk: int = 4096
    set_chunk: int = 1024
    first_tries: int = 32
    broadcast: int = 32 << 20

    @property
    def width(self) -> int:
        """Bytes of a sketch: four bits of each coordinate."""
        return self.coordinates // 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each row's shingles, sorted within the row, and the n + 1 bounds of the rows."""
    starts, ends, n = words(data, offsets, NOT_SPACE)
    h = run_hashes(LOWER[data], starts, ends)
    bounds = np.concatenate([[0], np.cumsum(n)])
    joined = np.zeros(len(h), np.uint64)
    for i, factor in enumerate(_multipliers(k)):
        joined[: max(len(h) - i, 0)] += h[i:] * factor
    joined = mix(joined)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    size = np.repeat(n, n)
    keep = place + k <= size
    few = np.flatnonzero((n > 0) & (n < k))
    for r in few:
        # fewer words than a shingle has: the whole sequence is one
        s, e = bounds[r], bounds[r + 1]
        x = np.uint64(e - s)
        for w in h[s:e]:
            x = mix(np.array([x], np.uint64) * _multipliers(1) + w)[0]
        joined[s] = x
        keep[s] = True
    row = np.repeat(np.arange(len(n)), n)[keep]
    joined = joined[keep]
    order = np.lexsort((joined, row))
    joined, row = joined[order], row[order]
    fresh = np.ones(len(joined), bool)
    fresh[1:] = (joined[1:] != joined[:-1]) | (row[1:] != row[:-1])
    joined, row = joined[fresh], row[fresh]
    return joined, np.searchsorted(row, np.arange(len(n) + 1))


def _multipliers(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(sets: np.ndarray, bounds: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Each row's minima of the posted coordinates as uint32, a sketch with four bits of each coordinate (0 for rows
    without a shingle), and two digests of its set."""
    n = np.diff(bounds)
    full = n > 0
    at = bounds[:-1][full]
    posted, nibbles = np.zeros((len(n), p.posted), "<u4"), np.zeros((len(n), p.coordinates), np.uint8)
    digests = np.zeros((2, len(n)), np.uint64)
    if len(at):
        factors = _multipliers(p.coordinates + 2)
        for j, a in enumerate(factors[: p.coordinates]):
            least = np.minimum.reduceat(((sets * a) >> np.uint64(32)).astype(np.uint32), at)
            if j < p.posted:
                posted[full, j] = least
            nibbles[full, j] = mix(least.astype(np.uint64)) >> np.uint64(60)
        for j, salt in enumerate(factors[p.coordinates :]):
            digests[j, full] = np.add.reduceat(mix(sets + salt), at)
    return posted, nibbles[:, 0::2] | nibbles[:, 1::2] << 4, digests[0], digests[1]


def _pieces(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    for a, b in pieces(offsets, PIECE):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


SKETCHES = "id long, n long, d1 long, d2 long, sig binary, sketch binary"


def _sketcher(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, bounds in _pieces(batch, p.shingle):
                posted, sketch, d1, d2 = signatures(sets, bounds, p)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _binary(posted), _binary(sketch)],
                    ["id", "n", "d1", "d2", "sig", "sketch"],
                )

    return run


def _set_maker(p: Params):
    """The whole sets of texts, with the column ``to`` as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, bounds in _pieces(batch, p.shingle):
                blobs = [sets[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("to").slice(a, b - a), pa.array(blobs, pa.binary())], ["id", "to", "shingles"])

    return run


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix of bytes."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8, len(column) * width, int(at[0])).reshape(-1, width)


def _matches(sketches: np.ndarray, one: int, rest: np.ndarray) -> np.ndarray:
    """Coordinates in which the sketches of ``rest`` equal that of ``one``."""
    differs = sketches[rest] ^ sketches[one]
    return ((differs & 15) == 0).sum(axis=1) + ((differs >> 4) == 0).sum(axis=1)


class _Merge:
    """Collisions of a block's rows, counted by skip merging of posting lists.

    Each byte of a sketch, two coordinates, has a list of rows for each of its values. Rows that agree in ``matches`` coordinates
    agree in at least ``whole`` = matches - bytes whole bytes, so they meet in a row's lists even if its whole - 1 longest are
    left out. The others, its prefix, are merged; the longest ones are skipped: the rows that were met are looked up
    there, shortest lists first, and a row that can't reach ``whole`` any more goes. What remains is counted by coordinates.
    Where merging would take longer than comparing all rows, as in a small block or among near copies, all are
    counted by coordinates at once; what is found is the same."""

    #: Rows of a block, and times that a prefix lists each of them, beyond which one way is cheaper than the other.
    SMALL, LISTED = 768, 6

    def __init__(self, sketches: np.ndarray, matches: int):
        size, width = sketches.shape
        self.sketches, self.matches, self.whole = sketches, matches, matches - width
        self.every = np.arange(size)
        self.merges = self.whole > 0 and size > self.SMALL
        if self.merges:
            self.base = np.arange(width, dtype=np.int64) << 8
            self.rows = np.argsort(np.ascontiguousarray(sketches.T), axis=1, kind="stable").astype(np.int32).ravel()
            self.at = np.concatenate([[0], np.cumsum(np.bincount((sketches + self.base).ravel(), minlength=width << 8))])

    def met(self, one: int) -> np.ndarray:
        """Rows that may agree with row ``one`` in ``matches`` coordinates, itself included, ascending."""
        mine = self.sketches[one]
        lists = mine + self.base
        start, count = self.at[lists], self.at[lists + 1] - self.at[lists]
        order = np.argsort(count, kind="stable")
        prefix, skipped = order[: len(order) - self.whole + 1], order[len(order) - self.whole + 1 :]
        start, count = start[prefix], count[prefix]
        if count.sum() > self.LISTED * len(self.every):
            return self.every
        places = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        both = np.bincount(self.rows[places], minlength=len(self.sketches))
        rows = np.flatnonzero(both)
        both = both[rows]
        # a few lists at a time: the bound by which rows go is the tighter the fewer lists are left
        for at in range(0, len(skipped), 5):
            some = skipped[at : at + 5]
            both = both + (self.sketches[rows[:, None], some] == mine[some]).sum(axis=1)
            go = both + len(skipped[at + 5 :]) >= self.whole
            rows, both = rows[go], both[go]
        return rows[both >= self.whole]

    def of(self, one: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that agree with row ``one`` in ``matches`` coordinates, itself included, ascending, and in how many."""
        rows = self.met(one) if self.merges else self.every
        match = _matches(self.sketches, one, rows)
        return rows[match >= self.matches], match[match >= self.matches]


def _poster(p: Params):
    """(id, key) for each posted coordinate; a key is the coordinate and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(p.posted, dtype=np.int64) << 32
        for batch in batches:
            values = _fixed(batch.column("sig"), 4 * p.posted).view("<u4")
            ids = np.repeat(batch.column("id").to_numpy(), p.posted)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((values.astype(np.int64) | high).ravel())], ["id", "key"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], width: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each run of equal keys, across batches; ``sketch`` of ``width`` bytes comes as a matrix."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *columns)}
        if width:
            now["sketch"] = _fixed(batch.column("sketch"), width)
        if held is not None:
            now = {c: np.concatenate([held[c], x]) for c, x in now.items()}
        change = np.zeros(len(now[keys[0]]) - 1, bool)
        for c in keys:
            change |= now[c][1:] != now[c][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield {c: x[s:e] for c, x in now.items()}
        held = {c: x[cuts[-1] :].copy() for c, x in now.items()}
    if held is not None:
        yield held


def _close(n: np.ndarray, one: int, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as asked."""
    return (100 * np.minimum(n, one) >= percent * np.maximum(n, one))


PAIRS = "key long, a long, b long, more boolean"


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    key, a, b, more = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], ["key", "a", "b", "more"])


def _sweeper(p: Params):
    """Of each chunk of a list: (leader, document) pairs, and the leaders as pairs without b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches, ["key", "chunk"], ["id", "n"], p.width):
            key, size = int(g["key"][0]), len(g["id"])
            order = np.argsort(g["id"], kind="stable")
            ids, n = g["id"][order], g["n"][order]
            sketches = g["sketch"][order]
            # the first that follows none leads; all that match it follow it, others' followers included
            free, merge = np.ones(size, bool), _Merge(sketches, p.matches)
            for lead in range(size):
                if not free[lead]:
                    continue
                out.append((key, int(ids[lead]), None, False))
                near, _ = merge.of(lead)
                near = near[(near != lead) & _close(n[near], int(n[lead]), p.percent)]
                out += [(key, int(ids[lead]), x, False) for x in ids[near].tolist()]
                free[near] = False
            if len(out) >= 1 << 14:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _crosser(p: Params, tries: int):
    """Of each block of a list: pairs across components. Each document of side 0 gets, for each other component in
    the block, the ``tries`` documents that match it best; ``more`` says that others are left. Documents that share a
    leader have met already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches, ["key", "p", "q"], ["id", "n", "label", "side", "leaders"], p.width):
            key = int(g["key"][0])
            followed = [set(x) for x in g["leaders"]]
            merge = _Merge(g["sketch"], p.matches)
            for i in np.flatnonzero(g["side"] == 0).tolist():
                other, match = merge.of(i)
                good = (g["side"][other] == 1) & (g["label"][other] != g["label"][i]) & _close(g["n"][other], int(g["n"][i]), p.percent)
                other, match = other[good], match[good]
                if not len(other):
                    continue
                apart = np.array([followed[i].isdisjoint(followed[j]) for j in other.tolist()], bool)
                other, match = other[apart], match[apart]
                if not len(other):
                    continue
                order = np.lexsort((g["id"][other], -match, g["label"][other]))
                other = other[order]
                label = g["label"][other]
                rank = np.arange(len(other)) - np.searchsorted(label, label)
                cut = bool((rank >= tries).any())
                a = int(g["id"][i])
                for b in g["id"][other[rank < tries]].tolist():
                    out.append((key, min(a, b), max(a, b), cut))
            if len(out) >= 1 << 14:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


class _Postings:
    """Shared shingles of any set with all of a block's, by counting over the block's postings."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.percent = percent
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def linked(self, one: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, one, "left"), np.searchsorted(self.flat, one, "right")
        count = hi - lo
        which = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        both = np.bincount(self.owner[which], minlength=len(self.size))
        return np.flatnonzero(100 * both >= self.percent * (self.size + len(one) - both))


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forester(p: Params):
    """Of each block of a leader's followers, with whole sets: links that join all of the block that is linked. After
    the leader's own links only documents that they left out look for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key", "block"], ["id", "shingles"], 0):
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            if len(sets) < 2:
                continue
            postings, ids = _Postings(sets, p.percent), g["id"]
            root = np.arange(len(sets))
            found = []
            first = int(np.flatnonzero(ids == g["key"][0])[0])
            hers = postings.linked(sets[first])
            out = np.ones(len(sets), bool)
            out[hers] = out[first] = False
            for i in (first, *np.flatnonzero(out).tolist()):
                for j in (hers if i == first else postings.linked(sets[i])).tolist():
                    if root[i] != root[j]:
                        found.append((int(ids[i]), int(ids[j])))
                        root[root == root[j]] = root[i]
            if found:
                yield _links(found)

    return run


def _joiner(p: Params):
    """Of each block of a leader's followers, with whole sets: links of the documents of side 0 to other components,
    one to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key", "p", "q"], ["id", "label", "side", "shingles"], 0):
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            here, there = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
            if not len(here) or not len(there):
                continue
            postings = _Postings([sets[j] for j in there], p.percent)
            ids, labels = g["id"][there], g["label"][there]
            found = []
            for i in here.tolist():
                linked = postings.linked(sets[i])
                linked = linked[labels[linked] != g["label"][i]]
                for j in np.unique(labels[linked], return_index=True)[1]:
                    found.append((int(g["id"][i]), int(ids[linked[j]])))
            if found:
                yield _links(found)

    return run


def _confirmer(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= p.percent * (len(x) + len(y) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return run


def _shared(reps: DataFrame, p: Params) -> DataFrame:
    """(id, l): of each representative, the keys that others share, as (count, key), rarest first.

    Frequencies are counted by an aggregate that combines before its shuffle; keys that one document alone has
    are dropped by the join."""
    items = reps.select("id", "sig").mapInArrow(_poster(p), "id long, key long")
    shared = items.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    return items.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("l"))


def _postings(reps: DataFrame, p: Params) -> DataFrame:
    """(id, keys): of each representative, the shared keys of its prefix."""
    # those of a document's keys that are not in its list are its own and come first in the prefix
    room = F.lit(p.posted - p.meets + 1) - (F.lit(p.posted) - F.size("l"))
    return _shared(reps, p).where(room > 0).select("id", F.slice("l", F.lit(1), room).getField("key").alias("keys"))


def _refined(crowded: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """(id, label, key) of lists (id, label, key) that many unlike documents share, parted by a second coordinate. Two
    documents that share enough coordinates share, besides that of the list, one that is in the prefixes of both over
    all the others; so they still meet, and documents that share the list alone no longer do."""
    others = F.filter("l", lambda x: x["key"] != F.floor(F.col("key") / 256))
    room = F.size("l") - p.meets + 1
    found = crowded.join(_shared(reps, p), "id").where(room > 0).select("id", "label", "key", F.explode(F.slice(others, F.lit(1), room)).alias("other"))
    return found.select("id", "label", F.xxhash64("key", "other.key").alias("key")).distinct()


def _banded(posted: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """(id, key): prefix lists parted by size. Sets as similar as asked have sizes within a factor, so they lie in
    the same band of that factor or in neighbouring ones; a document is listed under its band and the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / p.percent)) + 1e-9).cast("long")
    each = posted.join(reps.select("id", "n"), "id").select("id", band.alias("band"), F.explode("keys").alias("key"))
    return each.select("id", F.explode(F.array(F.col("key") * 256 + F.col("band"), F.col("key") * 256 + F.col("band") + 1)).alias("key"))


def _sets(docs: DataFrame, to: DataFrame, p: Params) -> DataFrame:
    """(id, to, shingles) of the documents in ``to`` (id, to), a table in the shared folder: their texts are picked and
    made into whole sets. ``to`` is sent to the executors where its bytes, eight a number, are few enough; else it is
    joined by a shuffle."""
    width = 8 * len(to.schema["to"].dataType.elementType.fields)
    few = (to.agg(F.sum(F.lit(64) + F.size("to") * F.lit(width))).first()[0] or 0) <= p.broadcast
    return docs.join(F.broadcast(to) if few else to, "id").select("id", "to", "text").mapInArrow(_set_maker(p), f"id long, to {to.schema['to'].dataType.simpleString()}, shingles binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that are as similar as asked, on whole sets. A pair's key is its own hash, under which both
    sets meet."""
    ends = pairs.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("id"), F.struct("a", "b").alias("pair"))
    to = durable(few(ends.groupBy("id").agg(F.collect_list("pair").alias("to"))), "ends")
    sets = _sets(docs, to, p).select("id", F.explode("to").alias("pair"), "shingles").select("pair.a", "pair.b", "id", "shingles")
    x = sets.where("id = a").select("a", "b", F.col("shingles").alias("sa"))
    y = sets.where("id = b").select("a", "b", F.col("shingles").alias("sb"))
    return x.join(y, ["a", "b"]).mapInArrow(_confirmer(p), "a long, b long").distinct()


def _across(marked: DataFrame, chunk: int, *more: str) -> DataFrame:
    """(key, p, q, side, id, label, …): of lists (key, id, label, …) with several labels, the documents of other labels
    than the list's most frequent one (side 0), each with all of the list (side 1), in blocks of ``chunk`` rows."""
    by_label = marked.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda c: F.ceil(c / F.lit(chunk)).cast("long")
    grid = mixed.select("key", F.col("top.label").alias("main"), blocks(F.col("all") - F.col("top.c")).alias("np"), blocks(F.col("all")).alias("nq"))
    here = marked.join(grid, "key").withColumn("h", F.xxhash64("id"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    minor = here.where("label <> main").withColumns({"p": F.pmod("h", F.col("np")), "side": F.lit(0)}).withColumn("q", each("nq"))
    whole = here.withColumns({"q": F.pmod("h", F.col("nq")), "side": F.lit(1)}).withColumn("p", each("np"))
    cols = ["key", "p", "q", "side", "id", "label", *more]
    return minor.select(*cols).union(whole.select(*cols))


def links(docs: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """(a, b): confirmed links between representatives that join all that is linked. ``docs`` (id, text),
    ``reps`` (id, n, sig, sketch)."""
    n_parts = partitions(docs)
    slim = reps.select("id", "n", "sketch")
    posted = durable(_banded(_postings(reps, p), reps, p), "postings")
    # tables that nothing needs once the links are known
    spare = [posted]

    # what is found is small and comes from many tasks: rebalanced and coalesced, it is written as few files
    # sweep: chunks of long lists each find leaders, and leaders of one list meet again in fewer chunks
    swept, lists = None, posted
    while True:
        sizes = lists.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / F.lit(p.chunk)).cast("long"))
        dealt = lists.join(sizes, "key").withColumn("chunk", chunk).join(slim, "id").select("key", "chunk", "id", "n", "sketch")
        held = dealt.repartition(n_parts, "key", "chunk").sortWithinPartitions("key", "chunk", "id")
        found = durable(few(held.mapInArrow(_sweeper(p), PAIRS).hint("rebalance")), "swept")
        spare.append(found)
        pairs = found.where("b is not null").select("a", "b")
        swept = pairs if swept is None else swept.union(pairs)
        big = sizes.where(F.col("c") > p.chunk)
        lead = found.where("b is null").select(F.col("a").alias("id"), "key").join(big, "key", "left_semi")
        after = lead.groupBy("key").agg(F.count("*").alias("left")).join(big, "key")
        # go on while a long list got shorter; what is left is tried across components below
        if after.where(F.col("left") * 10 < F.col("c") * 9).isEmpty():
            break
        lists = durable(few(lead.select("id", "key")), "leaders")
    tried = durable(few(swept.distinct()), "tried")
    spare.append(tried)

    # the followers of a leader meet with their sets; blocks of one leader hold that leader, and meet each other after
    follows = durable(few(tried.select(F.col("a").alias("key"), F.col("b").alias("id")).union(tried.select(F.col("a").alias("key"), F.col("a").alias("id")).distinct())), "follows")
    spare.append(follows)
    # leaders whose followers make more than one block; sent to the executors where few, so that a leader with very many
    # followers gathers them nowhere
    many = follows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(p.set_chunk)).cast("long").alias("blocks")).where("blocks > 1")
    many = durable(few(many), "many")
    spare.append(many)
    sent = F.broadcast(many) if many.count() * 32 <= p.broadcast else many
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    block = F.when(F.col("id") == F.col("key"), every).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks"))))
    placed = follows.join(sent, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.explode(block))
    to = durable(few(placed.groupBy("id").agg(F.collect_list(F.struct("key", "block")).alias("to")), 4), "places")
    dealt = _sets(docs, to, p).select("id", F.explode("to").alias("t"), "shingles").select("t.key", "t.block", "id", "shingles")
    held = dealt.repartition(n_parts, "key", "block").sortWithinPartitions("key", "block")
    good = durable(few(held.mapInArrow(_forester(p), "a long, b long").distinct()), "links")
    large = durable(few(follows.join(sent.select("key"), "key", "left_semi")), "large")
    if not large.isEmpty():
        named = connected(good).withColumnRenamed("component", "label")
        marked = durable(few(large.join(named, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))), "marked")
        to = durable(few(_across(marked, p.set_chunk).groupBy("id").agg(F.collect_list(F.struct("key", "p", "q", "side", "label")).alias("to")), 4), "places")
        rows = _sets(docs, to, p).select("id", F.explode("to").alias("t"), "shingles").select("t.*", "id", "shingles")
        whole = rows.repartition(n_parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")
        met = whole.select("key", "p", "q", "id", "label", "side", "shingles").mapInArrow(_joiner(p), "a long, b long")
        good = durable(few(good.union(met).distinct()), "links")

    # what shares a list but no leader, across components
    leaders = follows.groupBy("id").agg(F.collect_set("key").alias("leaders"))
    slim = durable(slim.join(leaders, "id", "left").withColumn("leaders", F.coalesce("leaders", F.array().cast("array<bigint>"))), "slim")
    spare.append(slim)
    tries, lists, first = p.first_tries, posted, True
    while True:
        named = connected(good).withColumnRenamed("component", "label")
        marked = durable(few(lists.join(named, "id", "left").select("id", "key", F.coalesce("label", "id").alias("label")), 2), "marked")
        if first:
            # lists that more documents than a chunk share outside their largest component
            by_label = marked.groupBy("key", "label").agg(F.count("*").alias("c"))
            crowded = by_label.groupBy("key").agg((F.sum("c") - F.max("c")).alias("minor")).where(F.col("minor") > p.chunk).select("key")
            if not crowded.isEmpty():
                spare.append(marked)
                parted = _refined(marked.join(crowded, "key", "left_semi"), reps, p)
                marked = durable(few(marked.join(crowded, "key", "left_anti").select("id", "label", "key").union(parted).select("id", "key", "label")), "marked")
                lists = marked.select("id", "key")
            first = False
        dealt = _across(marked, p.chunk).join(slim, "id").repartition(n_parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")
        rows = dealt.select("key", "p", "q", "id", "n", "label", "side", "leaders", "sketch")
        found = durable(few(rows.mapInArrow(_crosser(p, tries), PAIRS).hint("rebalance")), "crossed")
        spare += [marked, found]
        new = durable(few(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")), "new")
        cut = found.where("more").select("key").distinct()
        if not new.isEmpty():
            good = durable(few(good.union(_confirmed(docs, new, p))), "links")
            tried = durable(few(tried.union(new)), "tried")
        if cut.isEmpty():
            drop(*spare)
            return good
        # lists whose documents have more to try get another round with more tries
        lists = durable(few(lists.join(cut, "key", "left_semi")), "lists")
        tries *= 64


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Texts without a word (null, empty, white space) have the empty set and are linked with nothing. Rows that
    share an id are one document, whose every text counts; they differ in n_shingles alone, and equal rows stay
    as often as they stand. A row whose id is null can't be named by a link: its component is null and it is
    kept. component_id is the smallest id reachable, so ties can't arise. An empty table gives an empty result;
    other columns are ignored. A text of any length is one set, made in one task from arrays of some forty bytes a word."""
    p = params
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = durable(slim.mapInArrow(_sketcher(p), SKETCHES), "sketches")
    digest = ["n", "d1", "d2"]
    classes = durable(sketched.where("n > 0 and id is not null").groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    # sets of fewer than four shingles reach 0.8 with no other set
    least = -(-p.percent // (100 - p.percent)) if p.percent < 100 else 1 << 62
    firsts = classes.where(F.col("n") >= least).select(*digest, F.col("rep").alias("id"))
    reps = durable(sketched.join(firsts, [*digest, "id"]).select("id", "n", "sig", "sketch").distinct(), "reps")
    named = slim.where("id is not null")
    found = links(named, reps, p)
    # an id with several texts belongs to several classes, which it joins
    of = sketched.where("n > 0 and id is not null").join(classes.select(*digest, "rep"), digest).select("id", "rep").distinct()
    several = of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    same = of.join(several, "id").select("a", F.col("rep").alias("b")).where("a <> b")
    joined = connected(found.union(same).distinct()).select(F.col("id").alias("rep"), "component")
    by_class = classes.join(joined, "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component"))
    rows = sketched.select("id", *digest).join(by_class, digest, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"), params=Params(shingle=2))
    return out.withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, and the closure of their links.
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS m, b.n AS n, count(*) AS c
      FROM u AS a JOIN u AS b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (m + n - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.j FROM r JOIN e ON e.i = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group (the one with the smallest id)."""
    gone = components(docs, doc_id, text, params).where(~F.col("kept")).select(F.col("id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["Params", "components", "keep", "links", "op3_minhash"]
