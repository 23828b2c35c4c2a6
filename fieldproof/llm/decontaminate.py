"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of a benchmark item of n characters with at most e edits shares at least n - q + 1 - e * q
q-grams with the text, and their diagonals (place in the text minus place in the item) lie within a band of
e + 1. Shared q-grams are counted in overlapping bands of twice that width; a band region that meets the bound
is verified by a banded alignment (edit distance of the item to some substring of the region).

Texts and items are compared as lower-case (A-Z) bytes with runs of white space made one space, so q-grams are
byte q-grams of the UTF-8 form. Benchmark items are the fixed side: their bytes are counted, and where they
exceed the broadcast limit they are taken in blocks, each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table, utf8
from .textkit import ALNUM, LOWER, PIECE, SPACE, pieces

Q = 8
BITS = 20


@dataclass(frozen=True)
class Budget:
    """Edits allowed for an item of n bytes: ``floor(rate * n)``. With q = 8 the lemma needs a rate below 1 / 8.
    Items shorter than ``least`` bytes would match by chance: they are allowed no edits and must stand as whole words,
    with no letter or digit right before or after them."""

    rate: float = 0.08
    least: int = 40


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with one space for each run of white space, each row followed by q zero bytes, so that no
    q-gram crosses rows; and the offsets of the rows in it."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    text = LOWER[data]
    text[space] = 0x20
    sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), offsets)[:-1] if len(offsets) > 1 else np.empty(0, np.int64)
    sizes[np.diff(offsets) == 0] = 0
    at = np.concatenate([[0], np.cumsum(sizes + Q)])
    out = np.zeros(int(at[-1]) + Q, np.uint8)
    place = np.ones(int(at[-1]), bool)
    for k in range(Q):
        place[at[1:] - 1 - k] = False
    out[: len(place)][place] = text[keep]
    return out, at


def grams(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    n = max(len(text) - Q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        np.left_shift(out, np.uint64(8), out=out)
        np.bitwise_or(out, text[k : k + n], out=out)
    return out


class Index:
    """q-grams of the items: a bit table for a first look, then all places of a q-gram by binary search."""

    def __init__(self, items: list[tuple[int, bytes]], budget: Budget):
        self.ids, self.texts, self.edits = [], [], []
        short: dict[int, list[tuple[int, int, int]]] = {}
        keys, places = [], []
        for item_id, raw in items:
            data = np.frombuffer(raw, np.uint8)
            text, at = squeeze(data, np.array([0, len(data)], np.int64))
            text = np.frombuffer(bytes(text[: at[1] - Q]).strip(b" "), np.uint8)
            if not len(text):
                continue
            self.ids.append(item_id)
            self.texts.append(text)
            if len(text) < max(budget.least, Q):
                self.edits.append(0)
                size = min(len(text), Q)
                first, last = (int.from_bytes(x.tobytes(), "big") for x in (text[:size], text[-size:]))
                short.setdefault(size, []).append((first, last, len(self.ids) - 1))
                continue
            edits = int(budget.rate * len(text))
            if len(text) - Q + 1 - edits * Q < 1:
                raise ValueError("the edit budget leaves the q-gram lemma nothing to count")
            self.edits.append(edits)
            got = grams(text)
            place = sparse(got, 2 * (edits + 1))
            keys.append(got[place])
            places.append(np.column_stack([np.full(len(place), len(self.ids) - 1), place]))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.places = (np.concatenate(places) if places else np.empty((0, 2), np.int64))[order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array(self.edits, np.int64)
        #: no occurrence, with its bands on both sides, is longer
        self.reach = int((self.sizes + 6 * (self.edits + 1)).max(initial=0)) + 2 * Q + budget.least
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self._slot(self.keys)] = True
        self.starts = np.zeros(1 << BITS, bool)
        # by the number of leading bytes compared: their values, the values of as many last bytes, and the items
        self.short = {n: tuple(np.array(x, d) for x, d in zip(zip(*sorted(v), strict=True), (np.uint64, np.uint64, np.int64), strict=True)) for n, v in short.items()}
        if Q in self.short:
            self.starts[self._slot(self.short[Q][0])] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

    def whole(self, text: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
        """(place in the text, item) of every short item that stands there as whole words. ``found``: the text's q-grams."""
        out = []
        for size, (first, last, items) in self.short.items():
            cut = np.uint64(8 * (Q - size))
            at = np.arange(len(found))
            if size < Q:  # no word begins within another
                at = at[~ALNUM[text[at - 1]] | (at == 0)]
            else:
                at = np.flatnonzero(self.starts[self._slot(found)])
            seen = found[at] >> cut
            lo = np.searchsorted(first, seen, "left")
            count = np.searchsorted(first, seen, "right") - lo
            at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
            which = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(at, count)
            n = np.array([len(self.texts[k]) for k in items], np.int64)[which]
            end = at + n
            good = end + Q <= len(text)
            at, which, n, end = at[good], which[good], n[good], end[good]
            good = (found[end - size] >> cut) == last[which]
            good &= ((at == 0) | ~ALNUM[text[at - 1]]) & ~ALNUM[text[end]]
            for p, k, e in zip(at[good].tolist(), items[which[good]].tolist(), end[good].tolist(), strict=True):
                if text[p:e].tobytes() == self.texts[k].tobytes():
                    out.append((p, k))
        return out

    def found(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first entry, number of entries) of the places of a text's q-grams that stand in items."""
        at = np.flatnonzero(self.bits[self._slot(found)])
        lo = np.searchsorted(self.keys, found[at], "left")
        count = np.searchsorted(self.keys, found[at], "right") - lo
        return at[count > 0], lo[count > 0], count[count > 0]

    def shared(self, lo: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The number of shared q-grams of each item, from what ``found`` gave; each q-gram's places are looked at once."""
        first, at, times = np.unique(lo, return_index=True, return_counts=True)
        size = count[at]
        which = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(self.places[which, 0], np.repeat(times, size), minlength=len(self.sizes))

    def hits(self, at: np.ndarray, lo: np.ndarray, count: np.ndarray, left: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of shared q-grams, of every ``parts``-th item that is ``left``."""
        places = self.places
        if parts > 1 or not left.all():
            mine = (places[:, 0] % parts == part) & left[places[:, 0]]
            before = np.concatenate([[0], np.cumsum(mine)])
            lo, count, places = before[lo], before[lo + count] - before[lo], places[mine]
        which = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), places[which, 0], places[which, 1]


def sparse(grams_: np.ndarray, width: int) -> np.ndarray:
    """Places of an item's q-grams, without those between two kept places of the same q-gram that are ``width`` or less
    apart: in a band of that width, whatever the text's place, they'd count what one of the two counts. So a run of
    equal letters keeps a few places a band, not all."""
    kept, last, held = [], {}, {}
    for place, key in enumerate(grams_.tolist()):
        if key not in last:
            kept.append(place)
            last[key] = place
        elif place - last[key] <= width:
            held[key] = place
        else:
            if key in held:
                kept.append(held[key])
                last[key] = held.pop(key)
            if place - last[key] <= width:
                held[key] = place
            else:
                kept.append(place)
                last[key] = place
    return np.array(sorted(kept + list(held.values())), np.int64)


def best_edits(item: np.ndarray, region: np.ndarray, shift: int, band: int) -> int:
    """Least edit distance of ``item`` to a substring of ``region`` along diagonals within ``band`` of ``shift``.

    Row by row over the item; the cells of a row are the diagonals of the band, so a row costs its width."""
    width = 2 * band + 1
    diagonal = np.arange(width) + shift - band
    far = len(item) + 1
    inside = (diagonal >= 0) & (diagonal <= len(region))
    cost = np.where(inside, 0, far)  # an occurrence may start anywhere
    padded = np.append(region.astype(np.int64), -1)
    ramp = np.arange(width)
    for i, letter in enumerate(item):
        column = diagonal + i  # the region's place that this row's letter is compared with
        usable = (column >= 0) & (column < len(region))
        match = cost + (padded[np.where(usable, column, -1)] != letter)
        match[~usable] = far
        gap = np.append(cost[1:], far) + 1  # the letter has no counterpart
        step = np.minimum(match, gap)
        step[(column + 1 < 0) | (column + 1 > len(region))] = far
        # letters of the region without a counterpart: cheapest from the left, one each
        cost = np.minimum.accumulate(step - ramp) + ramp
        cost = np.minimum(cost, far)
    return int(cost.min())


#: Shared q-grams that are counted at once.
MOST = 1 << 19


def _counted(text: np.ndarray, offsets: np.ndarray, index: Index, base: int, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first diagonal, width) of the bands that meet their item's bound; places are counted from ``base``."""
    at, item, place = hits
    if not len(at):
        return
    at = at + base
    row = np.searchsorted(offsets, at, "right") - 1
    need = index.sizes - Q + 1 - index.edits * Q
    diagonal = at - place
    # two layers of bands, half a width apart: any e + 1 neighbouring diagonals lie in one band whole
    for layer in (0, 1):
        width = 2 * (index.edits + 1)
        shift = layer * (index.edits + 1)
        band = (diagonal + shift[item]) // width[item]
        order = np.lexsort((at, band, item, row))
        r, i, b, d = row[order], item[order], band[order], at[order]
        cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0)) + 1
        starts = np.concatenate([[0], cut])
        # distinct places of the text, as one place may share a q-gram with several of the item's
        fresh = np.ones(len(r), bool)
        fresh[1:] = d[1:] != d[:-1]
        fresh[starts] = True
        good = starts[np.add.reduceat(fresh.astype(np.int64), starts) >= need[i[starts]]]
        k = i[good]
        yield from zip(r[good].tolist(), k.tolist(), (b[good] * width[k] - shift[k]).tolist(), width[k].tolist(), strict=True)


#: What sorting and counting a shared q-gram costs, in cells of an alignment; and places that are aligned at once.
DEAR, AT_ONCE = 64, 1 << 14


def _aligned(text: np.ndarray, offsets: np.ndarray, item: np.ndarray, most: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, end, edits) of the regions in which ``item`` begins at [lo, hi) with at most ``most`` edits: one alignment of the item
    with all that stands there, so the cost is that of its length a byte, however often the text repeats itself.

    cost[j] is the least edits of the item's first letters to what ends before place j. An occurrence stays in its row: places
    between rows are out of reach, and the ramp that spreads the cost of further letters to the right falls off a cliff there."""
    n = len(item)
    hi = min(hi + n + most, len(text))
    row = np.searchsorted(offsets, np.arange(lo, hi + 1), "right") - 1
    inside = np.arange(lo, hi + 1) <= offsets[np.minimum(row + 1, len(offsets) - 1)] - Q
    far = n + most + 1
    cliff = hi - lo + 4 * far
    kind = np.int32 if (int(row[-1] - row[0]) + 2) * cliff < 1 << 30 else np.int64
    ramp = (np.arange(hi - lo + 1) + (row - row[0]) * cliff).astype(kind)
    cost = np.where(inside, 0, far).astype(kind)
    letters = text[lo:hi]
    fresh = np.ones(hi - lo + 1, bool)  # places where no letter of the row stands before
    fresh[1:] = (row[1:] != row[:-1]) | ~inside[:-1]
    step, match = np.empty_like(cost), np.empty_like(cost)
    for letter in item:
        np.add(cost, 1, out=step)  # the letter has no counterpart
        match[0] = far
        np.add(cost[:-1], letters != letter, out=match[1:])
        match[fresh] = far
        np.minimum(step, match, out=step)
        step[~inside] = far
        np.subtract(step, ramp, out=step)
        np.minimum.accumulate(step, out=step)
        np.add(step, ramp, out=cost)
        np.minimum(cost, far, out=cost)
        if cost.min() > most:
            return
    ends = np.flatnonzero((cost <= most) & inside)
    apart = (np.diff(row[ends]) != 0) | (np.diff(ends) >= n // 4 + most)
    for group in np.split(ends, np.flatnonzero(apart) + 1):
        if len(group):
            r = int(row[group[0]])
            yield r, max(int(offsets[r]), lo + int(group[0]) - n - most), lo + int(group[-1]), int(cost[group].min())


def _regions(text: np.ndarray, offsets: np.ndarray, index: Index, lo: int, end: int, known: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """Verified regions of what begins in [lo, end), and of some that begin a little later; places in ``text``. Where q-grams are
    so many that counting them costs more than aligning an item with the whole stretch (repetitive texts), it is aligned."""
    stack = [(lo, end, np.ones(len(index.sizes), bool))]
    while stack:
        lo, end, left = stack.pop()
        hi = min(end + index.reach, len(text))
        before = max(lo - 1, 0)
        seen = grams(text[before:hi])
        for p, k in index.whole(text[before:hi], seen):
            if p or not lo:
                r = int(np.searchsorted(offsets, p + before, "right")) - 1
                yield r, k, p + before, p + before + int(index.sizes[k]), 0
        at, first, count = index.found(seen)
        total = int(count.sum())
        if total > MOST:
            each = np.where(left, index.shared(first, count), 0)
            dear = each * DEAR > (hi - before) * index.sizes
            for k in np.flatnonzero(dear).tolist():
                stride = max(AT_ONCE, 4 * int(index.sizes[k]))
                for at_ in range(lo, end, stride):
                    for r, start, stop, got in _aligned(text, offsets, index.texts[k], int(index.edits[k]), at_, min(at_ + stride, end)):
                        yield r, k, start, stop, got
            left = left & ~dear
            total = int(each[left].sum())
        if total > MOST and end - lo > index.reach:
            middle = (lo + end) // 2
            stack += [(middle, end, left), (lo, middle, left)]
            continue
        parts = -(-total // MOST)
        for part in range(parts):
            for r, k, low, width in _counted(text, offsets, index, before, index.hits(at, first, count, left, part, parts)):
                e, size = int(index.edits[k]), int(index.sizes[k])
                start, stop = max(int(offsets[r]), low - e), min(int(offsets[r + 1]) - Q, low + width + size + e)
                if stop <= start:
                    continue
                region = text[start:stop].tobytes()
                if index.texts[k].tobytes() in region:
                    got = 0
                else:
                    # repetitive texts give the same region again and again
                    key = (k, low - start, region)
                    if key not in known:
                        if len(known) > 1 << 12:
                            known.clear()
                        known[key] = best_edits(index.texts[k], text[start:stop], low + width // 2 - start, width // 2 + e + 1)
                    got = known[key]
                if got <= e:
                    yield r, k, start, stop, got


def scan(text: np.ndarray, offsets: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of verified regions in squeezed rows, places counted from the row's start, in the
    order of row, item and start. Texts are looked at in overlapping stretches; regions of an item that share more than
    three quarters of its length (so, in a repetitive text, one region after another) are one, with the least edits."""
    known: dict[tuple[int, int, bytes], int] = {}
    sizes = index.sizes.tolist()

    def merged(regions: Iterator[tuple[int, int, int, int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for r, k, start, end, edits in regions:
            last = out[-1] if out else None
            if last and last[0] == r and last[1] == k and last[2] <= start and last[3] - start > 0.75 * sizes[k]:
                last[3], last[4] = max(last[3], end), min(last[4], edits)
            else:
                out.append([r, k, start, end, edits])
        return out

    found: list[list[int]] = []
    step = max(PIECE, 2 * index.reach)
    for lo in range(0, max(len(text), 1), step):
        found += merged(_regions(text, offsets, index, lo, min(lo + step, len(text)), known))
    out = merged(sorted(found))
    return [(r, k, start - int(offsets[r]), end - int(offsets[r]), edits) for r, k, start, end, edits in out]


def _matcher(items: list[tuple[int, bytes]], budget: Budget, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, budget)
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            hit: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in pieces(offsets, PIECE):
                text, at = squeeze(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for r, k, s, e, d in scan(text, at, index):
                    hit[a + r].append({"item_id": index.ids[k], "start": s, "end": e, "edits": d})
            for h in hit:
                h.sort(key=lambda x: (x["start"], x["item_id"] if x["item_id"] is not None else -1))
            text = [batch.column("_text")] if whole else []
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *text, pa.array(hit, SPANS)], ["row", *["text"] * whole, "spans"])

    return run


SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
BLOCK_BYTES = 16 << 20


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``limit`` bytes, one block at a time on the driver."""
    block, held = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.coalesce(F.col(text), F.lit("")).cast("binary")).distinct().toLocalIterator():
        block.append((r[0], bytes(r[1])))
        held += len(r[1]) + 16
        if held > limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    budget: Budget = Budget(), block_bytes: int = BLOCK_BYTES, whole: bool = True,
) -> DataFrame:
    """(row, spans): every row of ``docs`` as a struct (without its text unless ``whole``) and the regions that hold a
    benchmark item within its edit budget, by start, those that start together by item. Places are counted in the squeezed lower-case bytes of the text.

    Null and empty texts have no span; a very long or repetitive text is looked at in stretches of bounded work; repeated rows get equal spans; overlapping items each get their own; an
    empty benchmark or an empty table gives no span. A null item_id is reported as null. Columns of ``docs``,
    whatever their names, travel inside ``row``. With one block of items (the usual case) nothing is shuffled;
    each further block is one more narrow pass over rows that were written to the shared folder."""
    rest = [c for c in docs.columns if c != text]
    fields = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    # a text goes to Python once; further blocks need it again
    slim = docs.select(fields.alias("_row"), F.col(text).alias("_text"))
    kind = slim.schema["_row"].dataType.simpleString()
    spans = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    part, following = next(parts, None), next(parts, None)
    if part is None:
        found = slim.select(F.col("_row").alias("row"), F.col("_text").alias("text"), F.array().cast(spans).alias("spans"))
    else:
        with_text = whole or following is not None
        found = slim.mapInArrow(_matcher(part, budget, with_text), f"row {kind}, {'text string, ' * with_text}spans {spans}")
    while following is not None:
        before = durable(found, "decontamination").select(F.struct("row", "spans").alias("_row"), F.col("text").alias("_text"))
        more = before.mapInArrow(_matcher(following, budget, True), f"row {before.schema['_row'].dataType.simpleString()}, text string, spans {spans}")
        found = more.select("row.row", "text", F.concat("row.spans", "spans").alias("spans"))
        following = next(parts, None)
    if whole:
        row = F.struct(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
        return found.select(row.alias("row"), "spans")
    return found.select("row", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return find(docs, benchmark, **options).where(F.size("spans") == 0).select("row.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), whole=False)
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return out.select(
        "row.doc_id",
        (F.size("spans") > 0).alias("contaminated"),
        F.size("spans").cast("long").alias("n_regions"),
        items.alias("item_ids"),
        F.array_min(F.transform("spans", lambda s: s["edits"])).alias("least_edits"),
    )
