"""Packing: vector bin packing of token sequences by the dot-product heuristic.

A bin (sequence) has limits on tokens, segments and loss-bearing tokens. Of the open pieces that fit, the bin
takes the one whose demand has the largest dot product with what the bin has left, each dimension taken as a
share of its limit. When none fits whole, one is cut to fill the bin. A task packs block after block of its
rows, so nothing is shuffled and memory is bounded by a block; what is left in the last block is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table, utf8
from .textkit import LOWER, pieces, run_hashes

END = 2
#: Words whose ids a worker keeps; beyond it, it starts anew.
CACHE_WORDS = 700_000
#: Bytes of text that are encoded at once: the words that are new to the cache are merged together.
STEP = 1 << 20
#: Tokens that a task gathers before it packs them.
BLOCK_TOKENS = 1 << 20
#: Controls that the tokenizer takes for ordinary characters but str.split() for white space.
ODD_SPACES = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. ``loss`` defaults to a limit that binds only by tokens."""

    tokens: int = 4096
    segments: int = 4096
    loss: int = 4096


#: Limits of the registered query and of the pipeline: attention over more segments than these costs more than it gives.
#: Plain documents bear loss in every token, so a limit on loss below that on tokens would only pad sequences.
PRODUCTION = Limits(segments=128)


#: Where this finds nothing, lower() does to the whole text what the tokenizer does to it.
EXOTIC = re.compile("[^\x00-\u024f]")
#: Marks that end a word; the tokenizer parts them from the letter before them.
TAIL = re.compile("([.,!;:?](?<=[a-zß-öø-ÿ].)[.,!;:?]*)(?!\\S)")


class Merger:
    """Byte-pair merges of many words at once, as the tokenizer's file lists them: the pair of least rank first.

    Words of equal length are rows of a matrix of symbols. Each step merges the best pair of every row, and only
    the two pairs that a merge makes anew are looked up again."""

    NONE = np.int64(1 << 40)

    def __init__(self, model: dict):
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = dict(zip(plain, map(chr, plain), strict=True))
        signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in signs)}
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[signs[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[signs[b] + end] for b in range(256)], np.int64)
        self.made = np.array([vocabulary[x + y] for x, y in merges], np.int64)
        keys = np.array([vocabulary[x] << 16 | vocabulary[y] for x, y in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        # open addressing; most look-ups end at their first slot
        self.bits = 18
        self.slots, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE)
        for k, r in zip(keys[order].tolist(), order.tolist(), strict=True):
            at = int(self._slot(np.array([k]))[0])
            while self.slots[at] >= 0 and self.slots[at] != k:
                at = (at + 1) & ((1 << self.bits) - 1)
            if self.slots[at] < 0:
                self.slots[at], self.ranks[at] = k, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merge or no symbol."""
        keys = np.where((left >= 0) & (right >= 0), left << 16 | right, np.int64(-2))
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.ranks[at], self.NONE)
        more = np.flatnonzero(((self.slots[at] != keys) & (self.slots[at] >= 0) & (keys >= 0)).ravel())
        while len(more):
            where = (at.ravel()[more] + 1) & ((1 << self.bits) - 1)
            at.ravel()[more] = where
            want = keys.ravel()[more]
            hit = self.slots[where] == want
            out.ravel()[more[hit]] = self.ranks[where[hit]]
            more = more[~hit & (self.slots[where] >= 0)]
        return out

    def rows(self, data: np.ndarray) -> np.ndarray:
        """Ids of words of equal length (rows of bytes), -1 after a word's last."""
        n, width = data.shape
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, : width - 1], ids[:, width - 1] = self.inner[data[:, :-1]], self.last[data[:, -1]]
        ranks = np.full((n, width + 1), self.NONE)
        if width > 1:
            ranks[:, : width - 1] = self.rank(ids[:, : width - 1], ids[:, 1:width])
        columns = np.arange(width)
        live = np.arange(n)
        while len(live):
            r = ranks[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            go = best < self.NONE
            live, at, best, r = live[go], at[go], best[go], r[go]
            if not len(live):
                break
            k = np.arange(len(live))
            w = ids[live]
            w[k, at] = self.made[best]
            beyond = columns + (columns > at[:, None])
            w[:, :-1] = np.take_along_axis(w, beyond, 1)
            r[:, :-1] = np.take_along_axis(r, columns + (columns >= at[:, None]), 1)
            r[k, at] = self.rank(w[k, at], w[k, at + 1])
            has = at > 0
            r[k[has], at[has] - 1] = self.rank(w[k[has], at[has] - 1], w[k[has], at[has]])
            ids[live], ranks[live] = w, r
        return ids

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word and its ids, two bytes each."""
        by_size: dict[int, list[bytes]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, some in by_size.items():
            ids = self.rows(np.frombuffer(b"".join(some), np.uint8).reshape(-1, size))
            starts = np.arange(len(some)) * 2 * (size + 1)
            ends = starts + 2 * (ids >= 0).sum(axis=1)
            raw = ids.astype("<u2").tobytes()
            yield from zip(some, map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist())), strict=True)


#: Classes of bytes of ordinary Latin texts: white space, letters, digits, marks; all else is odd. An apostrophe is
#: odd, as the tokenizer has pieces like 's, and so is <, which begins its special tokens.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
CLASS[0x21:0x7F] = MARK
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = CLASS[0x80:0xC0] = CLASS[0xC3] = LETTER
CLASS[[0x27, 0x3C]] = ODD


class Pieces:
    """Ids of the pieces of ordinary Latin texts, looked up by the 64-bit hash of a piece's bytes in an open-addressed
    table of numpy arrays."""

    BITS = 21

    def __init__(self, merger: Merger, ids_of):
        self.merger, self.ids_of = merger, ids_of
        self.keys, self.index = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.starts, self.flat, self.size = np.zeros(1, np.int64), np.empty(0, np.uint16), 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's entry or -1, and the slot at which the search ended."""
        at = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.index[at].copy()
        more = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.BITS) - 1)
            out[more] = self.index[at[more]]
            more = more[(out[more] >= 0) & (self.keys[at[more]] != hashes[more])]
        return out, at

    def _add(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        first = self.size
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, flat])
        self.size += len(hashes)
        todo = np.arange(len(hashes))
        while len(todo):
            _, at = self._find(hashes[todo])
            # of those that end at one slot, one is placed at a time
            _, one = np.unique(at, return_index=True)
            self.keys[at[one]], self.index[at[one]] = hashes[todo[one]], first + todo[one]
            todo = np.delete(todo, one)

    def _ids(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of at most CACHE_WORDS words, and their ids."""
        entry, _ = self._find(hashes)
        fresh, where = np.unique(hashes[entry < 0], return_index=True)
        if self.size + len(fresh) > CACHE_WORDS:
            self.__init__(self.merger, self.ids_of)
            entry = np.full(len(hashes), -1)
            fresh, where = np.unique(hashes, return_index=True)
        if len(fresh):
            place = np.flatnonzero(entry < 0)[where]
            spelled = [text[a:b].tobytes() for a, b in zip(starts[place], ends[place], strict=True)]
            got = dict(self.merger.encode([w for w, x in zip(spelled, letters[place], strict=True) if x]))
            rest = [w for w in spelled if w not in got]
            got |= zip(rest, self.ids_of([w.decode("utf-8", "replace") for w in rest]), strict=True)
            raw = [got[w] for w in spelled]
            self._add(fresh, np.array([len(x) // 2 for x in raw], np.int64), np.frombuffer(b"".join(raw), np.uint16))
            entry, _ = self._find(hashes)
        begin = self.starts[entry]
        count = self.starts[entry + 1] - begin
        total = np.cumsum(count)
        return count, self.flat[np.repeat(begin - total + count, count) + np.arange(int(count.sum()))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray | None]:
        """Ids of each row, then the end id; None for a row that is not ordinary."""
        kind = CLASS[data]
        text = LOWER[data]
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        high = after & (data >= 0x80) & (data <= 0x9E)
        text[high] += 0x20
        kind[after & ((data == 0x97) | (data == 0xB7))] = ODD
        odd = np.add.reduceat(np.append(kind == ODD, False).astype(np.int64), offsets)[:-1] if len(offsets) > 1 else np.empty(0, np.int64)
        odd[np.diff(offsets) == 0] = 0
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[offsets] = True
        bounds = np.flatnonzero(edge)
        full = kind[bounds[:-1]] != BLANK if len(data) else np.empty(0, bool)
        starts, ends = bounds[:-1][full], bounds[1:][full]
        words = np.diff(np.searchsorted(starts, offsets))
        hashes, letters = run_hashes(text, starts, ends), kind[starts] == LETTER
        # runs that fit the table even where every word is new, so that a text of any number of words gets through
        runs = [self._ids(text, starts[k : k + CACHE_WORDS], ends[k : k + CACHE_WORDS], hashes[k : k + CACHE_WORDS], letters[k : k + CACHE_WORDS]) for k in range(0, len(starts), CACHE_WORDS)]
        count = np.concatenate([np.empty(0, np.int64), *(c for c, _ in runs)])
        ids = np.concatenate([np.empty(0, np.uint16), *(x for _, x in runs)])
        total = np.concatenate([[0], np.cumsum(count)])
        at = total[np.concatenate([[0], np.cumsum(words)])]
        out: list[np.ndarray | None] = []
        for k, bad in enumerate(odd.tolist()):
            if bad:
                out.append(None)
                continue
            row = np.empty(at[k + 1] - at[k] + 1, "<u4")
            row[:-1], row[-1] = ids[at[k] : at[k + 1]], END
            out.append(row)
        return out


class Encoder:
    """Token ids of whole texts. The tokenizer drops white space and splits at it, so a text's ids are those of
    its words in turn, and a word's ids are looked up after its first use (as bytes: all ids are below 65536)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        with open(path, encoding="utf-8") as f:
            self.merger = Merger(json.load(f)["model"])
        self.known: dict[str, bytes] = {}
        self.pieces = Pieces(self.merger, self._tokenized)

    def _tokenized(self, words: list[str]) -> list[bytes]:
        found = (e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
        return [struct.pack(f"<{len(x)}H", *x) for x in found]

    def _words(self, text: str) -> list[str] | None:
        if ODD_SPACES.search(text):
            return None
        if not EXOTIC.search(text):
            text = text.lower()
        return TAIL.sub(r" \1", text).split()

    def encode_batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, then the end id."""
        data, offsets = utf8(column)
        for a, b in pieces(offsets, STEP):
            rows = self.pieces.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            others = [k for k, x in enumerate(rows) if x is None]
            for k, x in zip(others, self.encode([column[a + k].as_py() for k in others]), strict=True):
                rows[k] = x
            yield from rows

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of any texts, then the end id, word by word."""
        lists = [self._words(t) for t in texts]
        words = set().union(*(x for x in lists if x))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        self.known.update(zip(new, self._tokenized(new), strict=True))
        end, out = END.to_bytes(2, "little"), []
        for text, x in zip(texts, lists, strict=True):
            if x is None:
                out.append(np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], "<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(self.known.__getitem__, x)) + end, "<u2").astype("<u4"))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(lengths: np.ndarray, loss: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, bin, offset) for items of so many tokens, of which the first ``loss`` bear loss.

    Bins are filled one by one. Every token lies in exactly one piece."""
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    out: list[tuple[int, int, int, int, int]] = []
    start = np.zeros(len(lengths), np.int64)
    left, bears = lengths.astype(np.int64).copy(), loss.astype(np.int64).copy()
    at = 0
    if limits.segments >= 1 and limits.loss >= limits.tokens:
        # items of a bin's size fill whole bins alone
        for i in np.flatnonzero(left >= limits.tokens):
            while left[i] >= limits.tokens:
                out.append((int(i), int(start[i]), limits.tokens, at, 0))
                start[i] += limits.tokens
                left[i] -= limits.tokens
                bears[i] = max(0, bears[i] - limits.tokens)
                at += 1
    # items of equal demand are alike to the heuristic: they wait in one queue
    queue: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(left > 0)[::-1]:
        queue.setdefault((int(left[i]), int(bears[i])), []).append(int(i))
    while queue:
        kinds = np.array(list(queue), np.int64)
        have = np.array([len(queue[k[0], k[1]]) for k in kinds.tolist()], np.int64)
        demand = np.column_stack([kinds[:, 0], np.ones(len(kinds), np.int64), kinds[:, 1]])
        share = demand / cap
        while have.any():
            room, offset, used = cap.copy(), 0, 0
            while True:
                fits = (have > 0) & (demand <= room).all(axis=1)
                if not fits.any():
                    break
                score = share @ (room / cap)
                score[~fits] = -1.0
                k = int(score.argmax())
                i = queue[int(kinds[k, 0]), int(kinds[k, 1])].pop()
                have[k] -= 1
                out.append((i, int(start[i]), int(left[i]), at, offset))
                offset += int(left[i])
                room -= demand[k]
                left[i] = 0
            # nothing fits whole: cut the piece that has most tokens so that it fills the bin
            most = int(min(room[0], limits.tokens))
            if have.any() and most > 0 and room[1] >= 1:
                k = int(np.where(have > 0, kinds[:, 0], -1).argmax())
                size, heavy = int(kinds[k, 0]), int(kinds[k, 1])
                take = min(most, size)
                if min(take, heavy) > room[2]:
                    take = int(room[2])
                if take > 0:
                    i = queue[size, heavy].pop()
                    have[k] -= 1
                    out.append((i, int(start[i]), take, at, offset))
                    start[i] += take
                    left[i] -= take
                    bears[i] = max(0, bears[i] - take)
                    used = i + 1
            at += 1
            if used and left[used - 1] > 0:
                i = used - 1
                key = (int(left[i]), int(bears[i]))
                same = np.flatnonzero((kinds[:, 0] == key[0]) & (kinds[:, 1] == key[1]))
                if len(same):
                    queue[key].append(i)
                    have[same[0]] += 1
                else:
                    queue[key] = [i]
                    kinds = np.vstack([kinds, key])
                    demand = np.vstack([demand, [key[0], 1, key[1]]])
                    share = demand / cap
                    have = np.append(have, 1)
        queue = {k: v for k, v in queue.items() if v}
    return out


def halve(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The last bin's pieces, dealt anew into bins whose lengths are powers of two, so that none is padded."""
    last = max(p[3] for p in pieces)
    done = [p for p in pieces if p[3] != last]
    todo = sorted((p for p in pieces if p[3] == last), key=lambda p: p[4])
    total, at = sum(p[2] for p in todo), last
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    room, offset = sizes.pop(0), 0
    for item, start, length, _, _ in todo:
        while length:
            take = min(room, length)
            done.append((item, start, take, at, offset))
            start, length, room, offset = start + take, length - take, room - take, offset + take
            if not room and sizes:
                room, offset, at = sizes.pop(0), 0, at + 1
    return done


OUT = "start long, length long, ids_crc32 long, item_tokens long, sequence_id long, offset long"


def _packer(path: str, limits: Limits, loss_column: bool, halved: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_batch
        # a task's sequences are numbered within its partition, so a second attempt numbers them alike
        task, sequence = TaskContext.get().partitionId(), 0
        # an item: its row, all its ids, the first id not yet written, and its leading ids that bear loss
        items: list[tuple] = []
        held = 0

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal sequence, items, held
            lengths = np.array([len(ids) - at for _, ids, at, _ in items], np.int64)
            bears = np.clip(np.array([loss - at for _, _, at, loss in items], np.int64), 0, lengths)
            placed, again = pack(lengths, bears, limits), []
            last = max(p[3] for p in placed)
            if sum(p[2] for p in placed if p[3] == last) < limits.tokens:
                if not final and last:
                    # a bin that is not full is packed again with the next block
                    again = [(items[i][0], items[i][1], items[i][2] + s, items[i][3]) for i, s, _, b, _ in placed if b == last]
                    placed = [p for p in placed if p[3] != last]
                elif final and halved:
                    placed = halve(placed)
            which, start, size, number, offset = (np.array(c, np.int64) for c in zip(*placed, strict=True))
            start = start + np.array([x[2] for x in items], np.int64)[which]
            parts = [items[i][1][s : s + n] for i, s, n in zip(which, start, size, strict=True)]
            sums = [zlib.crc32(x.tobytes()) for x in parts]
            total = np.array([len(x[1]) for x in items], np.int64)[which]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([items[i][0] for i in which], row_type),
                    *map(pa.array, (start, size, np.array(sums, np.int64), total, (np.int64(task) << np.int64(36)) + sequence + number, offset)),
                    *([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))] if with_ids else []),
                ],
                ["row", "start", "length", "ids_crc32", "item_tokens", "sequence_id", "offset", *["ids"] * with_ids],
            )
            sequence += int(number.max()) + 1
            items, held = again, sum(len(x[1]) - x[2] for x in again)
            return out

        row_type = None
        for batch in batches:
            row_type = batch.schema.field("_row").type
            each = encode(batch.column("_text"))
            for row, ids, loss in zip(batch.column("_row"), each, batch.column("_loss"), strict=True):
                items.append((row.as_py(), ids, 0, (loss.as_py() or 0) if loss_column else len(ids)))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield flush(False)
        if items:
            yield flush(True)

    return run


def pack_documents(
    docs: DataFrame, path: str, text: str = "text", limits: Limits = Limits(), loss: str | None = None, halved: bool = True, ids: bool = False
) -> DataFrame:
    """(row, start, length, ids_crc32, item_tokens, sequence_id, offset and, with ``ids``, the token ids): one row per
    piece.

    A text's ids are those of the tokenizer at ``path``, then id 2; a null or empty text has id 2 alone.
    ``loss`` names a column with the number of leading tokens that bear loss (null: 0); without it all do. A
    text of any length is cut freely over sequences. Repeated rows are packed each on its own; the order among
    equal demands is that of the input; an empty table gives an empty result; columns of ``docs``, whatever
    their names, travel inside ``row``. With ``halved`` the tail of a task is cut into lengths of powers of
    two."""
    from pyspark.sql import functions as F

    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be positive")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 or text not in docs.columns else F.struct(F.lit(None).cast("int").alias("none"))
    slim = docs.select(whole.alias("_row"), F.col(text).alias("_text"), (F.col(loss).cast("long") if loss else F.lit(0)).alias("_loss"))
    row = slim.schema["_row"].dataType.simpleString()
    # the tail's power-of-two sequences hold a subset of one bin's segments and loss, so they keep all limits
    return slim.mapInArrow(_packer(path, limits, loss is not None, halved, ids), f"row {row}, {OUT}" + ", ids array<int>" * ids)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), limits=PRODUCTION)
    return out.select("row.doc_id", "start", "length", "ids_crc32", out["item_tokens"].alias("doc_tokens"), "sequence_id", "offset")
