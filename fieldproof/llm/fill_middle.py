"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, which are put into another order.

One numpy kernel works on the UTF-8 buffers of a whole Arrow batch. Each byte gets its class from a lookup table; a mask
over neighbouring bytes marks where a unit (a line, a word or a code point) ends; a cumulative sum, set back at each
document, numbers the units; and ``searchsorted`` finds the cuts of all documents together. The output's bytes are
gathered by one index over the batch and the sentinels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, free, table, utf8
from .textkit import pieces

#: Classes of bytes.
INNER, LETTER, BLANK, BREAK = 0, 1, 2, 3
CLASS = np.full(256, LETTER, np.uint8)
CLASS[0x80:0xC0] = INNER  # the second and later bytes of a code point
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
CLASS[0x0A] = BREAK
#: Texts that are worked on at once; a longer one stands alone.
BATCH = 1 << 20
UNITS = ("line", "word", "char")


@dataclass(frozen=True)
class Fim:
    """``percent`` of texts are transformed, ``spm_percent`` of them with the suffix first; cuts fall between units."""

    unit: str = "line"
    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.marks
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        if len(set(marks)) < 3 or "" in marks:
            raise ValueError("sentinels must differ and not be empty")
        # else an end of a text and a sentinel might read as an earlier sentinel, and the text could not be rebuilt
        for one in marks:
            for other in marks:
                if any(one.endswith(other[:k]) for k in range(1, len(other))) or (one != other and one in other):
                    raise ValueError(f"no end of a sentinel may begin another: {one!r}, {other!r}")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit ends behind each byte. Lines keep their line break, words the blanks and breaks behind them; blanks that
    begin a text are a unit. A text's last byte ends one."""
    kind = CLASS[data]
    after = np.full(len(data), LETTER, np.uint8)
    after[:-1] = kind[1:]
    if unit == "line":
        found = kind == BREAK
    elif unit == "char":
        found = after != INNER
    else:
        found = (kind >= BLANK) & (after < BLANK)
    found[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return found


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of units n of each text, and the places in ``data`` behind its first ``first`` % (n + 1) and ``second`` % (n + 1) units,
    the smaller one first."""
    total = np.cumsum(ends(data, offsets, unit))
    reached = np.concatenate([[0], total])[offsets]  # units before each text: the sum is set back by it
    n, before = np.diff(reached), reached[:-1]
    one, two = first % (n + 1), second % (n + 1)
    ranks = np.stack([np.minimum(one, two), np.maximum(one, two)])
    places = np.searchsorted(total, before + ranks, "left") + 1
    places = np.where(ranks == 0, offsets[:-1], places)
    return n, places[0], places[1]


def holding(data: np.ndarray, offsets: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """The texts that hold one of ``marks``."""
    found = np.zeros(len(offsets) - 1, bool)
    for mark in marks:
        spelled = np.frombuffer(mark.encode(), np.uint8)
        at = np.flatnonzero(data == spelled[0])
        for k in range(1, len(spelled)):
            at = at[at + k < len(data)]
            at = at[data[at + k] == spelled[k]]
        row = np.searchsorted(offsets, at, "right") - 1
        found[row[at + len(spelled) <= offsets[row + 1]]] = True
    return found


def gathered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row's runs [start, stop) one behind another, and the offsets of rows. Two dimensions: row, run."""
    sizes = stops - starts
    ends_ = np.cumsum(sizes.ravel())
    index = np.repeat(starts.ravel() - (ends_ - sizes.ravel()), sizes.ravel()) + np.arange(ends_[-1] if len(ends_) else 0)
    return data[index], np.concatenate([[0], np.cumsum(sizes.sum(1))])


def transformed(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, fim: Fim) -> tuple:
    """Of a batch: units, form (0 plain, 1 psm, 2 spm), code points of prefix and middle, output bytes and their offsets."""
    n, low, high = cuts(data, offsets, h[0], h[1], fim.unit)
    begin, end = offsets[:-1], offsets[1:]
    plain = (begin == end) | (h[2] % 100 >= fim.percent) | holding(data, offsets, fim.marks)
    form = np.where(plain, 0, np.where(h[3] % 100 < fim.spm_percent, 2, 1))
    points = np.concatenate([[0], np.cumsum(CLASS[data] != INNER)])
    chars = np.stack([points[low] - points[begin], points[high] - points[low]])
    marks = [np.frombuffer(m.encode(), np.uint8) for m in fim.marks]
    pool = np.concatenate([data, *marks])
    edge = len(data) + np.cumsum([0, *map(len, marks)])
    whole = np.zeros_like(begin)
    mark = lambda k: (whole + edge[k], whole + edge[k + 1])
    prefix, middle, suffix = (begin, low), (low, high), (high, end)
    psm = [mark(0), prefix, mark(1), suffix, mark(2), middle]
    spm = [mark(1), suffix, mark(0), prefix, mark(2), middle]
    none = (whole, whole)
    same = [none, (begin, end), none, none, none, none]
    runs = np.array([same, psm, spm])  # form, run, start or stop, row
    picked = runs[form, :, :, np.arange(len(form))]
    out, at = gathered(pool, picked[:, :, 0], picked[:, :, 1])
    return n, form, chars, out, at


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


FORMS = np.array(["plain", "psm", "spm"])


def _kernel(fim: Fim):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            hashes = np.stack([batch.column(f"_h{k}").to_numpy(zero_copy_only=False) for k in range(4)]) if len(batch) else np.empty((4, 0), np.int64)
            for a, b in pieces(offsets, BATCH):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                n, form, chars, out, ends_ = transformed(part, at, hashes[:, a:b], fim)
                blank = form == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_row").slice(a, b - a), pa.array(n, pa.int64()), pa.array(FORMS[form]),
                        pa.array(chars[0], pa.int64(), mask=blank), pa.array(chars[1], pa.int64(), mask=blank), _strings(out, ends_),
                    ],
                    ["row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def _draws(doc_id: str, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the sha256 of ``<seed>:<doc_id>``, as numbers."""
    spelled = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(spelled, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fim: Fim = Fim()) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): every whole text of ``docs``, other columns inside ``row``.

    Draws depend on ``doc_id`` and the seed alone, so rows of one id are cut at the same shares of their units. A text is left as it
    is (form ``plain``) if it is empty or null (output: empty), holds a sentinel or is not among ``percent``. A null
    doc_id is drawn for as empty text. Repeated rows get equal results, an empty table gives an empty result, names may clash.
    A long text stands alone in its batch, as arrays of some fifty bytes a byte of it. Nothing is shuffled."""
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    slim = docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"), *_draws(doc_id, fim.seed))
    return slim.mapInArrow(_kernel(fim), beside(slim.schema["_row"].dataType, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(output: Column, form: Column, fim: Fim = Fim()) -> Column:
    """The text that an output of a form was made of. Sentinels are found from the left, each behind the one before it, and no
    text that holds one was transformed, so what stands between them is exact."""
    heads = {"psm": (fim.prefix, fim.suffix), "spm": (fim.suffix, fim.prefix)}

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at = F.instr(output, F.lit(second))
        rest = F.substring(output, at + len(second), F.char_length(output))
        cut = F.instr(rest, F.lit(fim.middle))
        one = F.substring(output, F.lit(len(first) + 1), at - 1 - len(first))
        return one, F.substring(rest, F.lit(1), cut - 1), F.substring(rest, cut + len(fim.middle), F.char_length(rest))

    prefix, suffix, middle = parts(*heads["psm"])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(*heads["spm"])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def restore(made: DataFrame, fim: Fim = Fim(), name: str = "restored") -> DataFrame:
    """``made``, with columns ``output`` and ``form``, and the text that each output was made of as ``name``."""
    return made.withColumn(free(name, made.columns), restored(F.col("output"), F.col("form"), fim))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:low], '') AS a, array_to_string(u[low + 1:high], '') AS b, array_to_string(u[high + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
