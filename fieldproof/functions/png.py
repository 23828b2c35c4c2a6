"""PNG in numpy, for tasks that look at images: rows of bytes in and out, and the part of an image between two rows.

All bit depths and colour types are read. The five row filters are undone together: a pixel needs its neighbours to the
left, above and above left, so all pixels of an anti-diagonal are made in one step, whatever the filter of their row.
Interlaced images are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of each colour type, and the bit depths of each.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Parts that tell what the pixels' values mean, and so go with them.
MEANING = (b"PLTE", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"sBIT")
#: No image has more bytes of pixels than this; what claims to is refused before it is unpacked.
MOST = 1 << 28
#: Bytes of pixels of images that are filtered together, unless one has more.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Image:
    """``rows``: the bytes of each row of pixels, packed as in the file, without filters."""

    width: int
    height: int
    depth: int
    colour: int
    rows: np.ndarray
    meaning: tuple[tuple[bytes, bytes], ...] = ()


def _parts(data: bytes):
    at = len(MAGIC)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a part of the PNG is damaged")
        yield kind, body
        at += 12 + size


def unfiltered(filters: np.ndarray, raw: np.ndarray, step: int) -> np.ndarray:
    """The rows that ``raw`` (height x bytes a row) was filtered from; ``step``: bytes a pixel, at least 1. Both may have one
    dimension more, before the others, for images of one shape: these are undone together."""
    if filters.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    *many, height, width = raw.shape
    if not filters.any():
        return raw
    columns = -(-width // step)
    pixels = np.zeros((*many, height, columns * step), np.uint8)
    pixels[..., :width] = raw
    # rows first: a step then takes whole planes of images
    pixels = np.moveaxis(pixels.reshape(-1, height, columns, step), 0, 2).copy()
    kind = np.moveaxis(filters.reshape(-1, height), 0, 1)
    shown = lambda: np.moveaxis(pixels, 2, 0).reshape(*many, height, columns * step)[..., :width]
    if filters.max() <= 2:
        # rows without filter, or that need one neighbour: sums of bytes, row by row
        for y in range(height):
            left, up = kind[y] == 1, kind[y] == 2
            if left.any():
                pixels[y][:, left] = np.cumsum(pixels[y][:, left], 0, np.uint8)
            if y and up.any():
                pixels[y][:, up] += pixels[y - 1][:, up]
        return shown()
    count = pixels.shape[2]
    # what each pixel's guess takes: the left one, the upper one, their mean or the nearest
    takes = [(kind == k)[..., None].astype(np.int16) for k in (1, 2, 3, 4)]
    before, last = np.zeros((height, count, step), np.int16), np.zeros((height, count, step), np.int16)  # the two diagonals before
    rows = np.arange(height)
    down = lambda x: np.concatenate([np.zeros((1, count, step), np.int16), x[:-1]])
    for d in range(height + columns - 1):
        y = rows[max(0, d - columns + 1) : d + 1]
        at = slice(y[0], y[-1] + 1)
        a, b, c = last[at], down(last)[at], down(before)[at]
        p = a + b - c
        pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = takes[0][at] * a + takes[1][at] * b + takes[2][at] * ((a + b) >> 1) + takes[3][at] * paeth
        now = np.zeros((height, count, step), np.int16)
        now[at] = (pixels[y, d - y] + guess) & 255
        pixels[y, d - y] = now[at]
        before, last = last, now
    return shown()


def _unpacked(data: bytes) -> tuple[Image, np.ndarray]:
    """An image whose rows are still filtered, and their filters."""
    if not data.startswith(MAGIC):
        raise ValueError("not a PNG image")
    head, packed, meaning = None, [], []
    for kind, body in _parts(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind in MEANING:
            meaning.append((kind, body))
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("the PNG has no header")
    width, height, depth, colour, _, _, interlaced = head
    if width < 1 or height < 1 or depth not in DEPTHS.get(colour, ()):
        raise ValueError("the PNG's header is wrong")
    if interlaced:
        raise ValueError("interlaced PNG images can't be cropped")
    stride = -(-width * depth * SAMPLES[colour] // 8)
    if (stride + 1) * height > MOST:
        raise ValueError("the image is too large")
    unpacker = zlib.decompressobj()
    raw = unpacker.decompress(b"".join(packed), (stride + 1) * height)
    if len(raw) < (stride + 1) * height:
        raise ValueError("the PNG ends too early")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    return Image(width, height, depth, colour, lines[:, 1:], tuple(meaning)), lines[:, 0]


def _step(image: Image) -> int:
    return max(1, image.depth * SAMPLES[image.colour] // 8)


def _alike(images: list[Image]) -> Iterator[list[int]]:
    """Places of images of one shape, in groups of few pixels, or of one image."""
    by: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        by.setdefault((*image.rows.shape, _step(image)), []).append(i)
    for (height, stride, _), places in by.items():
        most = max(1, TOGETHER // (height * stride))
        yield from (places[a : a + most] for a in range(0, len(places), most))


def decode(data: bytes) -> Image:
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[Image]:
    """The images of files, which are all held at once; filters are undone for all images of a shape together."""
    found = [_unpacked(data) for data in files]
    out = [image for image, _ in found]
    for places in _alike(out):
        rows = unfiltered(np.stack([found[i][1] for i in places]), np.stack([out[i].rows for i in places]), _step(out[places[0]]))
        for i, made in zip(places, rows, strict=True):
            x = out[i]
            out[i] = Image(x.width, x.height, x.depth, x.colour, made, x.meaning)
    return out


def filtered(rows: np.ndarray, step: int, filters: np.ndarray) -> np.ndarray:
    """``rows`` with the filter of each applied, all rows at once, and those of all images, if there is a dimension before."""
    a = np.zeros(rows.shape, np.int16)
    a[..., step:] = rows[..., :-step] if step < rows.shape[-1] else 0
    b = np.zeros(rows.shape, np.int16)
    b[..., 1:, :] = rows[..., :-1, :]
    c = np.zeros(rows.shape, np.int16)
    c[..., 1:, :] = a[..., :-1, :]
    p = a + b - c
    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    kind = filters[..., None]
    return ((rows - np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, paeth], 0)) & 255).astype(np.uint8)


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


END = _part(b"IEND", b"")


def encode(image: Image, filters: np.ndarray | None = None) -> bytes:
    """The image as a file. The same image gives the same bytes; ``filters``, one for each row, are 0 unless given."""
    return encode_all([image], None if filters is None else [filters])[0]


def encode_all(images: list[Image], filters: list[np.ndarray] | np.ndarray | None = None) -> list[bytes]:
    """Each image as a file, as ``encode`` makes it; filters are applied to all images of a shape together."""
    out = [b""] * len(images)
    for places in _alike(images):
        rows = np.stack([images[i].rows for i in places])
        used = np.zeros(rows.shape[:2], np.uint8) if filters is None else np.stack([filters[i] for i in places]).astype(np.uint8)
        rows = filtered(rows, _step(images[places[0]]), used) if used.any() else rows
        for i, lines in zip(places, np.concatenate([used[..., None], rows], 2), strict=True):
            x = images[i]
            head = struct.pack(">IIBBBBB", x.width, x.height, x.depth, x.colour, 0, 0, 0)
            # a palette stands before what refers to it
            meaning = sorted(x.meaning, key=lambda m: (m[0] == b"tRNS", m[0] == b"PLTE"))
            out[i] = MAGIC + _part(b"IHDR", head) + b"".join(_part(*m) for m in meaning) + _part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + END
    return out


def between(image: Image, top: int, bottom: int) -> Image:
    """The rows [top, bottom), in full width."""
    if not 0 <= top < bottom <= image.height:
        raise ValueError("the box leaves the image")
    return Image(image.width, bottom - top, image.depth, image.colour, image.rows[top:bottom], image.meaning)
