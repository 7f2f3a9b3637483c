"""Media columns: Netpbm (P1 to P6) and BMP decoded to arrays, area-resized by integral images, kept as NPY tiles.

decode() takes bytes, encode_pgm() and encode_bmp() give them. resize() averages over exact pixel areas,
fractions included, from an integral image. tiles() makes one row for each media value: the decoded shape,
an NPY tile and its difference hash. Bytes that are null or no known format give null results, not errors.

Texts as media: a payload of UTF-8 bytes and zeros up to a positive multiple of 64 is a PGM 64 pixels wide,
one byte a pixel, so storing is lossless; a null text is an empty one. store_texts() gives the stored forms, which belong in a
table; digests() reads such a table back.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append_columns, buffers

WIDTH = 64
#: Rows of an image that one step sums.
STRIP = 4096


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or 24-bit colour (h, w, 3), rows from the bottom, padded to 4 bytes."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = pixels if grey else pixels[:, :, ::-1].reshape(h, w * 3)
    rows = np.pad(np.ascontiguousarray(rows, np.uint8)[::-1], ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    head = np.array([40, w, h], "<u4").tobytes() + np.array([1, 8 if grey else 24], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 256 if grey else 0, 0], "<u4").tobytes()
    return b"BM" + np.array([start + rows.size, 0, start], "<u4").tobytes() + head + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, found = data[1] - 48, 2, []
    while len(found) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        found.append(int(data[at:end]))
        at = end
    w, h, top = found[0], found[1], found[2] if len(found) > 2 else 1
    depth = 3 if kind in (3, 6) else 1
    if kind == 4:
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * stride, at + 1).reshape(h, stride), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind == 1:
        digits = np.frombuffer(data, np.uint8)[at:]
        bits = digits[(digits == 48) | (digits == 49)][: w * h] - 48
        return ((1 - bits) * np.uint8(255)).astype(np.uint8).reshape(h, w)
    if kind in (5, 6):
        x = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * depth, at + 1)
    else:
        x = np.array(data[at:].split()[: w * h * depth], np.int64)
    x = x.reshape((h, w, 3) if depth == 3 else (h, w))
    return x.astype(np.uint8) if top == 255 else (x.astype(np.int64) * 255 // max(top, 1)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, size = (int(x) for x in (np.frombuffer(data, "<u4", 1, 10)[0], np.frombuffer(data, "<u4", 1, 14)[0]))
    w, h = (int(x) for x in np.frombuffer(data, "<i4", 2, 18))
    bits, packed = int(np.frombuffer(data, "<u2", 1, 28)[0]), int(np.frombuffer(data, "<u4", 1, 30)[0])
    if packed or bits not in (8, 24, 32):
        raise ValueError("BMP kind")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:: -1 if h > 0 else 1]
    if bits == 8:
        used = int(np.frombuffer(data, "<u4", 1, 46)[0]) or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
        x = palette[rows[:, :w]]
        return x[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 0] == palette[:, 2]).all() else x
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """uint8 array, (h, w) or (h, w, 3); ValueError if the bytes are neither Netpbm nor BMP or are cut short."""
    try:
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:1] == b"P" and data[1:2] in b"123456" and data[2:3].isspace():
            return _netpbm(data)
    except (IndexError, ValueError, OverflowError) as e:
        raise ValueError(f"not decoded: {e}") from e
    raise ValueError("unknown format")


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's exact area (float64, grey), by an integral image.

    The image is summed in strips; only the rows of the integral image that the target's edges need are kept.
    """
    h, w = pixels.shape[:2]
    y, x = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    need = np.unique(np.concatenate([np.minimum(y.astype(np.int64), h), np.minimum(y.astype(np.int64) + 1, h)]))
    rows, carry = np.zeros((len(need), w + 1)), np.zeros(w + 1)
    for a in range(0, h, STRIP):
        grey = pixels[a : a + STRIP].astype(np.float64)
        table = np.zeros((len(grey), w + 1))
        np.cumsum(np.cumsum(grey if grey.ndim == 2 else grey.mean(axis=2), axis=0), axis=1, out=table[:, 1:])
        table += carry
        here = (need > a) & (need <= a + len(grey))
        rows[here] = table[need[here] - a - 1]
        carry = table[-1]

    def at(edges, axis, t, place):
        low = np.minimum(edges.astype(np.int64), place[-1])
        high = np.minimum(low + 1, place[-1])
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(t, np.searchsorted(place, low), axis) * (1 - part) + np.take(t, np.searchsorted(place, high), axis) * part

    t = at(x, 1, at(y, 0, rows, need), np.arange(w + 1))
    return (t[1:, 1:] - t[:-1, 1:] - t[1:, :-1] + t[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """side*side bits in hex: whether each cell of a side x (side+1) reduction is darker than its right neighbour."""
    small = np.round(resize(pixels, side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, media: str, side: int = 32) -> DataFrame:
    """df with height, width, npy (a side x side uint8 NPY tile) and dhash; null where media can't be decoded."""

    return append_columns(df, lambda column: _tiles((v.as_py() for v in column), side), _tile_schema(), media)


def _tile_schema() -> T.StructType:
    return T.StructType().add("height", "integer").add("width", "integer").add("npy", "binary").add("dhash", "string")


def _tiles(media, side: int) -> list[pa.Array]:
    rows = []
    for v in media:
        try:
            p = decode(v or b"")
            if not p.size:
                raise ValueError("no pixels")
            rows.append((p.shape[0], p.shape[1], npy(np.rint(resize(p, side, side)).astype(np.uint8)), difference_hash(p)))
        except ValueError:
            rows.append((None, None, None, None))
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]


def store_texts(df: DataFrame, text: str = "text", side: int = 16, keep_text: bool = True) -> DataFrame:
    """df with each text's stored forms: n_bytes, pgm, and of that height, width, npy (a side x side tile) and dhash."""

    def make(column):
        raw, off = buffers(column)
        out = []
        for a, z in zip(off[:-1], off[1:], strict=True):
            payload = np.zeros(max(WIDTH, -(-(z - a) // WIDTH) * WIDTH), np.uint8)
            payload[: z - a] = raw[a:z]
            out.append(encode_pgm(payload.reshape(-1, WIDTH)))
        return [pa.array(np.diff(off)), pa.array(out, pa.binary()), *_tiles(out, side)]

    schema = T.StructType([*T.StructType().add("n_bytes", "long").add("pgm", "binary").fields, *_tile_schema().fields])
    return append_columns(df, make, schema, text, () if keep_text else (text,))


def digests(stored: DataFrame) -> DataFrame:
    """A table of store_texts, read back: its n_bytes and other columns, digests for pgm and npy, dhash as feature."""

    def make(column):
        rows = []
        for v in column:
            pgm = v.as_py()
            payload = memoryview(np.ascontiguousarray(decode(pgm))).cast("B")
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(pgm), hashlib.sha256(pgm).hexdigest()))
        return [pa.array([r[k] for r in rows], pa.string() if k in (1, 4) else pa.int64()) for k in range(5)]

    schema = T.StructType()
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string")):
        schema = schema.add(name, kind)
    done = append_columns(stored.drop("height", "width"), make, schema, "pgm", ("pgm",))
    return done.withColumn("npy_sha256", F.sha2("npy", 256)).withColumnRenamed("dhash", "feature").drop("npy")
