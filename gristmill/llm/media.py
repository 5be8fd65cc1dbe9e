"""Media columns: payloads as PNG files in binary columns, read back with checks, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A private, ancillary, safe-to-copy chunk with the payload's length before padding.
LENGTH = b"gmLn"
WIDTH = 192


class DamagedImage(ValueError):
    """The bytes aren't a whole PNG of the kind written here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    left = np.pad(rows, ((0, 0), (1, 0)))[:, :-1].astype(np.int16)
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1].astype(np.int16)
    corner = np.pad(rows, ((1, 0), (1, 0)))[:-1, :-1].astype(np.int16)
    if kind == 4:
        base = left + up - corner
        a, b, c = abs(base - left), abs(base - up), abs(base - corner)
        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    else:
        guess = [np.zeros_like(left), left, up, (left + up) // 2][kind]
    return ((rows - guess) & 255).astype(np.uint8)


def encode_png(payload: bytes, width: int = WIDTH, kind: int = 0, level: int = 6) -> bytes:
    """``payload``, padded by spaces to a positive multiple of ``width``, as 8-bit grey samples; ``kind`` is
    the row filter (0 suits text best)."""
    padded = payload.ljust(max(width, -(-len(payload) // width) * width), b" ")
    rows = np.frombuffer(padded, np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = _filtered(rows, kind) if kind else rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(LENGTH, struct.pack(">Q", len(payload))) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _by_diagonals(rows: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Undo Average (3) or Paeth (4): the samples of a diagonal depend only on the two diagonals before it."""
    n, width = rows.shape
    out = np.zeros((n + 1, width + 1), np.int16)
    out[0, 1:], out[1:, 1:] = above, rows
    for d in range(n + width - 1):
        y = np.arange(max(0, d - width + 1), min(n, d + 1)) + 1
        x = d + 2 - y
        a, b, c = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
        if kind == 3:
            guess = (a + b) // 2
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        out[y, x] = (out[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undo row filters: runs of the first three kinds at once, Average and Paeth by diagonals."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise DamagedImage("unknown row filter")
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(rows)]
    for lo, hi in zip(edges, edges[1:]):
        kind = kinds[lo]
        above = rows[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            rows[lo:hi] = np.cumsum(rows[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            rows[lo:hi] = np.cumsum(np.vstack([above[None], rows[lo:hi]]), axis=0, dtype=np.uint8)[1:]
        elif kind > 2:
            rows[lo:hi] = _by_diagonals(rows[lo:hi], above, kind)
    return rows


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """The samples, a row per image row, and the payload's length; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise DamagedImage("no PNG signature")
    at, parts, head, length, ended = 8, [], None, None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise DamagedImage("cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise DamagedImage(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == LENGTH:
            (length,) = struct.unpack(">Q", body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended or at != len(data) or head[2:] != (8, 0, 0, 0, 0):
        raise DamagedImage("not a whole 8-bit grey image")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(parts), bufsize=height * (width + 1))
    except zlib.error as e:
        raise DamagedImage(str(e)) from e
    if len(raw) != height * (width + 1):
        raise DamagedImage("wrong number of samples")
    rows = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))
    return rows, rows.size if length is None else length


@lru_cache
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None] / n)


@lru_cache(4096)
def _cuts(n: int, size: int) -> np.ndarray:
    return np.arange(size) * n // size


def cosine_hash(rows: np.ndarray, size: int = 32, low: int = 8) -> str:
    """64 bits in hex: the ``low`` x ``low`` lowest frequencies of the cosine transform of the image, scaled to
    ``size`` x ``size`` by cell means, each against their median without the constant term."""
    small = rows.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        if n >= size:
            cuts = _cuts(n, size)
            counts = np.diff(np.append(cuts, n))
            small = np.add.reduceat(small, cuts, axis=axis) / (counts[:, None] if axis == 0 else counts[None])
        else:
            small = np.take(small, np.arange(size) * n // size, axis=axis)
    waves = _cosines(size, low)
    found = (waves @ small @ waves.T).ravel()
    bits = found > np.median(found[1:])
    return np.packbits(bits).tobytes().hex()


def encode_media(docs: DataFrame, text_col: str = "text", media_col: str = "media", kind: int = 0) -> DataFrame:
    """Replaces the text by a PNG of its UTF-8 bytes in the binary column ``media_col``; null is empty.  Other
    columns stay; an input column named like ``media_col`` is replaced.  Equal texts get equal bytes."""
    keep = [c for c in docs.columns if c.lower() not in (text_col.lower(), media_col.lower())]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(media_col))
    schema = StructType([*rows.schema.fields[:-1], StructField(media_col, BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [encode_png((t or "").encode(), kind=kind) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(images, pa.binary())], names=[*keep, media_col])

    return rows.mapInArrow(encode, schema)


#: What reading a stored image gives.
FEATURES = [("n_bytes", LongType()), ("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("media_bytes", LongType()), ("media_sha256", StringType()), ("feature", StringType())]


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads stored images back, testing all checksums (DamagedImage otherwise), and replaces each by
    n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes, media_sha256 and
    feature.  A null image gives nulls.  Input columns of these names are replaced."""
    names = {n for n, _ in FEATURES}
    keep = [c for c in media.columns if c.lower() not in names | {media_col.lower()}]
    rows = media.select(*(F.col(f"`{c}`") for c in keep), F.col(media_col))
    schema = StructType([*rows.schema.fields[:-1], *(StructField(n, t) for n, t in FEATURES)])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(FEATURES)
        image, length = decode_png(data)
        payload = image.tobytes()
        return length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], names=[*keep, *(n for n, _ in FEATURES)])

    return rows.mapInArrow(decode, schema)
