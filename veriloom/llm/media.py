"""Media columns: texts as lossless PNG images in binary columns, with perceptual hashes.

The bytes of a text become the samples of an 8-bit greyscale image, 64 samples a row.
The codec writes the PNG chunks itself (signature, IHDR, IDAT deflated by zlib, IEND),
and the reader tests every chunk's CRC-32, inflates and undoes the row filters with numpy.
The feature is the sign pattern of the low-frequency block of a cosine transform of the
image shrunk to 32 by 32.

Defined results: a null or empty text is one row of 64 zero samples; equal texts give equal
values; repeated rows are kept, one result each; an empty table gives no rows; other columns
of the input, whatever their names, are not looked at. Memory: one text and its image at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from veriloom.llm.common import arrow_map, arrow_schema, small_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of the row width; their number unpadded."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """Greyscale PNG; each row takes the filter among none, sub and up with the least absolute sum."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = image.copy()
    sub[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    forms = (image, sub, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in forms])
    kind = cost.argmin(axis=0).astype(np.uint8)
    lines = np.empty((len(image), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], image, np.where((kind == 1)[:, None], sub, up))
    header = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters of 8-bit greyscale. Runs of rows of one kind go at once where numpy allows."""
    out = np.zeros_like(rows)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(rows)]
    above = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(edges, edges[1:], strict=False):
        if a == b:
            continue
        kind = int(kinds[a])
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                left = corner = 0
                over, line = (out[i - 1] if i else above).tolist(), []
                for x, up in zip(rows[i].tolist(), over, strict=True):
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    left, corner = (x + guess) & 255, up
                    line.append(left)
                out[i] = line
        else:
            raise ValueError(f"unknown row filter {kind}")
        above = out[b - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG without interlacing; ValueError on a damaged file."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, size, ended = 8, [], None, False
    while at < len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(chunk) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(chunk, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlacing")
            size = (height, width)
        elif kind == b"IDAT":
            body.append(chunk)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("truncated PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[0], size[1] + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


_C = _cosines()


def _shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n < SIDE:
        return np.take(image, np.arange(SIDE) * n // SIDE, axis=axis)
    cuts = np.arange(SIDE) * n // SIDE
    return np.add.reduceat(image, cuts, axis=axis) / np.diff([*cuts, n]).reshape([-1 if i == axis else 1 for i in range(2)])


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: signs of the low-frequency coefficients against their median."""
    small = _shrunk(_shrunk(image.astype(np.float64), 1), 0)
    low = (_C @ small @ _C.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


MEDIA = "doc_id long, n_bytes long, media binary, media_hash binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, the PNG and its hash as binary columns."""
    small_batches(df.sparkSession)

    def rows(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        coded = [payload_of(t) for t in texts]
        media = [encode_png(p) for p, _ in coded]
        return {"doc_id": ids, "n_bytes": [n for _, n in coded], "media": media, "media_hash": [cosine_hash(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p, _ in coded]}

    return arrow_map(df.select(key, text), rows, arrow_schema(MEDIA), MEDIA)


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored images back and sums them up."""

    def rows(batch):
        out = {c.split()[0]: [] for c in DIGEST.split(", ")}
        for doc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            image = decode_png(data)
            payload = image.tobytes()
            values = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image).hex())
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return out

    return arrow_map(media.select("doc_id", "n_bytes", "media"), rows, arrow_schema(DIGEST), DIGEST)
