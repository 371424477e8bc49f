"""Media columns: byte payloads as greyscale PNG images, and low-frequency cosine hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import map_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
_IDAT = 1 << 20


class MediaError(ValueError):
    """A stored image fails one of its tests."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 3) -> bytes:
    """An (h, w) array of bytes as an 8-bit greyscale PNG; rows carry filter type 0."""
    h, w = samples.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = samples
    body = zlib.compress(raw.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + _IDAT]) for i in range(0, len(body), _IDAT)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _paeth_row(line: np.ndarray, above: np.ndarray) -> None:
    left = corner = 0
    for x, (value, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        left = (value + (left if a <= b and a <= c else up if b <= c else corner)) & 255
        line[x], corner = left, up


def unfilter(raw: np.ndarray, width: int) -> np.ndarray:
    """Undo the five row filters; runs of rows with one filter among 0, 1 and 2 are done at once."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown filter type")
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        if a == b:
            continue
        kind, above = kinds[a], out[a - 1] if a else np.zeros(width, np.uint8)
        if kind == 1:
            np.add.accumulate(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            out[a] += above
            np.add.accumulate(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind == 3:
            for y in range(a, b):
                left, line = 0, out[y]
                for x in range(width):
                    left = line[x] = (int(line[x]) + (left + int(above[x])) // 2) & 255
                above = line
        elif kind == 4:
            for y in range(a, b):
                _paeth_row(out[y], above)
                above = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("truncated chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or at + 12 + size > len(data):
            raise MediaError("truncated chunk")
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not an ended 8-bit greyscale image")
    w, h = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != h * (w + 1):
        raise MediaError("sample count")
    return unfilter(raw.reshape(h, w + 1), w)


def _cosines(low: int, n: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(low)[:, None] / n)


_DCT = _cosines(8, 32)


def _shrink(samples: np.ndarray, n: int = 32) -> np.ndarray:
    """Area means on an n x n grid; fewer than n rows or columns are repeated."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        size = out.shape[axis]
        edges = np.arange(n) * size // n
        if size < n:
            out = np.take(out, edges, axis=axis)
        else:
            count = np.diff(np.append(edges, size))
            out = np.add.reduceat(out, edges, axis=axis) / (count[:, None] if axis == 0 else count)
    return out


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients lie above their median (the mean's own left out)."""
    low = np.round(_DCT @ _shrink(samples) @ _DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def pack(text: bytes) -> np.ndarray:
    """The text with bytes 0 up to a positive multiple of 64, as rows of 64 samples."""
    padded = np.zeros(max(1, -(-len(text) // WIDTH)) * WIDTH, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return padded.reshape(-1, WIDTH)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (PNG). Null texts count as empty: one row of zero samples. One row a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(pack(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the stored images hold: payload length, SHA-256, CRC-32 of the last 64 bytes, cosine hash (binary)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for stored in batch.column(2).to_pylist():
                samples = decode_png(stored)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])

    return map_batches(media, run, schema)
