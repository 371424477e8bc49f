"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end holds the seek table of
the public seekable format (sizes of every frame), and the bundle's index maps each record to its
frame and to its place in that frame, so one record is read by unpacking one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import map_batches

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BUNDLE = "bundle_id string, archive binary, records array<struct<record_id:string,page_id:long,frame:int,offset:long,length:long>>"


class WarcError(ValueError):
    """A bundle or record fails one of its tests."""


class BundleWriter:
    """Frames of about frame_bytes of whole records; take() closes the bundle."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 3) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self._clear()

    def _clear(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.open: list[bytes] = []
        self.filled = self.raw = 0

    def _flush(self) -> None:
        if self.open:
            data = self.packer.compress(b"".join(self.open))
            self.frames.append(data)
            self.sizes.append((len(data), self.filled))
            self.open, self.filled = [], 0

    def add(self, record_id: str, page_id: int | None, record: bytes) -> None:
        self.index.append((record_id, page_id, len(self.frames), self.filled, len(record)))
        self.open.append(record)
        self.filled += len(record)
        self.raw += len(record)
        if self.filled >= self.frame_bytes:
            self._flush()

    def take(self) -> tuple[bytes, list[tuple]]:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        archive, index = b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table]), self.index
        self._clear()
        return archive, index


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, packed size and plain size of every frame, from the footer."""
    if len(archive) < 17:
        raise WarcError("no seek table")
    n, flags, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
    entry = 12 if flags & 0x80 else 8
    start = len(archive) - 9 - n * entry
    if magic != FOOTER or start < 8 or struct.unpack_from("<II", archive, start - 8) != (SKIPPABLE, n * entry + 9):
        raise WarcError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", archive, start + i * entry)
        out.append((at, packed, plain))
        at += packed
    if at != start - 8:
        raise WarcError("frames do not fill the bundle")
    return out


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, plain = frame
    data = zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=plain)
    if len(data) != plain:
        raise WarcError("frame size")
    return data


def read_record(archive: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry; only its frame is unpacked."""
    return read_frame(archive, seek_table(archive)[frame])[offset : offset + length]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    """Of a page and its payload: pages under one id, or none, have ids of their own; rows that are equal are one record twice."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id}:{payload_digest}'.encode()).digest())}"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> tuple[str, bytes]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, sha1 = http if revisit else http + payload, digest(payload)
    rid = record_id(page_id, sha1)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{rid}>", "WARC-Date": date, "WARC-Target-URI": "".join((url or "").split()),
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1}", "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to, sha1)}>"} | ({} if refers_to is None else {"X-Refers-To-Page-ID": str(refers_to)})
    head["Content-Length"] = str(len(block))
    return rid, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the end of the record that starts at `at`."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise WarcError("record head")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise WarcError("record end")
    return head, data[end + 4 : stop], stop + 4


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to.

    Null html is an empty payload. Of equal payloads of min_bytes or more the largest page_id is the
    response (all rows that share it, where ids repeat; null ids are smallest); the others refer to it.
    Digests are counted before the join, and a digest that many pages share is on the many side of
    a join with one row a digest, which AQE splits.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    key = F.sha2("payload", 256)
    held = pages.select("page_id", F.sha2(F.coalesce(F.col("html").cast("binary"), F.lit(b"")), 256).alias("key")).groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")) & (F.length("payload") >= min_bytes)
    return rows.withColumn("key", key).join(held, "key", "left").select("page_id", "url", "payload", other.alias("revisit"), F.when(other, F.col("holder")).alias("refers_to"))


def write_bundles(marked: DataFrame, bundle_bytes: int = 1 << 24, frame_bytes: int = 1 << 18, level: int = 3) -> DataFrame:
    """Bundles of about bundle_bytes of records, one row each: bundle_id, archive, records (the index).

    A revisit has the record id of the response it refers to, which follows from its page_id and the payload.
    Repeated rows are written as often as they occur, under one record id with a place each; an empty table has no bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(frame_bytes, level)

        def close() -> pa.RecordBatch:
            archive, index = writer.take()
            entries = [dict(zip(("record_id", "page_id", "frame", "offset", "length"), e, strict=True)) for e in index]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(archive).hexdigest()[:32]]), pa.array([archive], pa.binary()), pa.array([entries], kind)], ["bundle_id", "archive", "records"])

        for batch in batches:
            for page, url, payload, revisit, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rid, record = make_record(page, url, payload, refers, revisit)
                writer.add(rid, page, record)
                if writer.raw >= bundle_bytes:
                    yield close()
        if writer.index:
            yield close()

    return map_batches(marked.select("page_id", "url", "payload", "revisit", "refers_to"), run, BUNDLE)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row a record, parsed from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The payload of a revisit is null: it is with the record it refers to. Digests of stored payloads
    and the places in the index are tested."""

    def records(archive: bytes, index: list[dict]) -> Iterable[tuple]:
        places = iter(index)
        for number, frame in enumerate(seek_table(archive)):
            data, at = read_frame(archive, frame), 0
            while at < len(data):
                head, block, end = parse_record(data, at)
                place = next(places)
                if (place["frame"], place["offset"], place["length"]) != (number, at, end - at):
                    raise WarcError("index")
                stored = head["WARC-Type"] == "response"
                payload = block.partition(b"\r\n\r\n")[2] if stored else None
                want = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if stored and digest(payload) != want:
                    raise WarcError("payload digest")
                page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                yield page and int(page), int(head["X-Payload-Length"]), want, head["WARC-Type"], refers and int(refers), head["WARC-Target-URI"], payload
                at = end

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0), batch.column(1), strict=True):
                rows = list(records(archive.as_py(), index.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(bundles.select("archive", "records"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 in SQL: five hex digits are four characters of five bits.
_BASE32 = " || ".join(f"substr('{_ALPHABET}', CAST((('0x' || substr(hex40, {1 + 5 * chunk}, 5))::BIGINT >> {shift}) & 31 AS BIGINT) + 1, 1)" for chunk in range(8) for shift in (15, 10, 5, 0))

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex40, max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM holder THEN NULL ELSE holder END AS refers_to FROM d
"""
