"""BAM files without native libraries: BGZF blocks, alignment records, CIGAR walks, one task a file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.shipping import ship

UNMAPPED, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY, REVERSE = 0x4, 0x100, 0x200, 0x400, 0x800, 0x10
#: Base codes and CIGAR operations of the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def bgzf_blocks(data: bytes) -> Iterator[bytes]:
    """Plain bytes of each member of a blocked gzip file; a member states its size, so the rest is never copied."""
    view, at = memoryview(data), 0
    while at < len(view):
        size = _member_size(view, at)
        member = zlib.decompressobj(31)
        plain = member.decompress(view[at : at + size] if size else view[at:])
        if not member.eof:
            raise ValueError("truncated BGZF member")
        at = at + size if size else len(view) - len(member.unused_data)
        if plain:
            yield plain


def _member_size(data: memoryview, at: int) -> int:
    """Size of the gzip member at `at` by its BC field, 0 if it has none."""
    if len(data) < at + 18 or not data[at + 3] & 4:
        return 0
    field, stop = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while field + 4 <= stop:
        size = struct.unpack_from("<H", data, field + 2)[0]
        if bytes(data[field : field + 2]) == b"BC":
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return 0


def resolve_engine(name: str = "auto", min_baseq: int = 0) -> str:
    """The depth engine that runs. There is one, which reads every base (`pysam` names the same counting); the fragment
    counting of `mosdepth` is not here, so that name is an error rather than another result."""
    if name in ("auto", "native", "pysam"):
        return "native"
    if name == "mosdepth":
        raise ValueError("engine mosdepth cannot apply a base quality floor" if min_baseq else "engine mosdepth is not available; use auto")
    raise ValueError(f"unknown engine: {name}")


class BamReader:
    """Reference names and lengths, and alignments one by one."""

    def __init__(self, data: bytes) -> None:
        self.blocks, self.buffer = bgzf_blocks(data), bytearray()
        if self._take(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        self._take(self._int())
        self.references: list[tuple[str, int]] = []
        for _ in range(self._int()):
            name = self._take(self._int())[:-1].decode()
            self.references.append((name, self._int()))

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            block = next(self.blocks, None)
            if block is None:
                return False
            self.buffer += block
        return True

    def _take(self, n: int) -> bytes:
        if not self._fill(n):
            raise ValueError("truncated BAM file")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def _int(self) -> int:
        return struct.unpack("<i", self._take(4))[0]

    def __iter__(self) -> Iterator[dict]:
        while self._fill(4):
            yield self._record(self._take(self._int()))

    def _record(self, raw: bytes) -> dict:
        ref, pos, name_size, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
        at = 32 + name_size
        cigar = [(OPS[c & 15], c >> 4) for c in struct.unpack_from(f"<{n_cigar}I", raw, at)]
        at += 4 * n_cigar
        packed = raw[at : at + (n_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
        at += (n_seq + 1) // 2
        return {"name": raw[32 : 32 + name_size - 1].decode(), "ref": ref, "pos": pos, "mapq": mapq, "flag": flag, "cigar": cigar, "seq": seq, "qual": raw[at : at + n_seq], "has_sa": b"SAZ" in raw[at + n_seq :]}


def aligned_blocks(record: dict, min_baseq: int = 0) -> Iterator[tuple[int, int]]:
    """Reference intervals a read's bases lie on, cut at bases below min_baseq."""
    ref, query = record["pos"], 0
    for op, n in record["cigar"]:
        if op in "M=X":
            if min_baseq <= 0:
                yield ref, ref + n
            else:
                start = None
                for k in range(n):
                    good = record["qual"][query + k] >= min_baseq
                    if good and start is None:
                        start = ref + k
                    elif not good and start is not None:
                        yield start, ref + k
                        start = None
                if start is not None:
                    yield start, ref + n
        ref += n if op in "MDN=X" else 0
        query += n if op in "MIS=X" else 0


def pileup_row(record: dict, pos0: int) -> dict | None:
    """What a read shows at a position; None where it has no base there."""
    ref, query = record["pos"], 0
    for op, n in record["cigar"]:
        if op in "M=X" and ref <= pos0 < ref + n:
            break
        ref += n if op in "MDN=X" else 0
        query += n if op in "MIS=X" else 0
    else:
        return None
    q, size, reverse = query + pos0 - ref, len(record["seq"]), bool(record["flag"] & REVERSE)
    clip = [n if op == "S" else 0 for op, n in (record["cigar"][0], record["cigar"][-1])]
    five, three = clip[::-1] if reverse else clip
    span = sum(n for op, n in record["cigar"] if op in "MDN=X")
    cycle = size - 1 - q if reverse else q
    start = record["pos"] + span - 1 if reverse else record["pos"]
    return {
        "read": record["name"], "strand": "rev" if reverse else "fwd", "base": record["seq"][q], "bq": record["qual"][q], "mapq": record["mapq"], "seq_cycle": cycle, "dist_nearest_end": min(q, size - 1 - q), "read_len": size,
        "sc_5p": five, "sc_3p": three, "has_sa": record["has_sa"], "seq_start": start, "seq_start_ext": start + five if reverse else start - five,
    }


def _files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Contents of the files by sample; a file is one row, so one task's memory bounds its size."""
    ship(spark)
    frames = [spark.read.format("binaryFile").load(path).select(F.lit(sample).alias("sample"), "content") for sample, path in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_alignments(spark: SparkSession, paths: dict[str, str], min_mapq: int = 0, min_baseq: int = 0) -> DataFrame:
    """Aligned blocks (sample, chrom, start, end) of usable reads: mapped, primary, passing, no duplicates."""
    skip = UNMAPPED | SECONDARY | QCFAIL | DUPLICATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader, rows = BamReader(content.as_py()), []
                for r in reader:
                    if r["flag"] & skip or r["mapq"] < min_mapq or r["ref"] < 0:
                        continue
                    rows += [(sample, reader.references[r["ref"]][0], a, b) for a, b in aligned_blocks(r, min_baseq)]
                    if len(rows) >= 50_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["sample", "chrom", "start", "end"])

    return _files(spark, paths).mapInArrow(run, "sample string, chrom string, start long, end long")


def reference_lengths(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length from the header."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                names, sizes = zip(*BamReader(content.as_py()).references, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["chrom", "length"])

    return _files(spark, {"": path}).mapInArrow(run, "chrom string, length long")


PILEUP = "sample string, read string, strand string, base string, bq int, mapq int, seq_cycle int, dist_nearest_end int, read_len int, sc_5p int, sc_3p int, has_sa boolean, seq_start long, seq_start_ext long"


def pileup(spark: SparkSession, paths: dict[str, str], chrom: str, pos0: int, min_mapq: int = 0) -> DataFrame:
    """One row for each usable primary read with a base at the position."""
    skip = UNMAPPED | SECONDARY | SUPPLEMENTARY | QCFAIL | DUPLICATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader, rows = BamReader(content.as_py()), []
                for r in reader:
                    if r["flag"] & skip or r["mapq"] < min_mapq or r["ref"] < 0 or reader.references[r["ref"]][0] != chrom:
                        continue
                    if (row := pileup_row(r, pos0)) is not None:
                        rows.append({"sample": sample} | row)
                yield pa.RecordBatch.from_pylist(rows, schema=_PILEUP_ARROW)

    return _files(spark, paths).mapInArrow(run, PILEUP)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_PILEUP_ARROW = pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in PILEUP.split(", "))])


def summarise_reads(reads: DataFrame, alt: str, ref: str) -> DataFrame:
    """Per sample: strand counts, ALT share by strand, base quality, cycle and clipping of the ALT reads on the reverse strand."""
    a, r = F.col("base") == alt, F.col("base") == ref
    on = lambda strand: F.col("strand") == strand
    rev = a & on("rev")
    pick = lambda c: F.when(rev, F.col(c))
    share = lambda x, y: F.try_divide(100.0 * F.count_if(x), F.count_if(y))
    return reads.groupBy("sample").agg(
        *[F.count_if(x & on(s)).alias(f"{n}_{s}") for n, x in (("ref", r), ("alt", a)) for s in ("fwd", "rev")],
        *[share(a & on(s), (a | r) & on(s)).alias(f"vaf_{s}_pct") for s in ("fwd", "rev")],
        F.median(pick("bq")).alias("bq_median"), F.min(pick("bq")).alias("bq_min"), F.max(pick("bq")).alias("bq_max"), share(rev & (F.col("bq") < 20), rev).alias("bq_below_20_pct"),
        F.median(pick("seq_cycle")).alias("cycle_median"), F.min(pick("seq_cycle")).alias("cycle_min"), F.max(pick("seq_cycle")).alias("cycle_max"), share(rev & (F.col("dist_nearest_end") < 10), rev).alias("near_end_pct"),
        share(rev & ((F.col("sc_5p") > 0) | (F.col("sc_3p") > 0)), rev).alias("soft_clip_pct"), share(rev & F.col("has_sa"), rev).alias("sa_pct"), F.mode(pick("seq_start"), deterministic=True).alias("modal_start"),
    )
