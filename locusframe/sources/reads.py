"""FASTA look-ups, read exports and the text report of one site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and seq of each record; lines are numbered by file and offset, which Spark keeps in order within a file."""
    rows = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    return rows.select(F.regexp_extract("value", r"\A(\S+)", 1).alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*", ""), r"\s", "")).alias("seq")).where("name <> ''")


def fetch(fasta: DataFrame, name: str, start: int, end: int) -> str:
    """Bases of [start, end), cut to the sequence."""
    start = max(0, start)
    row = fasta.where(F.col("name") == name).select(F.substring("seq", start + 1, max(0, end - start)).alias("s")).first()
    if row is None:
        raise ValueError(f"no sequence {name!r}")
    return row["s"]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def phred_text(qualities: Column) -> Column:
    """Array of qualities as Phred+33 text."""
    return F.array_join(F.transform(qualities, lambda q: F.chr(F.least(q, F.lit(93)) + 33)), "")


def alt_reads(reads: DataFrame, alt: str, strand: str = "rev", include_ref: int = 0, ref: str | None = None) -> DataFrame:
    """Reads that show the ALT base on the wanted strand, and at most include_ref that show REF, by name."""
    side = F.lit(True) if strand == "both" else F.col("strand") == strand
    found = reads.where(side & (F.col("base") == alt))
    if include_ref and ref is not None:
        rank = F.row_number().over(Window.partitionBy("sample").orderBy("read"))
        found = found.unionByName(reads.where(side & (F.col("base") == ref)).withColumn("_rn", rank).where(F.col("_rn") <= include_ref).drop("_rn"))
    return found


def fastq_lines(reads: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """One FASTQ record a row (read, seq, array of qualities); write it with write.text."""
    return reads.select(F.concat(F.lit("@"), "read", F.lit("\n"), F.col(seq), F.lit("\n+\n"), phred_text(F.col(qual))).alias("value"))


def text_histogram(values: list[int], width: int = 40, bins: int = 10) -> list[str]:
    """Bars over equal ranges of the values."""
    if not values:
        return []
    low, high = min(values), max(values)
    step = max(1, -(-(high - low + 1) // bins))
    counts = [0] * (-(-(high - low + 1) // step))
    for v in values:
        counts[(v - low) // step] += 1
    top = max(counts)
    return [f"{low + i * step:>5}-{low + (i + 1) * step - 1:<5} {'#' * round(width * c / top)} {c}" for i, c in enumerate(counts)]


def site_report(summary: DataFrame, cycles: list[int] | None = None, title: str = "") -> str:
    """Text of a one-row-a-sample summary."""
    lines = [title] if title else []
    for row in summary.orderBy("sample").collect():
        lines.append(f"sample {row['sample']}")
        for key, value in row.asDict().items():
            if key != "sample":
                lines.append(f"  {key.replace('_', ' ')}: {'-' if value is None else f'{value:.2f}' if isinstance(value, float) else value}")
    return "\n".join([*lines, *text_histogram(cycles or [])])
