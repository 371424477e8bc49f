"""Coordinates: 0-based half-open intervals, chromosome spelling, SNP labels and their stamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what tables keyed by SNP carry in their first line.
STAMP = "#snp_coord_system=0-based"
#: Prefixes of chromosome names that are stripped, in this order.
CHROM_PREFIXES = ("Pf3D7_", "PvP01_", "Pf_")
#: Chromosome lengths of P. falciparum 3D7 and base pairs a centimorgan.
PF3D7_LENGTHS = {
    "1": 640851, "2": 947102, "3": 1067971, "4": 1200490, "5": 1343557, "6": 1418242, "7": 1445207,
    "8": 1472805, "9": 1541735, "10": 1687656, "11": 2038340, "12": 2271494, "13": 2925236, "14": 3291936,
}
BP_PER_CM = 15_000.0


class CoordinateError(ValueError):
    """A table does not state 0-based coordinates."""


def normalise_chr(chrom: Column) -> Column:
    """Bare chromosome name: a known prefix goes with all from the next underscore on, then 'chr' and leading zeros."""
    text = chrom.cast("string")
    out = text
    for prefix in reversed(CHROM_PREFIXES):
        out = F.when(text.startswith(prefix), F.substring_index(F.substring(text, len(prefix) + 1, 1 << 20), "_", 1)).otherwise(out)
    bare = F.regexp_replace(F.replace(out, F.lit("chr"), F.lit("")), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def snp_label(chrom: Column, pos0: Column) -> Column:
    return F.concat_ws(":", chrom, pos0.cast("string"))


def parse_label(label: Column) -> tuple[Column, Column]:
    """(chrom, pos0) split at the last colon; 'unknown' and -1 where there is none."""
    match = label.rlike(r"^.*:\d+$")
    chrom = F.when(match, F.regexp_extract(label, r"^(.*):(\d+)$", 1)).otherwise(F.lit("unknown"))
    return chrom, F.when(match, F.regexp_extract(label, r"^(.*):(\d+)$", 2).cast("long")).otherwise(F.lit(-1).cast("long"))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start < hi) & (end > lo)


def overlap_span(start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    return F.greatest(start, lo), F.least(end, hi)


def contains(pos0: Column, lo: Column, hi: Column) -> Column:
    return (pos0 >= lo) & (pos0 < hi)


def vcf_pos(pos0: Column) -> Column:
    return pos0 + 1


def check_stamp(first_line: str) -> None:
    if first_line.strip() != STAMP:
        raise CoordinateError(f"first line must be {STAMP!r}, found {first_line.strip()[:80]!r}")


def get_reference(name: str = "pf3d7") -> tuple[dict[str, int], float]:
    """Chromosome lengths and base pairs a centimorgan of a registered reference."""
    known = {"pf3d7": (PF3D7_LENGTHS, BP_PER_CM)}
    if name not in known:
        raise ValueError(f"unknown reference {name!r}; known: {', '.join(sorted(known))}")
    return known[name]
