"""Interval operators over 0-based half-open (chrom, start, end) frames.

Spark has no interval join, so both sides are dealt to fixed bins of the coordinate and joined on
(chrom, bin); a pair is kept in one bin only, the one that holds the start of what it shares, so nothing has to
be made distinct afterwards and a chromosome never is one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 16_384


def _bins(start: Column, end: Column, width: int) -> Column:
    first, last = F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)
    return F.sequence(first, last)


def interval_join(left: DataFrame, right: DataFrame, how: str = "inner", width: int = BIN, left_on: tuple[str, str, str] = ("chrom", "start", "end"), right_on: tuple[str, str, str] = ("chrom", "start", "end"), extra: Column | None = None) -> DataFrame:
    """Pairs of overlapping rows (columns must differ in name), or left rows with (left_semi) or without (left_anti) a partner.

    Empty intervals overlap nothing. `extra` is a further condition on both sides."""
    lc, ls, le = left_on
    rc, rs, re_ = right_on
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of interval join: {how}")
    if how != "inner":  # only different spans meet the right side; rows follow their span
        if extra is not None:
            raise ValueError("a further condition needs an inner join")
        spans = left.select(F.col(lc).alias("_lc"), F.col(ls).alias("_ls"), F.col(le).alias("_le")).distinct()
        hit = interval_join(spans, right.select(rc, rs, re_), "inner", width, ("_lc", "_ls", "_le"), right_on).select("_lc", "_ls", "_le").distinct()
        return left.join(hit, (F.col(lc) == F.col("_lc")) & (F.col(ls) == F.col("_ls")) & (F.col(le) == F.col("_le")), how)
    a = left.where(F.col(le) > F.col(ls)).withColumn("_bin", F.explode(_bins(F.col(ls), F.col(le), width)))
    b = right.where(F.col(re_) > F.col(rs)).withColumn("_rbin", F.explode(_bins(F.col(rs), F.col(re_), width)))
    on = (F.col(lc) == F.col(rc)) & (F.col("_bin") == F.col("_rbin")) & (F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs))
    if extra is not None:
        on = on & extra
    begins = F.greatest(ls, rs) >= F.col("_bin") * width  # of the bins that both have, only the first holds the start of what they share
    return a.join(b, on & begins).drop("_bin", "_rbin")


def merge_intervals(df: DataFrame, gap: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Touching or overlapping intervals as one, as are those at most `gap` apart; empty ones go. `by` keeps its values apart."""
    order = Window.partitionBy(*by, "chrom").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where("end > start").withColumn("_new", F.when(F.col("start") <= seen + gap, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _sweep(first: DataFrame, second: DataFrame) -> DataFrame:
    """Segments between neighbouring ends with how often each side covers them."""
    sides = []
    for df, a, b in ((first, 1, 0), (second, 0, 1)):
        rows = df.where("end > start")
        sides += [rows.select("chrom", F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")), rows.select("chrom", F.col("end").alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b"))]
    events = sides[0].union(sides[1]).union(sides[2]).union(sides[3]).groupBy("chrom", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("chrom").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return events.select("chrom", F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b"))


def subtract_intervals(mask: DataFrame, cut: DataFrame) -> DataFrame:
    """What of mask no interval of cut covers, merged."""
    return merge_intervals(_sweep(mask, cut).where("a > 0 AND b = 0 AND end IS NOT NULL").select("chrom", "start", "end"))


def union_intervals(first: DataFrame, second: DataFrame) -> DataFrame:
    return merge_intervals(first.select("chrom", "start", "end").unionByName(second.select("chrom", "start", "end")))


def record_span(df: DataFrame) -> DataFrame:
    """Adds start and end of a record: its REF bases."""
    return df.withColumn("start", F.col("pos0")).withColumn("end", F.col("pos0") + F.length("ref"))


def region_filter(records: DataFrame, bed: DataFrame, exclude: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """Records whose REF span meets the BED, or with exclude does not; records meeting `keep` always stay.

    A record that meets several intervals is kept once. Adds `rescued`: kept by `keep` alone."""
    side = lambda b, n: b.select(F.col("chrom").alias(f"_{n}c"), F.col("start").alias(f"_{n}s"), F.col("end").alias(f"_{n}e"))
    spans = record_span(records)
    on = lambda n: {"left_on": ("chrom", "start", "end"), "right_on": (f"_{n}c", f"_{n}s", f"_{n}e")}
    passing = interval_join(spans, side(bed, "b"), "left_anti" if exclude else "left_semi", **on("b")).withColumn("rescued", F.lit(False))
    if keep is not None:
        failing = interval_join(spans, side(bed, "b"), "left_semi" if exclude else "left_anti", **on("b"))
        passing = passing.unionByName(interval_join(failing, side(keep, "k"), "left_semi", **on("k")).withColumn("rescued", F.lit(True)))
    return passing.drop("start", "end")


def points_in(points: DataFrame, intervals: DataFrame, pos: str = "pos0") -> DataFrame:
    """Pairs of a point and an interval that holds it; intervals name their columns i_chrom, i_start, i_end."""
    spans = points.withColumn("_s", F.col(pos)).withColumn("_e", F.col(pos) + 1)
    return interval_join(spans, intervals, left_on=("chrom", "_s", "_e"), right_on=("i_chrom", "i_start", "i_end")).drop("_s", "_e")


def annotate(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds genes: names of the genes (chr, start, end, name) a region meets, distinct, sorted, comma-joined, '' for none."""
    named = genes.select(F.col("chr").alias("_gc"), F.col("start").alias("_gs"), F.col("end").alias("_ge"), F.col("name").cast("string").alias("_name"))
    keys = ["chrom", "start", "end"]
    hits = interval_join(regions.select(*keys).distinct(), named, right_on=("_gc", "_gs", "_ge")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("_name")), ",").alias("genes"))
    return regions.join(hits, keys, "left").withColumn("genes", F.coalesce("genes", F.lit("")))


def clip_runs(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Runs (chrom, start, end and more) cut to the merged regions."""
    bed = merge_intervals(regions.select("chrom", "start", "end")).select(F.col("chrom").alias("_bc"), F.col("start").alias("_bs"), F.col("end").alias("_be"))
    return interval_join(runs, bed, right_on=("_bc", "_bs", "_be")).withColumn("start", F.greatest("start", "_bs")).withColumn("end", F.least("end", "_be")).drop("_bc", "_bs", "_be")
