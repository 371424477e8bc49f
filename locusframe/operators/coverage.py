"""Sequencing depth over run-length runs (sample, chrom, start, end, depth); no position is ever a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.intervals import clip_runs

THRESHOLDS = (1, 5, 10, 20)
#: Reads are swept in tiles of this width, so that a chromosome is many tasks.
TILE = 1 << 20


def depth_runs(reads: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Runs of equal depth from aligned blocks (sample, chrom, start, end); zero-depth runs up to lengths (chrom, length) if given.

    A block is cut at tile borders and every tile is swept on its own: +1 at a start, -1 at an end, and a running sum."""
    tiles = reads.where("end > start").withColumn("_t", F.explode(F.sequence(F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE))))
    cut = tiles.select("sample", "chrom", "_t", F.greatest("start", F.col("_t") * TILE).alias("s"), F.least("end", (F.col("_t") + 1) * TILE).alias("e"))
    events = cut.select("sample", "chrom", "_t", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    rows = events.select("sample", "chrom", "_t", "x.at", "x.d")
    if lengths is not None:
        tile = lengths.where("length > 0").select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / TILE))).alias("_t"))
        spine = reads.select("sample").distinct().crossJoin(F.broadcast(tile))
        ends = F.array(F.col("_t") * TILE, F.least("length", (F.col("_t") + 1) * TILE))
        rows = rows.unionByName(spine.select("sample", "chrom", "_t", F.explode(ends).alias("at"), F.lit(0).alias("d")))
    steps = rows.groupBy("sample", "chrom", "_t", "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("sample", "chrom", "_t").orderBy("at")
    runs = steps.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("at").over(order))
    kept = runs.where("end IS NOT NULL").select("sample", "chrom", F.col("at").alias("start"), "end", F.col("depth").cast("long").alias("depth"))
    return kept if lengths is not None else kept.where("depth > 0")


def depth_histogram(runs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """sample, chrom, depth, bases; with regions, of their bases only."""
    used = clip_runs(runs, regions) if regions is not None else runs
    return used.groupBy("sample", "chrom", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def depth_summary(hist: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, engine: str = "runs") -> DataFrame:
    """A row for each sample and chromosome and one named genome: moments, discrete quantiles, breadth.

    A quantile is the smallest depth whose cumulated bases reach it; the SD is the population's."""
    rows = hist.groupBy("sample", "chrom", "depth").agg(F.sum("bases").alias("bases"))
    both = rows.unionByName(rows.groupBy("sample", "depth").agg(F.sum("bases").alias("bases")).withColumn("chrom", F.lit("genome")))
    key = ["sample", "chrom"]
    whole = Window.partitionBy(*key)
    cum = both.withColumn("_n", F.sum("bases").over(whole)).withColumn("_cum", F.sum("bases").over(whole.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)))
    d, b = F.col("depth"), F.col("bases")
    n = F.sum("bases")
    mean = F.sum(d * b).cast("double") / n
    quantile = lambda q: F.min(F.when(F.col("_cum") >= F.col("_n") * q, d)).cast("double")
    seen = F.when(b > 0, d)
    sums = [
        n.alias("bases"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(d * d * b).cast("double") / n - mean * mean, F.lit(0.0))).alias("sd"), F.min(seen).cast("double").alias("min"), quantile(0.5).alias("median"),
        quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), F.max(seen).cast("double").alias("max"), (100.0 * F.sum(F.when(d == 0, b).otherwise(0)) / n).alias("pct_zero"),
    ]
    sums += [(100.0 * F.sum(F.when(d >= t, b).otherwise(0)) / n).alias(f"pct_ge_{t}x") for t in thresholds]
    return cum.groupBy(*key).agg(*sums).withColumn("engine", F.lit(engine))


def depth_windows(runs: DataFrame, window: int = 1000, lengths: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Mean depth of the accessible bases of every window that has any; a last window ends with its chromosome."""
    used = clip_runs(runs, regions) if regions is not None else runs
    cut = used.withColumn("_w", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window))))
    width = F.least("end", (F.col("_w") + 1) * window) - F.greatest("start", F.col("_w") * window)
    sums = cut.withColumn("_b", width).groupBy("sample", "chrom", "_w").agg(F.sum("_b").alias("bases"), F.sum(F.col("depth") * F.col("_b")).alias("_s"))
    out = sums.withColumn("start", F.col("_w") * window).withColumn("end", (F.col("_w") + 1) * window)
    if lengths is not None:
        out = out.join(F.broadcast(lengths.select("chrom", "length")), "chrom").withColumn("end", F.least("end", "length"))
    return out.select("sample", "chrom", "start", "end", "bases", (F.col("_s") / F.col("bases").cast("double")).alias("mean_depth"))


def dropout_windows(windows: DataFrame, min_depth: float = 5.0, min_frac_samples: float = 0.9) -> DataFrame:
    """Windows in which at least min_frac_samples of the samples present lie below min_depth."""
    low = F.avg((F.col("mean_depth") < min_depth).cast("double"))
    per = windows.groupBy("chrom", "start", "end").agg(
        F.countDistinct("sample").alias("n_samples"), low.alias("frac_samples_uncovered"), F.median("mean_depth").alias("median_depth_across_samples"), F.avg("mean_depth").alias("mean_depth_across_samples")
    )
    return per.where(F.col("frac_samples_uncovered") >= min_frac_samples)


def dropout_regions(windows: DataFrame, min_depth: float = 5.0, min_frac_samples: float = 0.9, merge_gap: int = 0, min_length: int = 0) -> DataFrame:
    """Flagged windows at most merge_gap apart as regions: means of shares and means, median of medians."""
    flagged = dropout_windows(windows, min_depth, min_frac_samples)
    order = Window.partitionBy("chrom").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") - F.col("_seen") <= merge_gap, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = flagged.withColumn("_seen", seen).withColumn("_island", island).groupBy("chrom", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_windows"), F.max("n_samples").alias("n_samples"), F.avg("frac_samples_uncovered").alias("frac_samples_uncovered"),
        F.median("median_depth_across_samples").alias("median_depth_across_samples"), F.avg("mean_depth_across_samples").alias("mean_depth_across_samples"),
    ).withColumn("length", F.col("end") - F.col("start"))
    return out.where(F.col("length") >= min_length).drop("_island").orderBy(F.desc("frac_samples_uncovered"), F.desc("length"))
