"""Depth windows kept up to date from a stream of depth runs or reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_sums(runs: DataFrame, window: int = 1000) -> DataFrame:
    """sample, chrom, start, bases and depth_sum so far; runs may be a stream of (sample, chrom, start, end, depth).

    The state holds one row a window; complete or update output mode."""
    cut = runs.withColumn("_w", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window))))
    width = F.least("end", (F.col("_w") + 1) * window) - F.greatest("start", F.col("_w") * window)
    return cut.withColumn("_b", width).groupBy("sample", "chrom", (F.col("_w") * window).alias("start")).agg(F.sum("_b").alias("bases"), F.sum(F.col("depth") * F.col("_b")).alias("depth_sum"))


def allele_counts(calls: DataFrame) -> DataFrame:
    """site, ref and alt reads and carriers so far from a stream of (site, sample, ref_ad, alt_ad)."""
    return calls.groupBy("site").agg(F.sum("ref_ad").alias("ref_reads"), F.sum("alt_ad").alias("alt_reads"), F.count_if(F.col("alt_ad") > 0).alias("carriers"))
