"""Within-host diversity: Fws from allele depths in long form (site, sample, ref_ad, alt_ad).

A sample without a row at a site has no reads there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(n_bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0, 0.5, n_bins + 1)]


def bin_of(maf: Column, n_bins: int, clipped: bool = False) -> Column:
    """How many edges are at or below maf; with clipped, the inner edges alone, from 0 on.

    Unclipped, a maf of exactly 0.5 is a bin of its own."""
    inner = edges(n_bins)[1:-1] if clipped else edges(n_bins)
    out = F.lit(0)
    for e in inner:
        out = out + (maf >= F.lit(e)).cast("int")
    return out


def site_stats(calls: DataFrame, min_alt_samples: int = 0) -> DataFrame:
    """site, p (pooled ALT share), maf, hs (population heterozygosity), alt_present, ok."""
    sums = calls.groupBy("site").agg(F.sum("alt_ad").alias("alt"), F.sum(F.col("ref_ad") + F.col("alt_ad")).alias("depth"), F.count_if(F.col("alt_ad") > 0).alias("alt_present"))
    p = F.try_divide(F.col("alt").cast("double"), F.col("depth"))
    return (
        sums.withColumn("p", p)
        .withColumn("maf", F.least(F.col("p"), 1 - F.col("p")))
        .withColumn("hs", 2 * F.col("p") * (1 - F.col("p")))
        .withColumn("ok", F.col("maf").isNotNull() & (F.col("alt_present") >= min_alt_samples))
        .select("site", "p", "maf", "hs", "alt_present", "ok")
    )


def _cells(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells with depth, with hw (within-sample heterozygosity) and the statistics of their site."""
    depth = F.col("ref_ad") + F.col("alt_ad")
    q = F.try_divide(F.col("alt_ad").cast("double"), depth)
    return calls.select("site", "sample", depth.alias("depth"), (2 * q * (1 - q)).alias("hw")).join(sites, "site")


def fws(calls: DataFrame, estimator: str = "regression", min_depth: int = 0, n_bins: int = 10, min_alt_samples: int = 0) -> DataFrame:
    """sample, fws, n_sites; fws is null and n_sites 0 for a sample with no usable site.

    regression: 1 - slope through the origin of a sample's mean Hw by MAF bin on the population's mean
    Hs by bin. ratio: 1 - sum of the mean Hw over the sum of the mean Hs, by bin, at polymorphic sites."""
    sites = site_stats(calls, min_alt_samples)
    samples = calls.select("sample").distinct()
    if estimator == "regression":
        ok = sites.where("ok").withColumn("bin", bin_of(F.col("maf"), n_bins))
        x = ok.groupBy("bin").agg(F.avg("hs").alias("x"))
        cells = _cells(calls, ok).where((F.col("depth") > 0) & (F.col("depth") >= min_depth))
        by_bin = cells.groupBy("sample", "bin").agg(F.avg("hw").alias("y"), F.count("*").alias("n")).join(F.broadcast(x), "bin")
        out = by_bin.groupBy("sample").agg((1 - F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")))).alias("fws"), F.sum("n").alias("n"))
    elif estimator == "ratio":
        ok = sites.where("ok AND hs > 0").withColumn("bin", bin_of(F.col("maf"), n_bins, clipped=True))
        if min_depth > 0:
            cells = _cells(calls, ok).where(F.col("depth") >= min_depth)
            by_bin = cells.groupBy("sample", "bin").agg(F.avg("hw").alias("hw"), F.avg("hs").alias("hs"), F.count("*").alias("n"))
        else:  # sites without reads count too
            whole = ok.groupBy("bin").agg(F.avg("hs").alias("hs"), F.count("*").alias("n"))
            seen = _cells(calls, ok).where("depth > 0").groupBy("sample", "bin").agg(F.avg("hw").alias("hw"))
            by_bin = samples.crossJoin(F.broadcast(whole)).join(seen, ["sample", "bin"], "left")
        out = by_bin.groupBy("sample").agg(F.when(F.count("hw") == F.count("*"), 1 - F.try_divide(F.sum("hw"), F.sum("hs"))).alias("fws"), F.sum("n").alias("n"))
    else:
        raise ValueError(f"unknown estimator {estimator!r} (regression or ratio)")
    return samples.join(out, "sample", "left").select("sample", "fws", F.coalesce(F.when(F.col("fws").isNotNull(), F.col("n")), F.lit(0)).cast("long").alias("n_sites"))


def fws_report(values: DataFrame, monoclonal_threshold: float = 0.95) -> DataFrame:
    """fws to 6 places and whether it reaches the threshold (null where undefined)."""
    return values.select("sample", F.round("fws", 6).alias("fws"), "n_sites", (F.col("fws") >= monoclonal_threshold).alias("monoclonal"))


def exclude_sites(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Calls whose 1-based position lies in no region; both ends of a region belong to it."""
    from locusframe.operators.intervals import interval_join

    closed = regions.select(F.col("chrom").alias("_xc"), (F.col("call_start") - 1).alias("_xs"), F.col("call_end").alias("_xe"))
    spans = calls.withColumn("_s", F.col("pos0")).withColumn("_e", F.col("pos0") + 1)
    return interval_join(spans, closed, "left_anti", left_on=("chrom", "_s", "_e"), right_on=("_xc", "_xs", "_xe")).drop("_s", "_e")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
