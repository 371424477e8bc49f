"""Within-sample allele fractions: minor-fraction histograms and mixture profiles.

Input is long: site, sample, ad (array of depths, one element an allele).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN, N_BINS = 0.01, 50
MIN_SITES, MIN_DOMINANT, MIN_MINOR, MAX_RESIDUAL = 1000, 0.70, 0.02, 0.02


def bin_index(frac: float) -> int:
    """First histogram bin at or above a fraction."""
    return min(N_BINS, max(0, math.ceil(round(frac / BIN, 6))))


def site_fractions(cells: DataFrame, min_depth: int = 10, min_minor: float = MIN_MINOR, min_minor_reads: int = 2) -> DataFrame:
    """Covered cells: site, sample, minor_frac, alt_frac, plaf, het, wsmaf.

    minor_frac is the share of the second best allele; plaf the mean ALT share of a site's covered
    samples, summed in decimals, so that it is the same in whatever order they come; wsmaf the ALT share, or one minus it where plaf is above one half."""
    ad = F.transform("ad", lambda d: F.greatest(F.coalesce(d, F.lit(0)), F.lit(0)))
    depth = F.aggregate("_ad", F.lit(0).cast("long"), lambda s, d: s + d)
    out = cells.where(F.size("ad") >= 2).withColumn("_ad", ad).withColumn("_depth", depth).where(F.col("_depth") >= min_depth)
    second = F.get(F.sort_array("_ad", asc=False), 1)
    alt = F.col("_depth") - F.get("_ad", 0)
    exact = alt.cast("decimal(18,0)") / F.col("_depth").cast("decimal(18,0)")
    plaf = F.round(F.avg(exact).over(Window.partitionBy("site")), 17).cast("double")
    return (
        out.withColumn("minor_frac", second.cast("double") / F.col("_depth"))
        .withColumn("alt_frac", alt.cast("double") / F.col("_depth"))
        .withColumn("plaf", plaf)
        .withColumn("het", (F.col("minor_frac") >= min_minor) & (second >= min_minor_reads))
        .withColumn("wsmaf", F.when(F.col("plaf") <= 0.5, F.col("alt_frac")).otherwise(1 - F.col("alt_frac")))
        .select("site", "sample", "minor_frac", "alt_frac", "plaf", "het", "wsmaf")
    )


def histogram(fractions: DataFrame) -> DataFrame:
    """sample, bin, n over the heterozygous cells."""
    at = F.least(F.floor(F.col("minor_frac") / BIN), F.lit(N_BINS - 1)).cast("int")
    return fractions.where("het").groupBy("sample", at.alias("bin")).agg(F.count("*").alias("n"))


def _centre(i: Column) -> Column:
    return (F.round(i * BIN, 10) + F.round((i + 1) * BIN, 10)) / 2


def profile(fractions: DataFrame, max_residual_het: float = MAX_RESIDUAL, min_minor: float = MIN_MINOR, min_dominant: float = MIN_DOMINANT, min_sites: int = MIN_SITES) -> DataFrame:
    """One row a covered sample, of what a read-share filter would have to do to leave one clone.

    min_freq_needed is the first threshold, from min_minor up, under which fewer than max_residual_het
    of the covered sites stay heterozygous; null if none below one half does."""
    totals = fractions.groupBy("sample").agg(
        F.count("*").alias("n_sites"), F.count_if("het").alias("n_het"), F.avg(F.when(F.col("het"), F.col("wsmaf"))).alias("wsmaf_mean")
    )
    counts = histogram(fractions).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    h = F.transform(F.sequence(F.lit(0), F.lit(N_BINS - 1)), lambda i: F.coalesce(F.try_element_at("h", i.cast("int")), F.lit(0).cast("long")))
    rows = totals.join(counts, "sample", "left").withColumn("h", F.coalesce("h", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>")))).withColumn("c", h)
    n, het = F.col("n_sites").cast("double"), F.col("n_het")
    from_ = lambda k: F.aggregate(F.slice("c", k + 1, N_BINS), F.lit(0).cast("long"), lambda s, x: s + x)
    upto = lambda k: F.aggregate(F.slice("c", 1, k + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    steps = F.sequence(F.lit(0), F.lit(N_BINS - 1))
    low = F.sequence(F.lit(bin_index(min_minor)), F.lit(N_BINS - 1))
    need = F.get(F.filter(low, lambda k: from_(k) / n < max_residual_het), 0)
    quantile = lambda q: F.when(het > 0, _centre(F.get(F.filter(steps, lambda k: upto(k) >= het * q), 0)))
    coarse = F.transform(F.sequence(F.lit(0), F.lit(N_BINS // 2 - 1)), lambda i: F.get("c", 2 * i) + F.get("c", 2 * i + 1))
    tall = F.transform("coarse", lambda x: (x >= F.greatest(F.lit(1.0), F.array_max("coarse") * 0.1)).cast("int"))
    rises = F.aggregate(F.transform("tall", lambda t, i: F.when((t == 1) & ((i == 0) | (F.get("tall", i - 1) == 0)), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    out = rows.withColumn("need_bin", need).withColumn("coarse", coarse).withColumn("tall", tall)
    freq = F.round(F.col("need_bin") * BIN, 10)
    kind = (
        F.when(F.col("n_sites") < min_sites, "undetermined")
        .when(freq.isNull(), "mixed")
        .when(freq <= min_minor, "monoclonal")
        .when(freq <= 1.0 - min_dominant + 1e-9, "dominant_clone")
        .otherwise("mixed")
    )
    return out.select(
        "sample", "n_sites", "n_het", (het / n).alias("het_rate"), freq.alias("min_freq_needed"), (1.0 - freq).alias("dominant_frac"),
        (from_(F.lit(bin_index(1.0 - min_dominant))) / n).alias("residual_het_rate"),
        F.when(het > 0, _centre(F.array_position("c", F.array_max("c")) - 1)).alias("minor_mode"), quantile(0.5).alias("minor_median"), quantile(0.95).alias("minor_q95"),
        F.when(het > 0, rises).otherwise(0).cast("long").alias("n_bands"), "wsmaf_mean", kind.alias("class"),
    ).orderBy(F.desc_nulls_last("residual_het_rate"), F.desc_nulls_last("min_freq_needed"))


def with_fws(profiles: DataFrame, fws: DataFrame, monoclonal_threshold: float = 0.92) -> DataFrame:
    """Profiles with fws, and whether it fails the threshold."""
    return profiles.join(fws.select("sample", "fws"), "sample", "left").withColumn("fails", F.coalesce(F.col("fws") < monoclonal_threshold, F.lit(False)))
