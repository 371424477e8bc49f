"""Allele frequencies from genotypes and depths in long form.

calls: site (or chrom and pos0), sample, gt (array of allele indices, null for missing), ad (array of depths),
alts (array of ALT alleles). Groups are a column; a null group counts in the overall figures only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prepared(calls: DataFrame, per_alt: bool) -> DataFrame:
    """One row a cell (and ALT with per_alt) with its allele counts, read share and flags."""
    rows = calls
    if per_alt:
        rows = rows.select("*", F.posexplode("alts").alias("_k", "alt")).withColumn("alt_index", F.col("_k") + 1)
        hit: Column = F.size(F.filter("gt", lambda a: a == F.col("alt_index")))
    else:
        hit = F.size(F.filter("gt", lambda a: a > 0))
    called = F.size(F.filter("gt", lambda a: a.isNotNull()))
    ad = F.transform("ad", lambda d: F.greatest(F.coalesce(d, F.lit(0)), F.lit(0)))
    good = F.col("ad").isNotNull() & (F.size("ad") == F.size("alts") + 1)
    depth = F.when(good, F.aggregate(ad, F.lit(0).cast("long"), lambda s, d: s + d))
    reads = F.get(ad, F.col("alt_index")) if per_alt else depth - F.get(ad, 0)
    share = F.try_divide(reads.cast("double"), depth) if per_alt else 1.0 - F.try_divide(F.get(ad, 0).cast("double"), depth)
    return rows.withColumn("_hit", hit).withColumn("_called", called).withColumn("_reads", reads).withColumn("_share", F.when(depth > 0, share))


def allele_freqs(calls: DataFrame, group: str | None = None, per_alt: bool = False, weighted: bool = True, ad_min_reads: int = 2, ad_min_freq: float = 0.01) -> DataFrame:
    """Frequencies a site (and ALT with per_alt), overall or for each value of the group column.

    af = ac / an over called allele slots; prevalence over genotypes, prevalence_ad over samples whose reads
    show the allele at ad_min_reads and ad_min_freq; af_weighted is the mean read share. A group that
    occurs anywhere has a row for every site, with counts of 0 and null frequencies where no sample has a call."""
    cells = _prepared(calls, per_alt)
    site = [c for c in ("site", "chrom", "pos0") if c in calls.columns]
    keys = [*site, "n_alts", *(["alt", "alt_index"] if per_alt else [])]
    cells = cells.withColumn("n_alts", F.size("alts"))
    usable = F.col("_share").isNotNull() if weighted else F.lit(False)
    present = usable & (F.col("_reads") >= ad_min_reads) & (F.col("_share") >= ad_min_freq)
    sums = [
        F.sum("_hit").cast("long").alias("ac"), F.sum("_called").cast("long").alias("an"), F.sum(F.when(usable, F.col("_share"))).alias("_w"), F.count_if(usable).alias("n_samples_ad"),
        F.count_if((F.col("_hit") > 0)).alias("n_samples_alt"), F.count_if(F.col("_called") > 0).alias("n_samples"), F.count_if(present).alias("n_samples_alt_ad"),
    ]
    if group:
        counted = cells.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(*sums)
        spine = cells.select(*keys).distinct().crossJoin(cells.where(F.col(group).isNotNull()).select(group).distinct())
        counts = [c for c in ("ac", "an", "n_samples_ad", "n_samples_alt", "n_samples", "n_samples_alt_ad")]
        counted = spine.join(counted, [*keys, group], "left").na.fill(0, counts)
    else:
        counted = cells.groupBy(*keys).agg(*sums)
    over = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return counted.select(
        *keys, *([group] if group else []), over("ac", "an").alias("af"), F.least(over("ac", "an"), 1 - over("ac", "an")).alias("maf"), "ac", "an", over("_w", "n_samples_ad").alias("af_weighted"), "n_samples_ad",
        over("n_samples_alt", "n_samples").alias("prevalence"), "n_samples_alt", "n_samples", over("n_samples_alt_ad", "n_samples_ad").alias("prevalence_ad"), "n_samples_alt_ad",
    )
