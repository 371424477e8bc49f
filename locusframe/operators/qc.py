"""Callset QC: private variants and near-identical samples, strand bias, sequence triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.stats import fisher_p, mad_score, with_workers


def singleton_counts(cells: DataFrame, max_missing_frac: float = 1.0, min_depth: int = 0) -> DataFrame:
    """Per sample: called sites, private variants and their rate per 1000 calls, doubletons and the partner that shares most.

    cells: site, sample, sample_ix (order of the samples), alt (carries a non-reference allele), missing, depth.
    Sites with more than max_missing_frac missing samples do not count; a depth below min_depth makes a call
    missing. Of partners with equally many shared doubletons the one whose pair reached that number at the earliest
    first-seen doubleton wins, as if sites were read in order. Pairs come only from sites with two carriers."""
    shallow = F.coalesce((F.col("depth") >= 0) & (F.col("depth") < min_depth), F.lit(False)) if min_depth else F.lit(False)
    rows = cells.withColumn("_miss", F.col("missing") | shallow)
    site = rows.groupBy("site").agg(
        F.avg(F.col("_miss").cast("double")).alias("_share"), F.sort_array(F.collect_list(F.when(F.col("alt") & ~F.col("_miss"), F.struct("sample_ix", "sample")))).alias("who")
    ).where(F.col("_share") <= max_missing_frac)
    called = rows.join(site.select("site"), "site", "left_semi").groupBy("sample", "sample_ix").agg(F.count_if(~F.col("_miss")).alias("n_called"))
    single = site.where(F.size("who") == 1).groupBy(F.get("who", 0)["sample"].alias("sample")).agg(F.count("*").alias("n_singleton"))
    double = site.where(F.size("who") == 2).select("site", F.get("who", 0).alias("a"), F.get("who", 1).alias("b"))
    pair = double.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("site").alias("seen"))
    sides = pair.select(F.col("a.sample").alias("sample"), F.col("b.sample").alias("partner"), "c", "seen").union(pair.select(F.col("b.sample"), F.col("a.sample"), "c", "seen"))
    doubles = sides.groupBy("sample").agg(F.sum("c").alias("n_doubleton"))
    best = sides.withColumn("_rn", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("c"), "seen", "partner"))).where("_rn = 1").select("sample", F.col("partner").alias("top_partner"), F.col("c").alias("n_shared_with_partner"))
    out = called.join(single, "sample", "left").join(doubles, "sample", "left").join(best, "sample", "left").na.fill(0, ["n_singleton", "n_doubleton", "n_shared_with_partner"]).na.fill("", ["top_partner"])
    rate = lambda a, b: F.coalesce(F.try_divide(a, F.col(b)), F.lit(0.0))
    return out.select(
        "sample", "n_called", "n_singleton", rate(F.col("n_singleton") * 1000.0, "n_called").alias("singleton_rate"), "n_doubleton", "top_partner", "n_shared_with_partner",
        rate(F.col("n_shared_with_partner").cast("double"), "n_doubleton").alias("frac_doubletons_with_partner"),
    )


def flag_outliers(counts: DataFrame, mad_cutoff: float = 5.0, duplicate_frac: float = 0.9, column: str = "singleton_rate") -> DataFrame:
    """Adds mad_score, outlier and flag."""
    scored = mad_score(counts, column, "mad_score")
    tail = F.when(F.col("mad_score") > mad_cutoff, "excess private variants").when(F.col("mad_score") < -mad_cutoff, "few private variants")
    twin = F.when((F.col("frac_doubletons_with_partner") >= duplicate_frac) & (F.col("top_partner") != ""), F.concat(F.lit("near-identical to "), "top_partner"))
    return scored.withColumn("outlier", F.abs("mad_score") > mad_cutoff).withColumn("flag", F.concat_ws("; ", tail, twin))


def strand_bias(cells: DataFrame, min_vaf: float = 0.05, min_minor_depth: int = 20, ratio_hard: float = 0.15, ratio_soft: float = 0.30, sb_hard: float = 60.0, alt_bq: Column | None = None) -> DataFrame:
    """Verdicts for cells with ref_fwd, alt_fwd, ref_rev, alt_rev whose pooled ALT share reaches min_vaf; cells with a missing depth are left out."""
    depths = [F.col(c) for c in ("ref_fwd", "alt_fwd", "ref_rev", "alt_rev")]
    total, alt = depths[0] + depths[1] + depths[2] + depths[3], depths[1] + depths[3]
    good = (depths[0] >= 0) & (depths[1] >= 0) & (depths[2] >= 0) & (depths[3] >= 0)
    rows = cells.where(good & (alt > 0)).withColumn("vaf", alt.cast("double") / total).where(F.col("vaf") >= min_vaf)
    fwd, rev = depths[0] + depths[1], depths[2] + depths[3]
    rows = rows.withColumn("vaf_fwd", F.coalesce(F.try_divide(depths[1].cast("double"), fwd), F.lit(0.0))).withColumn("vaf_rev", F.coalesce(F.try_divide(depths[3].cast("double"), rev), F.lit(0.0)))
    low, high = F.least("vaf_fwd", "vaf_rev"), F.greatest("vaf_fwd", "vaf_rev")
    rows = with_workers(rows).withColumn("ratio", F.coalesce(F.try_divide(low, high), F.lit(1.0))).withColumn("sb_phred", -10 * F.log10(F.greatest(fisher_p(*depths), F.lit(1e-300))))
    minor = F.when(F.col("vaf_fwd") <= F.col("vaf_rev"), fwd).otherwise(rev)
    one = (F.col("ratio") < ratio_hard) & (minor >= min_minor_depth)
    two = F.col("sb_phred") > sb_hard
    reasons = [
        F.when(one, F.format_string("strand-restricted (ratio=%.2f, minor_depth=%d)", "ratio", minor)),
        F.when(two, F.format_string("fisher SB Phred=%.0f", "sb_phred")),
    ]
    drop = one | two
    if alt_bq is not None:
        three = F.coalesce((F.col("ratio") < ratio_soft) & (alt_bq < 15), F.lit(False))
        drop = drop | three
        reasons.append(F.when(three, F.format_string("low alt BQ=%s + strand skew (ratio=%.2f)", alt_bq.cast("string"), "ratio")))
    return rows.withColumn("drop", drop).withColumn("reasons", F.concat_ws(";", *reasons))


def strand_blacklist(verdicts: DataFrame, min_drop_samples: int = 1) -> DataFrame:
    """Positions dropped in at least min_drop_samples samples."""
    counted = verdicts.where("drop").groupBy("chrom", "pos0").agg(F.countDistinct("sample").alias("n"))
    return counted.where(F.col("n") >= min_drop_samples).select("chrom", F.col("pos0").alias("start"), (F.col("pos0") + 1).alias("end"), "n")


def homopolymers(sequences: DataFrame, bases: str = "GC", least: int = 3) -> DataFrame:
    """name, start, end, kind of runs of one of the bases; sequences: name, start (0-based), seq."""
    found = sequences.select("name", "start", F.posexplode(F.split(F.upper("seq"), "")).alias("i", "base"))
    rows = found.where(F.col("base") != "")
    island = F.col("i") - F.row_number().over(Window.partitionBy("name", "start", "base").orderBy("i"))
    runs = rows.withColumn("_k", island).groupBy("name", "start", "base", "_k").agg(F.min("i").alias("a"), F.count("*").alias("n"))
    kept = runs.where(F.col("base").isin(*bases) & (F.col("n") >= least))
    return kept.select("name", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("a") + F.col("n")).alias("end"), F.repeat("base", F.col("n").cast("int")).alias("trigger"))


def motifs(sequences: DataFrame, wanted: tuple[str, ...] = ("GGC", "GCC")) -> DataFrame:
    """name, start, end, trigger at every offset where a motif begins."""
    size = len(wanted[0])
    at = F.sequence(F.lit(1), F.greatest(F.length("seq") - size + 1, F.lit(1)))
    rows = sequences.select("name", "start", "seq", F.explode(at).alias("_i")).withColumn("trigger", F.upper(F.substr("seq", F.col("_i"), F.lit(size))))
    return rows.where(F.col("trigger").isin(*wanted)).select("name", (F.col("start") + F.col("_i") - 1).alias("start"), (F.col("start") + F.col("_i") - 1 + size).alias("end"), "trigger")


def gc_islands(sequences: DataFrame, window: int = 20, above: float = 0.35) -> DataFrame:
    """name, start, end, gc of the sliding windows whose GC share is above the limit."""
    at = F.sequence(F.lit(1), F.greatest(F.length("seq") - window + 1, F.lit(1)))
    rows = sequences.where(F.length("seq") >= window).select("name", "start", F.explode(at).alias("_i"), "seq")
    gc = F.length(F.regexp_replace(F.upper(F.substr("seq", F.col("_i"), F.lit(window))), "[^GC]", "")) / F.lit(float(window))
    return rows.withColumn("gc", gc).where(F.col("gc") > above).select("name", (F.col("start") + F.col("_i") - 1).alias("start"), (F.col("start") + F.col("_i") - 1 + window).alias("end"), "gc")
