"""Selection scan over shared segments.

The statistic needs the number of sharing pairs of each SNP and one total only: summed over pairs, the
centred matrix is count - (all cells) / (SNPs), so nothing pairs-by-SNPs is ever made. The permutation
null shifts whole runs of shared SNPs round the panel: a run is two events, and a prefix sum over events
gives every replicate's counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.stats import CHI2_MEDIAN, benjamini_hochberg, chi2_sf, normal_sf, with_workers
from locusframe.tables import materialise


def raw_statistic(counts: DataFrame, n_pairs: int, n_snps: int, total: Column | None = None) -> DataFrame:
    """counts: snp_ix, n_pairs_ibd for every SNP, and af. Adds maf and raw_stat, null where af is null, 0 or 1 or beyond.

    total: all shared cells, where it is known; else it is summed once and joined back as one row."""
    af = F.col("af")
    valid = af.isNotNull() & (af > 0) & (af < 1)
    if total is None:
        counts, total = counts.crossJoin(F.broadcast(counts.agg(F.sum("n_pairs_ibd").alias("_total")))), F.col("_total")
    centred = F.col("n_pairs_ibd") - total / F.lit(float(n_snps))
    out = counts.withColumn("maf", F.when(af <= 0.5, af).otherwise(1 - af))
    return out.withColumn("raw_stat", F.when(valid, centred / F.sqrt(F.when(valid, F.lit(float(n_pairs)) * af * (1 - af))))).drop("_total")


def maf_bins(scored: DataFrame, n_bins: int = 100, by: list[str] | None = None) -> DataFrame:
    """Adds bin_id: quantile bins of maf over the SNPs with a statistic (-1 for the others)."""
    steps = [float(x) for x in np.linspace(0, 1, n_bins + 1)]
    keys = by or []
    edges = scored.where("raw_stat IS NOT NULL").groupBy(*keys).agg(F.percentile("maf", F.array(*[F.lit(s) for s in steps])).alias("_edges"))
    last = F.transform("_edges", lambda e, i: F.when(i == n_bins, e + 1e-9).otherwise(e))
    edges = edges.withColumn("_edges", last)
    joined = scored.join(F.broadcast(edges), keys, "left") if keys else scored.crossJoin(F.broadcast(edges))
    at = F.size(F.filter("_edges", lambda e: e <= F.col("maf"))) - 1
    return joined.withColumn("bin_id", F.when(F.col("raw_stat").isNotNull(), at).otherwise(-1).cast("long")).drop("_edges")


def bin_stats(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bins of at least two SNPs whose SD is not 0: their size, mean and sample SD."""
    keys = [*(by or []), "bin_id"]
    out = binned.where("bin_id >= 0").groupBy(*keys).agg(F.count("*").alias("n_snps"), F.avg("raw_stat").alias("mean"), F.stddev_samp("raw_stat").alias("sd"))
    return out.where("n_snps >= 2 AND sd > 0")


def z_scores(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds z_score and chi2_stat, null outside usable bins."""
    keys = [*(by or []), "bin_id"]
    z = (F.col("raw_stat") - F.col("mean")) / F.col("sd")
    joined = binned.join(bin_stats(binned, by).select(*keys, "mean", "sd"), keys, "left")
    return joined.withColumn("z_score", z).withColumn("chi2_stat", F.col("z_score") * F.col("z_score")).drop("mean", "sd")


def p_values(scored: DataFrame, tail: str = "upper") -> DataFrame:
    """Adds pval, neg_log10_p (null where pval is 0, so such SNPs are never significant by it) and direction."""
    if tail not in ("upper", "two-sided"):
        raise ValueError(f"tail must be 'upper' or 'two-sided', got {tail!r}")
    scored = with_workers(scored)
    p = normal_sf(F.col("z_score")) if tail == "upper" else chi2_sf(F.col("chi2_stat"))
    direction = F.when(F.col("z_score").isNull(), "").when(F.col("z_score") >= 0, "excess").otherwise("deficit")
    out = scored.withColumn("pval", p)
    return out.withColumn("neg_log10_p", F.when(F.col("pval") > 0, -F.log10("pval"))).withColumn("direction", direction)


def genomic_inflation(column: str = "chi2_stat") -> Column:
    return F.median(column) / F.lit(CHI2_MEDIAN)


def scan(counts: DataFrame, n_pairs: int, n_snps: int, n_bins: int = 100, tail: str = "upper", alpha: float = 0.05, fdr_alpha: float | None = None) -> DataFrame:
    """The whole scan: statistic, bins, z, p, Bonferroni and Benjamini-Hochberg flags."""
    out = p_values(z_scores(maf_bins(raw_statistic(counts, n_pairs, n_snps), n_bins)), tail)
    out = benjamini_hochberg(materialise(out, "scan"), "pval", "q_value")
    tests = out.agg(F.count("chi2_stat").alias("_tests"))
    line = -F.log10(F.try_divide(F.lit(alpha), F.col("_tests")))
    flagged = out.crossJoin(F.broadcast(tests)).withColumn("significant", _flag(F.col("neg_log10_p") >= line))
    return flagged.withColumn("significant_fdr", _flag(F.col("q_value") < (alpha if fdr_alpha is None else fdr_alpha))).drop("_tests")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def group_frequencies(panel: DataFrame, groups: DataFrame | None, overall: DataFrame, group: str) -> DataFrame:
    """panel with af for one group: from its rows of groups (group, snp_id, af) if it has any, else the overall ones (snp_id, af).

    A SNP without a frequency is an error in either case: a scan must not lose SNPs silently."""
    chosen, source = overall.select("snp_id", "af"), "overall"
    if groups is not None and not (own := groups.where(F.col("group") == group)).isEmpty():
        chosen, source = own.select("snp_id", "af"), f"group {group}"
    out = panel.join(chosen.dropDuplicates(["snp_id"]), "snp_id", "left")
    if missing := out.where("af IS NULL").count():
        raise ValueError(f"{missing} SNPs have no allele frequency in the {source} table")
    return out


def summary(scored: DataFrame, alpha: float = 0.05, fdr_alpha: float | None = None, tail: str = "upper", null: Null | None = None, pool: str = "global") -> DataFrame:
    """One row: every threshold on the -log10 p scale, what passes it, and the diagnostics of bins, inflation and permutation.

    Counts that need a permutation are -1 without one, its thresholds null."""
    fdr = alpha if fdr_alpha is None else fdr_alpha
    used = F.col("chi2_stat").isNotNull()
    by_bin = scored.where(used & (F.col("bin_id") >= 0)).groupBy("bin_id").count().agg(F.count("*").alias("n_bins_used"), F.max("count").alias("_top"))
    one = scored.agg(F.count("chi2_stat").alias("n_tests"), F.count_if("significant").alias("n_significant"), F.count_if("significant_fdr").alias("n_significant_fdr"), genomic_inflation().alias("lambda_gc"))
    tests = F.col("n_tests")
    out = one.crossJoin(F.broadcast(by_bin)).select(
        F.lit(alpha).alias("alpha"), "n_tests", (-F.log10(F.try_divide(F.lit(alpha), tests))).alias("neg_log10_p_threshold"), "n_significant", F.lit(fdr).alias("fdr_alpha"),
        F.when(F.col("n_significant_fdr") > 0, -F.log10(F.try_divide(F.col("n_significant_fdr") * fdr, tests))).alias("neg_log10_p_fdr_threshold"), "n_significant_fdr", F.lit(tail).alias("tail"),
        "n_bins_used", F.try_divide(F.col("_top").cast("double"), tests).alias("largest_bin_frac"), "lambda_gc",
    )
    if null is None:
        nothing, none = F.lit(None).cast("double"), F.lit(-1).cast("long")
        return out.withColumns({
            "neg_log10_p_perm_threshold": nothing, "n_significant_perm": none, "neg_log10_p_emp_fdr_threshold": nothing, "n_significant_fdr_perm": none, "n_perm": F.lit(0).cast("long"), "p_empirical_resolution": nothing,
            "q_empirical_floor": nothing, "frac_q_unreachable": nothing, "empirical_pool": F.lit(""), "perm_bin_tail_min": nothing, "perm_bin_tail_max": nothing,
        })
    rates = null.bins.where("rate IS NOT NULL").agg(F.min("rate").alias("perm_bin_tail_min"), F.max("rate").alias("perm_bin_tail_max"))
    draws = F.col("n_pool") if pool == "global" else F.coalesce("n_stratified", F.lit(0))
    reach = scored.where(used).crossJoin(F.broadcast(null.line)).crossJoin(F.broadcast(out.select("n_tests")))
    lowest = reach.withColumn("_floor", F.when(draws > 0, tests / (1.0 + draws)).otherwise(float("inf"))).agg(
        F.min("_floor").alias("q_empirical_floor"), F.avg((F.col("_floor") > fdr).cast("int")).alias("frac_q_unreachable"),
        F.min(F.when(F.col("significant_fdr_perm"), F.col("neg_log10_p"))).alias("neg_log10_p_emp_fdr_threshold"), F.count_if("significant_perm").alias("n_significant_perm"), F.count_if("significant_fdr_perm").alias("n_significant_fdr_perm"),
    )
    shown = null.line.select(F.col("threshold").alias("neg_log10_p_perm_threshold"), "n_perm", (1 / (1 + F.col("n_pool"))).alias("p_empirical_resolution"))
    return out.crossJoin(F.broadcast(shown)).crossJoin(F.broadcast(lowest)).crossJoin(F.broadcast(rates)).withColumn("empirical_pool", F.lit(pool))


def assemble(scored: DataFrame, null: Null | None = None, alpha: float = 0.05, fdr_alpha: float | None = None, tail: str = "upper", pool: str = "global", group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A scan with its permutation columns and q_empirical, and its summary row.

    pool says which empirical p-value drives q_empirical: "global" pools the null over all SNPs, "bin" stays within a MAF bin."""
    if pool not in ("global", "bin"):
        raise ValueError("pool must be 'global' or 'bin'")
    out = scored
    if null is not None:
        chosen = "p_empirical" if pool == "global" else "p_empirical_binned"
        out = out.join(null.values, "snp_ix", "left").crossJoin(F.broadcast(null.line.select(F.col("threshold").alias("_line"))))
        out = benjamini_hochberg(materialise(out.withColumn("significant_perm", _flag(F.col("neg_log10_p") >= F.col("_line"))).drop("_line"), "assembled"), chosen, "q_empirical")
        out = out.withColumn("significant_fdr_perm", _flag(F.col("q_empirical") < (alpha if fdr_alpha is None else fdr_alpha)))
    info = summary(out, alpha, fdr_alpha, tail, null, pool)
    if group is not None:
        out, info = out.select(F.lit(group).alias("group"), "*"), info.select(F.lit(group).alias("group"), "*")
    return out.drop("n_stratified"), info


def runs(cells: DataFrame) -> DataFrame:
    """sample1, sample2, first, last: unbroken runs of shared SNPs in panel order."""
    order = Window.partitionBy("sample1", "sample2").orderBy("snp_ix")
    island = F.col("snp_ix") - F.row_number().over(order)
    return cells.withColumn("_island", island).groupBy("sample1", "sample2", "_island").agg(F.min("snp_ix").alias("first"), F.max("snp_ix").alias("last")).drop("_island")


def shifted_counts(segments: DataFrame, shift: Column, n_perm: int, n_snps: int) -> DataFrame:
    """rep, snp_ix, n_pairs_ibd: sharing counts after every pair's runs moved round by its shift.

    shift: a pair's shift in terms of rep, sample1 and sample2, so only runs are repeated by replicate and
    nothing is joined. snp_ix runs from 0 to n_snps - 1; a run that passes the end goes on at the start.
    Runs become +1 and -1 events, summed by place before the prefix sum, which sees one replicate a task."""
    n = F.lit(n_snps)
    reps = F.sequence(F.lit(0).cast("long"), F.lit(n_perm - 1).cast("long"))
    moved = segments.withColumn("rep", F.explode(reps)).select("rep", F.pmod(F.col("first") + shift, n).alias("a"), (F.col("last") - F.col("first") + 1).alias("w"))
    event = lambda at, d: F.struct(at.cast("long").alias("at"), F.lit(d).alias("d"))
    stop = F.col("a") + F.col("w")
    around = F.array(event(F.col("a"), 1), event(F.lit(0), 1), event(stop - n, -1))
    events = moved.select("rep", F.explode(F.when(stop <= n, F.array(event(F.col("a"), 1), event(stop, -1))).otherwise(around)).alias("e"))
    by_place = events.select("rep", F.col("e.at").alias("snp_ix"), F.col("e.d").alias("d")).where(F.col("snp_ix") < n).groupBy("rep", "snp_ix").agg(F.sum("d").alias("d"))
    spine = segments.sparkSession.range(n_perm).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_snps - 1).cast("long"))).alias("snp_ix"))
    order = Window.partitionBy("rep").orderBy("snp_ix").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(by_place, ["rep", "snp_ix"], "left").select("rep", "snp_ix", F.sum(F.coalesce("d", F.lit(0))).over(order).alias("n_pairs_ibd"))


def drawn_shift(n_snps: int, seed: int = 0) -> Column:
    """Uniform in [0, n_snps) by hash of seed, replicate and pair, so that a rerun draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), "rep", "sample1", "sample2"), F.lit(n_snps))


def exceedances(null: DataFrame, seen: DataFrame, keys: list[str], ranges: int = 128) -> DataFrame:
    """seen (snp_ix, keys, score) with k, the null scores of its keys that reach its own, and n, all of them.

    Scores are dealt to ranges by quantiles of what was seen; a range is ranked in a task of its own and
    the counts of the ranges above it are added, so no task sees the whole null."""
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = F.broadcast(seen.agg(F.percentile("score", steps).alias("_edges")))
    at = F.size(F.filter("_edges", lambda e: e <= F.col("score"))).alias("_range")
    own = null.crossJoin(edges).select(*keys, "score", at, F.lit(None).cast("long").alias("snp_ix"))
    other = seen.crossJoin(edges).select(*keys, "score", at, "snp_ix")
    ranked = own.unionByName(other).withColumn("_k", F.count(F.when(F.col("snp_ix").isNull(), 1)).over(Window.partitionBy(*keys, "_range").orderBy(F.desc("score"))))
    sizes = own.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    spine = seen.select(*keys).distinct() if keys else seen.sparkSession.range(1).select()
    every = spine.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(ranges))).alias("_range")).join(sizes, [*keys, "_range"], "left").na.fill(0, ["_size"])
    part = Window.partitionBy(*(keys or [F.lit(0)]))  # one row a range
    above = every.select(*keys, "_range", (F.sum("_size").over(part.orderBy(F.desc("_range"))) - F.col("_size")).alias("_above"), F.sum("_size").over(part).alias("n"))
    return ranked.where("snp_ix IS NOT NULL").join(above, [*keys, "_range"]).select("snp_ix", (F.col("_k") + F.col("_above")).alias("k"), "n")


@dataclass(frozen=True)
class Null:
    """values: snp_ix, p_pointwise, p_empirical, p_empirical_binned, n_stratified; line: one row with threshold, n_perm and n_pool;
    bins: bin_id, n and rate, the share of the bin's null scores above the 99th percentile of the first replicate (null below 1000)."""

    values: DataFrame
    line: DataFrame
    bins: DataFrame


def permutation_null(observed: DataFrame, segments: DataFrame, n_pairs: int, n_snps: int, n_perm: int, alpha: float = 0.05, seed: int = 0, tail: str = "upper") -> Null:
    """Empirical p-values of a scan and the threshold of the replicates' maxima, on the -log10 p scale.

    Each replicate keeps the bins of the observed scan, its z are taken within bins, and exceedances count
    ties. Shifts keep the number of shared cells, so the centring needs no pass over a replicate. The
    threshold is the 1 - alpha quantile of the replicates' best -log10 p; p-values have the form (1 + k) / (1 + n)."""
    score = F.col("z_score") if tail == "upper" else F.abs("z_score")
    af = observed.select("snp_ix", "af", "maf", "bin_id")
    cells = segments.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    shifted = shifted_counts(segments, drawn_shift(n_snps, seed), n_perm, n_snps).join(af, "snp_ix")
    scored = z_scores(raw_statistic(shifted, n_pairs, n_snps, F.lit(float(cells))), by=["rep"])
    null = materialise(scored.where("z_score IS NOT NULL").select("rep", "snp_ix", "bin_id", score.alias("score"), "z_score", "chi2_stat"), "null")
    seen = materialise(observed.where("z_score IS NOT NULL").select("snp_ix", "bin_id", score.alias("score")), "seen")
    p = ((1 + F.col("k")) / (1 + F.col("n"))).alias
    point = null.join(seen.withColumnRenamed("score", "_seen"), ["snp_ix", "bin_id"]).groupBy("snp_ix").agg(F.count_if(F.col("score") >= F.col("_seen")).alias("k"))
    pointwise = seen.select("snp_ix").join(point, "snp_ix", "left").select("snp_ix", ((1 + F.coalesce("k", F.lit(0))) / F.lit(1 + n_perm)).alias("p_pointwise"))
    binned = exceedances(null, seen, ["bin_id"]).select("snp_ix", F.when(F.col("n") > 0, (1 + F.col("k")) / (1 + F.col("n"))).alias("p_empirical_binned"), F.col("n").alias("n_stratified"))
    values = pointwise.join(exceedances(null, seen, []).select("snp_ix", p("p_empirical")), "snp_ix").join(binned, "snp_ix")
    best = null.groupBy("rep").agg(F.max_by(F.struct("z_score", "chi2_stat"), "score").alias("top")).select("top.*")
    line = p_values(best, tail).agg(F.percentile("neg_log10_p", F.lit(1 - alpha)).alias("threshold"), F.lit(n_perm).cast("long").alias("n_perm")).crossJoin(F.broadcast(null.agg(F.count("*").alias("n_pool"))))
    reference = null.where("rep = 0").agg(F.percentile("score", F.lit(0.99)).alias("_ref"))
    bins = null.crossJoin(F.broadcast(reference)).groupBy("bin_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("_ref")).alias("_high"))
    return Null(values, line, bins.select("bin_id", "n", F.when(F.col("n") >= 1000, F.col("_high") / F.col("n")).alias("rate")))
