"""Queries of identity by descent and the selection scan, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.coords import BP_PER_CM, PF3D7_LENGTHS
from locusframe.functions.stats import benjamini_hochberg, half_up
from locusframe.operators import ibd, selection
from locusframe.plans.adapters import ctes, view
from locusframe.tables import materialise

ACCESSIBLE = 20_000_000.0


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_blocks")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.ibd_cells(_blocks(spark, sf_dir), view(spark, sf_dir, "v_panel"))


def _size(df: DataFrame) -> int:
    return df.count()


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "v_panel")
    per = ibd.per_pair(_cells(spark, sf_dir), ibd.pair_index(_blocks(spark, sf_dir)), _size(panel))
    return ibd.annotate_pairs(per, view(spark, sf_dir, "v_meta").where("sample <> 's7'"), "region")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def ibd_block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.filter_blocks(_blocks(spark, sf_dir))


def ibd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.pair_index(_blocks(spark, sf_dir))


def ibd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("sample1", "sample2", "snp_ix")


def ibd_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "v_panel")
    return _round(ibd.per_pair(_cells(spark, sf_dir), ibd.pair_index(_blocks(spark, sf_dir)), _size(panel)), "frac_ibd")


def ibd_per_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ibd.pair_index(_blocks(spark, sf_dir))
    return _round(ibd.per_snp(_cells(spark, sf_dir), view(spark, sf_dir, "v_panel"), _size(pairs)), "frac_pairs_ibd").select("snp_ix", "n_pairs_ibd", "frac_pairs_ibd")


def ibd_per_snp_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ibd.per_snp_within_groups(_cells(spark, sf_dir), view(spark, sf_dir, "v_panel"), _annotated(spark, sf_dir))
    return _round(out, "frac_pairs_ibd").select("group", "snp_ix", "n_pairs_ibd", "n_pairs_total", "frac_pairs_ibd")


def ibd_per_snp_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ibd.per_snp_between_groups(_cells(spark, sf_dir), view(spark, sf_dir, "v_panel"), _annotated(spark, sf_dir))
    return _round(out, "frac_pairs_ibd").select("group_a", "group_b", "snp_ix", "n_pairs_ibd", "n_pairs_total", "frac_pairs_ibd")


def ibd_within_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ibd.within_between(_annotated(spark, sf_dir)), "mean", "median", "std")


def ibd_pairwise_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ibd.pairwise_groups(_annotated(spark, sf_dir)), "mean", "median", "std")


def ibd_per_chr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ibd.per_chromosome(_cells(spark, sf_dir), view(spark, sf_dir, "v_panel"), ibd.pair_index(_blocks(spark, sf_dir))), "mean", "median", "std")


def callable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.callable_spans(view(spark, sf_dir, "v_panel"))


def ibd_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ibd.pair_fraction(_blocks(spark, sf_dir), ACCESSIBLE, 23_000_000.0)
    return _round(out, "total_ibd_cm", "max_ibd_cm", "ibd_fraction_accessible", "gen_to_mrca_approx", "ibd_fraction_full_genome")


def snp_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibd.snp_density(view(spark, sf_dir, "v_panel"))


def gene_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ibd.gene_overlap(_blocks(spark, sf_dir), view(spark, sf_dir, "v_genes"), view(spark, sf_dir, "v_meta"), "region", within=500)
    return _round(out, "frac_pairs_ibd").select("gene_id", "group_a", "group_b", "n_pairs_ibd", "n_pairs_total", "frac_pairs_ibd")


def gene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ibd.gene_pairs(_blocks(spark, sf_dir), view(spark, sf_dir, "v_genes"), within=200)
    return found.withColumn("percent_covered", half_up(F.col("percent_covered"), 6))


def gene_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_blocks = _blocks(spark, sf_dir).where("Nsnp >= 46")
    return ibd.clusters(ibd.gene_sharers(long_blocks, view(spark, sf_dir, "v_genes")))


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Per-SNP sharing counts with an allele frequency in 1/64 steps (0 for some: those have no statistic)."""
    panel, pairs = view(spark, sf_dir, "v_panel"), ibd.pair_index(_blocks(spark, sf_dir))
    n_pairs, n_snps = _size(pairs), _size(panel)
    counts = ibd.per_snp(_cells(spark, sf_dir), panel, n_pairs).select("snp_ix", "n_pairs_ibd", (F.pmod(F.col("snp_ix") * 7, F.lit(64)) / F.lit(64.0)).alias("af"))
    return materialise(counts, "counts"), n_pairs, n_snps  # one row a SNP, read by every later step


def xirs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(selection.raw_statistic(*_counts(spark, sf_dir)), "maf", "raw_stat").select("snp_ix", "n_pairs_ibd", "maf", "raw_stat")


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.maf_bins(selection.raw_statistic(*_counts(spark, sf_dir)), n_bins=10)


def xirs_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(selection.bin_stats(_binned(spark, sf_dir)), "mean", "sd")


def xirs_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(selection.z_scores(_binned(spark, sf_dir)), "z_score", "chi2_stat").select("snp_ix", "bin_id", "z_score", "chi2_stat")


def lambda_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.z_scores(_binned(spark, sf_dir)).agg(F.round(selection.genomic_inflation(), 5).alias("lambda_gc"))


def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_panel").select("snp_ix", F.when(F.col("snp_ix") % 10 != 0, F.pmod(F.col("snp_ix") * 7919, F.lit(1009)) / F.lit(1009.0) * F.pmod(F.col("snp_ix"), F.lit(13)) / F.lit(13.0)).alias("p"))
    return _round(benjamini_hochberg(p, "p", "q"), "q").select("snp_ix", "q")


def xirs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan with its flags."""
    out = selection.scan(*_counts(spark, sf_dir), n_bins=10)
    return _round(out, "maf", "raw_stat", "z_score").select(
        "snp_ix", "n_pairs_ibd", "maf", "bin_id", "raw_stat", "z_score", F.round("pval", 6).alias("pval"), F.round("neg_log10_p", 6).alias("neg_log10_p"), F.round("q_value", 6).alias("q_value"), "direction", "significant", "significant_fdr"
    )


def xirs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = selection.summary(selection.scan(*_counts(spark, sf_dir), n_bins=10))
    rounded = [F.round(c, 5).alias(c) for c in ("neg_log10_p_threshold", "neg_log10_p_fdr_threshold", "largest_bin_frac", "lambda_gc")]
    return one.select("alpha", "n_tests", *rounded, "n_significant", "n_significant_fdr", "n_bins_used", "n_perm", "n_significant_perm")


def group_scan_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies for three groups: g0 and g1 have rows of their own, g2 falls back to the overall ones."""
    panel = view(spark, sf_dir, "v_panel").select("snp_ix", F.concat_ws(":", "chrom", "pos0").alias("snp_id"))
    overall = panel.select("snp_id", (F.pmod(F.col("snp_ix") * 7, F.lit(64)) / F.lit(64.0)).alias("af"))
    groups = panel.crossJoin(spark.range(2)).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("group"), "snp_id", (F.pmod(F.col("snp_ix") * (F.col("id") + 3), F.lit(32)) / F.lit(32.0)).alias("af"))
    parts = [selection.group_frequencies(panel, groups, overall, g).select(F.lit(g).alias("group"), "snp_ix", "af") for g in ("g0", "g1", "g2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ranked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the panel numbered from 0 in genome order."""
    panel = view(spark, sf_dir, "v_panel")
    numbered = panel.select(F.col("snp_ix").alias("_old"), (F.row_number().over(Window.orderBy("chrom", "pos0")) - 1).cast("long").alias("snp_ix"))
    return _cells(spark, sf_dir).withColumnRenamed("snp_ix", "_old").join(numbered, "_old").select("sample1", "sample2", "snp_ix")


def _fixed_shift(n: int) -> Column:
    number = lambda c: F.substring(c, 2, 9).cast("long")
    return F.pmod(F.col("rep") * 7919 + number("sample1") * 613 + number("sample2") * 37, F.lit(n))


def perm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after shifts fixed by arithmetic on replicate and sample numbers."""
    n = _size(view(spark, sf_dir, "v_panel"))
    return selection.shifted_counts(selection.runs(_ranked_cells(spark, sf_dir)), _fixed_shift(n), 3, n)


def perm_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, pairs = view(spark, sf_dir, "v_panel"), ibd.pair_index(_blocks(spark, sf_dir))
    n_pairs, n_snps = _size(pairs), _size(panel)
    cells = materialise(_ranked_cells(spark, sf_dir), "cells")
    spine = spark.range(n_snps).select(F.col("id").alias("snp_ix"), (F.pmod(F.col("id") * 7, F.lit(64)) / F.lit(64.0)).alias("af"))
    counts = spine.join(cells.groupBy("snp_ix").agg(F.count("*").alias("n_pairs_ibd")), "snp_ix", "left").na.fill(0, ["n_pairs_ibd"])
    scored = materialise(selection.scan(counts, n_pairs, n_snps, 10), "scored")
    null = selection.permutation_null(scored, selection.runs(cells), n_pairs, n_snps, n_perm=20)
    return selection.assemble(scored, null)[0]


def exceedance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null scores that reach a SNP's own, within its bin and over all, by arithmetic scores."""
    panel = view(spark, sf_dir, "v_panel")
    score = lambda k, m: F.pmod(F.col("snp_ix") * k + F.col("rep") * 31, F.lit(m)).cast("double")
    bin_id = F.pmod("snp_ix", F.lit(5)).alias("bin_id")
    null = panel.crossJoin(spark.range(4).select(F.col("id").alias("rep"))).select(bin_id, score(7919, 1009).alias("score"))
    seen = panel.withColumn("rep", F.lit(9)).select("snp_ix", bin_id, score(104729, 1013).alias("score"))
    inside = selection.exceedances(null, seen, ["bin_id"]).toDF("snp_ix", "k_bin", "n_bin")
    return inside.join(selection.exceedances(null, seen, []), "snp_ix")


QUERIES = {
    f.__name__: f
    for f in (
        ibd_block_filter, ibd_pairs, ibd_cells, ibd_per_pair, ibd_per_snp, ibd_per_snp_group, ibd_per_snp_group_pairs, ibd_within_between, ibd_pairwise_group, ibd_per_chr, callable_spans, ibd_fraction,
        snp_density, gene_overlap, gene_pairs, gene_clusters, xirs_raw, xirs_bins, xirs_zscore, lambda_gc, bh_qvalues, xirs_full, xirs_summary, group_scan_frequencies, perm_counts, exceedance_counts, perm_null,
    )
}

_BASE = f"""{ctes("v_blocks", "v_panel", "v_meta", "v_genes")}, pb AS (
  SELECT least(sample1, sample2) AS sample1, greatest(sample1, sample2) AS sample2, chr, start, "end" AS fin, different, Nsnp FROM v_blocks
), pairs AS (SELECT DISTINCT sample1, sample2 FROM pb), used AS (SELECT * FROM pb WHERE different = 0 AND fin - start >= 15000 AND Nsnp >= 15),
cells AS (SELECT DISTINCT sample1, sample2, chrom, pos0, snp_ix FROM used JOIN v_panel ON chr = chrom AND start <= pos0 AND pos0 < fin)"""
_ANN = f"""{_BASE}, meta AS (SELECT * FROM v_meta WHERE sample <> 's7'),
per AS (SELECT sample1, sample2, coalesce(n, 0) AS n_ibd_snps, coalesce(n, 0) / (SELECT count(*) FROM v_panel)::DOUBLE AS frac_ibd FROM pairs LEFT JOIN (SELECT sample1, sample2, count(*) AS n FROM cells GROUP BY ALL) USING (sample1, sample2)),
ann AS (SELECT per.*, coalesce(a.region, 'unknown') AS group1, coalesce(b.region, 'unknown') AS group2 FROM per LEFT JOIN meta a ON a.sample = sample1 LEFT JOIN meta b ON b.sample = sample2)"""
_MOM = "round(avg(frac_ibd), 6) AS mean, round(median(frac_ibd), 6) AS median, round(stddev_samp(frac_ibd), 6) AS std, count(*) AS count"
_XIRS = f"""{_BASE}, cnt AS (
  SELECT p.snp_ix, coalesce(n, 0) AS n, ((p.snp_ix * 7) % 64) / 64.0::DOUBLE AS af FROM v_panel p LEFT JOIN (SELECT snp_ix, count(*) AS n FROM cells GROUP BY snp_ix) USING (snp_ix)
), raw AS (
  SELECT snp_ix, n, af, CASE WHEN af <= 0.5 THEN af ELSE 1 - af END AS maf, CASE WHEN af > 0 AND af < 1 THEN
    (n - (SELECT sum(n) FROM cnt)::DOUBLE / (SELECT count(*) FROM v_panel)) / sqrt((SELECT count(*) FROM pairs)::DOUBLE * af * (1 - af)) END AS raw FROM cnt
)"""
_EDGES = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]::DOUBLE[]"
_Z = f"""{_XIRS}, e AS (SELECT quantile_cont(maf, {_EDGES}) AS q FROM raw WHERE raw IS NOT NULL),
b AS (SELECT raw.*, CASE WHEN raw IS NULL THEN -1 ELSE len(list_filter(list_transform(q, lambda x, i: CASE WHEN i = 11 THEN x + 1e-9::DOUBLE ELSE x END), lambda x: x <= maf)) - 1 END AS bin_id FROM raw, e),
bs AS (SELECT bin_id, count(*) AS n_snps, avg(raw) AS mean, stddev_samp(raw) AS sd FROM b WHERE bin_id >= 0 GROUP BY bin_id HAVING count(*) >= 2 AND stddev_samp(raw) > 0),
z AS (SELECT snp_ix, bin_id, (raw - mean) / sd AS z FROM b LEFT JOIN bs USING (bin_id))"""
#: Upper tail of the normal distribution: a series of positive terms below 2.5 root 2, a continued fraction beyond.
TAIL_SQL = """e0 AS (SELECT z.*, abs(z) / sqrt(2.0::DOUBLE) AS x FROM z),
e1 AS (SELECT *, CASE WHEN x < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-x * x) * x * list_reduce([1.0::DOUBLE] || range(90, -1, -1)::DOUBLE[], lambda a, n: 1 + 2 * x * x / (2 * n + 3) * a)
  ELSE exp(-x * x) / (x * sqrt(pi())) / list_reduce([1.0::DOUBLE] || range(200, 0, -1)::DOUBLE[], lambda a, k: 1 + k / (2 * x * x) / a) END AS erfc FROM e0),
pv AS (SELECT e1.* EXCLUDE (x, erfc), CASE WHEN z >= 0 THEN erfc / 2 ELSE 1 - erfc / 2 END AS p FROM e1)"""
_TAIL = f"""{TAIL_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY p IS NOT NULL ORDER BY p) AS k, count(*) OVER (PARTITION BY p IS NOT NULL) AS m FROM pv),
sc AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / k) OVER (PARTITION BY p IS NOT NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM rk),
fl AS (SELECT *, coalesce(p > 0 AND p <= 0.05::DOUBLE / m, false) AS significant, coalesce(q < 0.05::DOUBLE, false) AS significant_fdr FROM sc)"""
_HITS = f"""hits AS (
  SELECT sample1, sample2, u.chr, u.start AS block_start, u.fin AS block_end, g.name AS gene, g.gene_id, g.start AS gene_start, g."end" AS gene_end FROM {{used}} u JOIN v_genes g ON u.chr = g.chr AND u.start < g."end" + {{pad}} AND u.fin > g.start - {{pad}}
)"""

ORACLES = {
    "ibd_block_filter": f"{ctes('v_blocks')} SELECT * FROM v_blocks WHERE \"end\" - start >= 15000 AND Nsnp >= 15",
    "ibd_pairs": f"{_BASE} SELECT * FROM pairs",
    "ibd_cells": f"{_BASE} SELECT sample1, sample2, snp_ix FROM cells",
    "ibd_per_pair": f"{_ANN} SELECT sample1, sample2, n_ibd_snps, round(frac_ibd, 6) AS frac_ibd FROM per",
    "ibd_per_snp": f"{_BASE} SELECT snp_ix, coalesce(n, 0) AS n_pairs_ibd, round(coalesce(n, 0) / (SELECT count(*) FROM pairs)::DOUBLE, 6) AS frac_pairs_ibd FROM v_panel LEFT JOIN (SELECT snp_ix, count(*) AS n FROM cells GROUP BY snp_ix) USING (snp_ix)",
    "ibd_per_snp_group": f"""{_ANN}, k AS (SELECT *, group1 AS "group" FROM ann WHERE group1 = group2 AND group1 <> 'unknown'), t AS (SELECT "group", count(*) AS n_pairs_total FROM k GROUP BY 1),
c AS (SELECT "group", snp_ix, count(*) AS n FROM cells JOIN k USING (sample1, sample2) GROUP BY 1, 2)
SELECT "group", snp_ix, coalesce(n, 0) AS n_pairs_ibd, n_pairs_total, round(coalesce(n, 0)::DOUBLE / n_pairs_total, 6) AS frac_pairs_ibd FROM t CROSS JOIN v_panel LEFT JOIN c USING ("group", snp_ix)""",
    "ibd_per_snp_group_pairs": f"""{_ANN}, k AS (SELECT *, least(group1, group2) AS group_a, greatest(group1, group2) AS group_b FROM ann WHERE group1 <> 'unknown' AND group2 <> 'unknown'), t AS (SELECT group_a, group_b, count(*) AS n_pairs_total FROM k GROUP BY 1, 2),
c AS (SELECT group_a, group_b, snp_ix, count(*) AS n FROM cells JOIN k USING (sample1, sample2) GROUP BY 1, 2, 3)
SELECT group_a, group_b, snp_ix, coalesce(n, 0) AS n_pairs_ibd, n_pairs_total, round(coalesce(n, 0)::DOUBLE / n_pairs_total, 6) AS frac_pairs_ibd FROM t CROSS JOIN v_panel LEFT JOIN c USING (group_a, group_b, snp_ix)""",
    "ibd_within_between": f"{_ANN} SELECT CASE WHEN group1 = group2 THEN 'within_group' ELSE 'between_group' END AS comparison_type, {_MOM} FROM ann GROUP BY 1",
    "ibd_pairwise_group": f"{_ANN} SELECT least(group1, group2) AS reg_a, greatest(group1, group2) AS reg_b, {_MOM} FROM ann GROUP BY 1, 2",
    "ibd_per_chr": f"""{_BASE}, w AS (SELECT chrom, count(*) AS m FROM v_panel GROUP BY chrom), f AS (
  SELECT chrom, coalesce(n, 0)::DOUBLE / m AS x FROM pairs CROSS JOIN w LEFT JOIN (SELECT sample1, sample2, chrom, count(*) AS n FROM cells GROUP BY ALL) USING (sample1, sample2, chrom))
SELECT chrom, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std FROM f GROUP BY chrom""",
    "callable_spans": ctes("v_panel") + " SELECT replace(chrom, 'chr', '') AS chr, min(pos0) AS first, max(pos0) AS last, count(*) AS n_snps, max(pos0) - min(pos0) AS span, CAST(any_value(length) AS BIGINT) AS length FROM v_panel LEFT JOIN (VALUES "
    + ", ".join(f"('{c}', {n})" for c, n in PF3D7_LENGTHS.items()) + ") l(c, length) ON c = replace(chrom, 'chr', '') GROUP BY 1",
    "ibd_fraction": f"""{_BASE}, s AS (SELECT sample1, sample2, CAST(coalesce(sum(fin - start), 0) AS BIGINT) AS t, coalesce(max(fin - start), 0) AS m FROM pairs LEFT JOIN used USING (sample1, sample2) GROUP BY ALL)
SELECT concat(sample1, '__', sample2) AS pair, sample1, sample2, t AS total_ibd_bp, m AS max_ibd_bp, round(t / {BP_PER_CM}::DOUBLE, 6) AS total_ibd_cm, round(m / {BP_PER_CM}::DOUBLE, 6) AS max_ibd_cm, round(t / {ACCESSIBLE}::DOUBLE, 6) AS ibd_fraction_accessible,
  CASE WHEN t > 0 THEN round(greatest(0.0, log2(1 / least(greatest(t / {ACCESSIBLE}::DOUBLE, 1e-6::DOUBLE), 1.0))), 6) END AS gen_to_mrca_approx, round(t / 23000000.0::DOUBLE, 6) AS ibd_fraction_full_genome FROM s""",
    "snp_density": ctes("v_panel") + ", l AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n // int(BP_PER_CM)})" for c, n in PF3D7_LENGTHS.items())
    + ") l(chr, n)), sp AS (SELECT chr, unnest(range(n)) AS win FROM l), c AS (SELECT replace(chrom, 'chr', '') AS chr, pos0 // 15000 AS win, count(*) AS k FROM v_panel GROUP BY 1, 2) SELECT chr, win, coalesce(k, 0) AS n_snps FROM sp LEFT JOIN c USING (chr, win)",
    "gene_overlap": f"""{_BASE}, {_HITS.format(used="used", pad=500)}, seen AS (SELECT DISTINCT sample FROM (SELECT sample1 AS sample FROM v_blocks UNION ALL SELECT sample2 FROM v_blocks)), sz AS (SELECT region AS g, count(*) AS n FROM seen JOIN v_meta USING (sample) GROUP BY 1),
tt AS (SELECT a.g AS group_a, b.g AS group_b, CASE WHEN a.g = b.g THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs_total FROM sz a JOIN sz b ON a.g <= b.g),
c AS (SELECT gene_id, least(a.region, b.region) AS group_a, greatest(a.region, b.region) AS group_b, count(*) AS n FROM (SELECT DISTINCT gene_id, sample1, sample2 FROM hits) h JOIN v_meta a ON a.sample = sample1 JOIN v_meta b ON b.sample = sample2 GROUP BY ALL)
SELECT gene_id, group_a, group_b, coalesce(n, 0) AS n_pairs_ibd, n_pairs_total, round(coalesce(n, 0)::DOUBLE / nullif(n_pairs_total, 0), 6) AS frac_pairs_ibd FROM v_genes CROSS JOIN tt LEFT JOIN c USING (gene_id, group_a, group_b)""",
    "gene_pairs": f"""{_BASE}, {_HITS.format(used="used", pad=200)}, k AS (SELECT *, greatest(block_start, gene_start) AS lo, least(block_end, gene_end) AS hi FROM hits)
SELECT sample1, sample2, chr, block_start, block_end, gene, gene_id, gene_start, gene_end, CASE WHEN block_start <= gene_start AND block_end >= gene_end THEN 'complete' ELSE 'partial' END AS coverage, CASE WHEN hi > lo THEN lo END AS covered_start, CASE WHEN hi > lo THEN hi END AS covered_end,
  greatest(hi - lo, 0) AS covered_bp, round(100.0 * greatest(hi - lo, 0) / nullif(gene_end - gene_start, 0)::DOUBLE, 6) AS percent_covered FROM k""",
    "gene_clusters": f"""{_BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, {_HITS.format(used="(SELECT * FROM used WHERE Nsnp >= 46)", pad=0)}, ed AS (SELECT DISTINCT gene_id, sample1 AS a, sample2 AS b FROM hits UNION SELECT DISTINCT gene_id, sample2, sample1 FROM hits),
reach AS (SELECT gene_id, a AS node, a AS r FROM ed UNION SELECT reach.gene_id, node, ed.b FROM reach JOIN ed ON ed.gene_id = reach.gene_id AND ed.a = reach.r),
lab AS (SELECT gene_id, node, min(r) AS label FROM reach GROUP BY 1, 2), sz AS (SELECT gene_id, label, count(*) AS n, row_number() OVER (PARTITION BY gene_id ORDER BY count(*) DESC, label) AS id FROM lab GROUP BY gene_id, label)
SELECT gene_id, node AS sample, id AS gene_cluster_id, n AS gene_cluster_size FROM lab JOIN sz USING (gene_id, label)""",
    "xirs_raw": f"{_XIRS} SELECT snp_ix, n AS n_pairs_ibd, round(maf, 6) AS maf, round(raw, 6) AS raw_stat FROM raw",
    "xirs_bins": f"{_Z} SELECT bin_id, n_snps, round(mean, 6) AS mean, round(sd, 6) AS sd FROM bs",
    "xirs_zscore": f"{_Z} SELECT snp_ix, bin_id, round(z, 6) AS z_score, round(z * z, 6) AS chi2_stat FROM z",
    "xirs_full": f"""{_Z}, {_TAIL} SELECT snp_ix, n AS n_pairs_ibd, round(maf, 6) AS maf, bin_id, round(raw, 6) AS raw_stat, round(z, 6) AS z_score, round(p, 6) AS pval, CASE WHEN p > 0 THEN round(-log10(p), 6) END AS neg_log10_p,
  round(q, 6) AS q_value, CASE WHEN z IS NULL THEN '' WHEN z >= 0 THEN 'excess' ELSE 'deficit' END AS direction, significant, significant_fdr FROM fl JOIN raw USING (snp_ix)""",
    "xirs_summary": f"""{_Z}, {_TAIL}, u AS (SELECT count(z) AS t, count(*) FILTER (significant) AS s, count(*) FILTER (significant_fdr) AS f, median(z * z) / 0.45493642311957::DOUBLE AS l FROM fl),
w AS (SELECT count(*) AS nb, max(c) AS top FROM (SELECT count(*) AS c FROM fl WHERE z IS NOT NULL AND bin_id >= 0 GROUP BY bin_id))
SELECT 0.05::DOUBLE AS alpha, t AS n_tests, round(-log10(0.05::DOUBLE / t), 5) AS neg_log10_p_threshold, CASE WHEN f > 0 THEN round(-log10(f * 0.05::DOUBLE / t), 5) END AS neg_log10_p_fdr_threshold, round(top / t::DOUBLE, 5) AS largest_bin_frac,
  round(l, 5) AS lambda_gc, s AS n_significant, f AS n_significant_fdr, nb AS n_bins_used, 0::BIGINT AS n_perm, -1::BIGINT AS n_significant_perm FROM u, w""",
    "group_scan_frequencies": f"""{ctes("v_panel")} SELECT 'g' || CAST(i AS VARCHAR) AS "group", snp_ix, CASE WHEN i < 2 THEN ((snp_ix * (i + 3)) % 32) / 32.0::DOUBLE ELSE ((snp_ix * 7) % 64) / 64.0::DOUBLE END AS af FROM v_panel CROSS JOIN (SELECT unnest(range(3)) AS i)""",
    "exceedance_counts": f"""{ctes("v_panel")}, nu AS (SELECT snp_ix % 5 AS b, CAST((snp_ix * 7919 + rep * 31) % 1009 AS DOUBLE) AS s FROM v_panel CROSS JOIN (SELECT unnest(range(4)) AS rep)),
ob AS (SELECT snp_ix, snp_ix % 5 AS b, CAST((snp_ix * 104729 + 9 * 31) % 1013 AS DOUBLE) AS s FROM v_panel),
al AS (SELECT snp_ix, b, s FROM ob UNION ALL SELECT NULL, b, s FROM nu),
kk AS (SELECT snp_ix, count(*) FILTER (snp_ix IS NULL) OVER (PARTITION BY b ORDER BY s DESC) AS k_bin, count(*) FILTER (snp_ix IS NULL) OVER (PARTITION BY b) AS n_bin,
  count(*) FILTER (snp_ix IS NULL) OVER (ORDER BY s DESC) AS k, count(*) FILTER (snp_ix IS NULL) OVER () AS n FROM al) SELECT * FROM kk WHERE snp_ix IS NOT NULL""",
    "lambda_gc": f"{_Z} SELECT round(median(z * z) / 0.45493642311957::DOUBLE, 5) AS lambda_gc FROM z",
    "bh_qvalues": f"""{ctes("v_panel")}, p AS (SELECT snp_ix, CASE WHEN snp_ix % 10 <> 0 THEN (snp_ix * 7919) % 1009 / 1009.0::DOUBLE * (snp_ix % 13) / 13.0::DOUBLE END AS p FROM v_panel),
r AS (SELECT *, row_number() OVER (PARTITION BY p IS NOT NULL ORDER BY p) AS k, count(*) OVER (PARTITION BY p IS NOT NULL) AS m FROM p)
SELECT snp_ix, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * m / k) OVER (PARTITION BY p IS NOT NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) END AS q FROM r""",
    "perm_counts": f"""{_BASE}, num AS (SELECT snp_ix, row_number() OVER (ORDER BY chrom, pos0) - 1 AS k FROM v_panel), tot AS (SELECT count(*) AS n FROM v_panel),
sh AS (SELECT rep, (k + (rep * 7919 + CAST(substr(sample1, 2) AS BIGINT) * 613 + CAST(substr(sample2, 2) AS BIGINT) * 37) % n) % n AS k FROM cells JOIN num USING (snp_ix) CROSS JOIN tot CROSS JOIN (SELECT unnest(range(3)) AS rep)),
c AS (SELECT rep, k, count(*) AS m FROM sh GROUP BY 1, 2)
SELECT rep, num.k AS snp_ix, CAST(coalesce(m, 0) AS BIGINT) AS n_pairs_ibd FROM num CROSS JOIN (SELECT unnest(range(3)) AS rep) LEFT JOIN c USING (rep, k)""",
}
