"""Queries of sequencing depth, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import coverage
from locusframe.plans.adapters import ctes, view

LENGTHS = [("chr1", 50_100), ("chr2", 50_100), ("chr3", 49_000)]


def _lengths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LENGTHS, "chrom string, length long")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_reads").where("mapq >= 30").join(F.broadcast(_lengths(spark)), "chrom")
    return rows.withColumn("end", F.least("end", "length")).select("sample", "chrom", "start", "end")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_runs(_reads(spark, sf_dir), _lengths(spark))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_panel").where("snp_ix % 40 = 1").select(F.concat(F.lit("chr"), (F.col("snp_ix") % 3 + 1).cast("string")).alias("chrom"), (F.col("snp_ix") * 23 % 48000).alias("start"), (F.col("snp_ix") * 23 % 48000 + 700).alias("end"))


def depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_runs(_reads(spark, sf_dir))


def depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_histogram(_runs(spark, sf_dir))


def depth_hist_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_histogram(_runs(spark, sf_dir), _regions(spark, sf_dir))


def depth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.depth_summary(coverage.depth_histogram(_runs(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "pct_zero", "pct_ge_1x", "pct_ge_5x", "pct_ge_10x", "pct_ge_20x")})


def depth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_windows(_runs(spark, sf_dir), lengths=_lengths(spark)).withColumn("mean_depth", F.round("mean_depth", 6))


def dropout_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.dropout_windows(view(spark, sf_dir, "v_windows"), min_depth=40, min_frac_samples=0.5)
    return out.withColumns({c: F.round(c, 8) for c in ("frac_samples_uncovered", "median_depth_across_samples", "mean_depth_across_samples")})


def dropout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.dropout_regions(view(spark, sf_dir, "v_windows"), min_depth=40, min_frac_samples=0.4, merge_gap=1000)
    return out.withColumns({c: F.round(c, 8) for c in ("frac_samples_uncovered", "median_depth_across_samples", "mean_depth_across_samples")})


QUERIES = {f.__name__: f for f in (depth_runs, depth_hist, depth_hist_regions, depth_summary, depth_windows, dropout_windows, dropout_regions)}

_LEN = "ln AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n})" for c, n in LENGTHS) + ") l(chrom, length))"
_BASE = f"""{ctes("v_reads", "v_panel")}, {_LEN}, rd AS (SELECT sample, r.chrom, start, least("end", length) AS fin FROM v_reads r JOIN ln USING (chrom) WHERE mapq >= 30 AND least("end", length) > start),
ev AS (SELECT sample, chrom, start AS pt, 1 AS d FROM rd UNION ALL SELECT sample, chrom, fin, -1 FROM rd {{extra}}),
sp AS (SELECT sample, chrom, pt, sum(d) AS d FROM ev GROUP BY ALL),
rn AS (SELECT sample, chrom, pt AS start, lead(pt) OVER w AS fin, CAST(sum(d) OVER w AS BIGINT) AS depth FROM sp WINDOW w AS (PARTITION BY sample, chrom ORDER BY pt))"""
_FULL = _BASE.format(extra="UNION ALL SELECT s.sample, ln.chrom, unnest([0, ln.length]), 0 FROM (SELECT DISTINCT sample FROM rd) s CROSS JOIN ln") + ", rs AS (SELECT * FROM rn WHERE fin IS NOT NULL), hs AS (SELECT sample, chrom, depth, CAST(sum(fin - start) AS BIGINT) AS bases FROM rs GROUP BY ALL)"
_DROP = """pw AS (SELECT chrom, start, "end" AS fin, count(DISTINCT sample) AS n_samples, avg((mean_depth < 40)::INT) AS f, median(mean_depth) AS md, avg(mean_depth) AS mn FROM v_windows GROUP BY ALL)"""

ORACLES = {
    "depth_runs": _BASE.format(extra="") + " SELECT sample, chrom, start, fin AS \"end\", depth FROM rn WHERE fin IS NOT NULL AND depth > 0",
    "depth_hist": f"{_FULL} SELECT sample, chrom, depth, bases FROM hs",
    "depth_hist_regions": f"""{_FULL}, bd AS (SELECT concat('chr', CAST(snp_ix % 3 + 1 AS VARCHAR)) AS chrom, snp_ix * 23 % 48000 AS start, snp_ix * 23 % 48000 + 700 AS fin FROM v_panel WHERE snp_ix % 40 = 1),
fr AS (SELECT *, CASE WHEN start <= max(fin) OVER (PARTITION BY chrom ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM bd),
il AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS g FROM fr), mg AS (SELECT chrom, min(start) AS bs, max(fin) AS be FROM il GROUP BY chrom, g)
SELECT sample, chrom, depth, CAST(sum(least(fin, be) - greatest(start, bs)) AS BIGINT) AS bases FROM rs JOIN mg USING (chrom) WHERE start < be AND fin > bs GROUP BY ALL""",
    "depth_summary": f"""{_FULL}, al AS (SELECT sample, chrom, depth, bases FROM hs UNION ALL SELECT sample, 'genome', depth, sum(bases) FROM hs GROUP BY sample, depth),
cm AS (SELECT *, sum(bases) OVER (PARTITION BY sample, chrom) AS n, sum(bases) OVER (PARTITION BY sample, chrom ORDER BY depth) AS cum FROM al)
SELECT sample, chrom, CAST(sum(bases) AS BIGINT) AS bases, round(sum(depth * bases)::DOUBLE / sum(bases), 6) AS mean, round(sqrt(greatest(sum(depth * depth * bases)::DOUBLE / sum(bases) - (sum(depth * bases)::DOUBLE / sum(bases)) ** 2, 0)), 6) AS sd,
  min(depth)::DOUBLE AS min, min(depth) FILTER (cum >= n * 0.5::DOUBLE)::DOUBLE AS median, min(depth) FILTER (cum >= n * 0.25::DOUBLE)::DOUBLE AS q1, min(depth) FILTER (cum >= n * 0.75::DOUBLE)::DOUBLE AS q3, max(depth)::DOUBLE AS max,
  round(100.0 * coalesce(sum(bases) FILTER (depth = 0), 0) / sum(bases)::DOUBLE, 6) AS pct_zero, """
    + ", ".join(f"round(100.0 * coalesce(sum(bases) FILTER (depth >= {t}), 0) / sum(bases)::DOUBLE, 6) AS pct_ge_{t}x" for t in coverage.THRESHOLDS)
    + ", 'runs' AS engine FROM cm GROUP BY sample, chrom",
    "depth_windows": f"""{_FULL}, ct AS (SELECT sample, chrom, depth, start, fin, unnest(range(start // 1000, (fin - 1) // 1000 + 1)) AS w FROM rs), sm AS (SELECT sample, chrom, w, sum(least(fin, (w + 1) * 1000) - greatest(start, w * 1000)) AS b, sum(depth * (least(fin, (w + 1) * 1000) - greatest(start, w * 1000))) AS s FROM ct GROUP BY ALL)
SELECT sample, chrom, w * 1000 AS start, least((w + 1) * 1000, length) AS "end", CAST(b AS BIGINT) AS bases, round(s::DOUBLE / b, 6) AS mean_depth FROM sm JOIN ln USING (chrom)""",
    "dropout_windows": f"{ctes('v_windows')}, {_DROP} SELECT chrom, start, fin AS \"end\", n_samples, round(f, 8) AS frac_samples_uncovered, round(md, 8) AS median_depth_across_samples, round(mn, 8) AS mean_depth_across_samples FROM pw WHERE f >= 0.5",
    "dropout_regions": f"""{ctes("v_windows")}, {_DROP}, fl AS (SELECT *, CASE WHEN start - max(fin) OVER (PARTITION BY chrom ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1000 THEN 0 ELSE 1 END AS fresh FROM pw WHERE f >= 0.4),
il AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS g FROM fl)
SELECT chrom, min(start) AS start, max(fin) AS "end", max(fin) - min(start) AS length, count(*) AS n_windows, max(n_samples) AS n_samples, round(avg(f), 8) AS frac_samples_uncovered, round(median(md), 8) AS median_depth_across_samples, round(avg(mn), 8) AS mean_depth_across_samples FROM il GROUP BY chrom, g""",
}
