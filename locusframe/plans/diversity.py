"""Queries of within-host diversity, allele frequencies and genotypes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import genotype as g
from locusframe.operators import freqs, fws, wsaf
from locusframe.plans.adapters import ctes, view

#: Genotypes from depths of up to three alleles: top and second allele by depth, ties to the lower index.
GT = """v_rank AS (
  SELECT *, d0 + d1 + d2 AS dp, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS top FROM v_ad
), v_second AS (
  SELECT *, CASE top WHEN 0 THEN CASE WHEN d1 >= d2 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN d0 >= d2 THEN 0 ELSE 2 END ELSE CASE WHEN d0 >= d1 THEN 0 ELSE 1 END END AS sec FROM v_rank
), v_gt AS (
  SELECT *, CASE WHEN dp = 0 THEN NULL WHEN dsec = 0 OR dsec / dp::DOUBLE < 0.2::DOUBLE THEN top ELSE least(top, sec) END AS a0,
    CASE WHEN dp = 0 THEN NULL WHEN dsec = 0 OR dsec / dp::DOUBLE < 0.2::DOUBLE THEN top ELSE greatest(top, sec) END AS a1
  FROM (SELECT *, CASE sec WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS dsec FROM v_second)
)"""


def depth_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_ad with ad, alts and gt as arrays."""
    ad = F.when(F.col("n_alts") == 2, F.array("d0", "d1", "d2")).otherwise(F.array("d0", "d1")).cast("array<int>")
    alts = F.when(F.col("n_alts") == 2, F.array(F.lit("T"), F.lit("G"))).otherwise(F.array(F.lit("T")))
    return view(spark, sf_dir, "v_ad").withColumn("ad", ad).withColumn("alts", alts).withColumn("gt", g.call_genotype(F.col("ad")))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """As the other engine rounds: the product with the power of ten, not the shortest decimal, goes to the nearest."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**places) / 10.0**places for c in columns})


def fws_site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fws.site_stats(view(spark, sf_dir, "v_calls")), "p", "maf", "hs").select("site", "p", "maf", "hs", "alt_present")


def fws_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fws.fws_report(fws.fws(view(spark, sf_dir, "v_calls")))


def fws_regression_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fws.fws_report(fws.fws(view(spark, sf_dir, "v_calls"), min_depth=20, min_alt_samples=3))


def fws_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fws.fws_report(fws.fws(view(spark, sf_dir, "v_calls"), estimator="ratio", min_depth=10))


def allele_freqs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(freqs.allele_freqs(depth_cells(spark, sf_dir).select("site", "sample", "gt", "ad", "alts")), *_RATES)


def allele_freqs_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(freqs.allele_freqs(depth_cells(spark, sf_dir).select("site", "sample", "grp", "gt", "ad", "alts"), group="grp"), *_RATES)


def allele_freqs_per_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(freqs.allele_freqs(depth_cells(spark, sf_dir).select("site", "sample", "gt", "ad", "alts"), per_alt=True), *_RATES)


_RATES = ("af", "maf", "af_weighted", "prevalence", "prevalence_ad")


def regenotype_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_cells(spark, sf_dir).select("site", "sample", F.get("gt", 0).alias("a0"), F.get("gt", 1).alias("a1"))


def regenotype_haploid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_cells(spark, sf_dir).select("site", "sample", F.get(g.call_genotype(F.col("ad"), ploidy=1), 0).alias("a0"))


def regenotype_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = g.call_within(F.col("ad"), F.array(F.lit(0), F.lit(1)))
    return depth_cells(spark, sf_dir).select("site", "sample", F.get(called, 0).alias("a0"), F.get(called, 1).alias("a1"))


def clean_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = depth_cells(spark, sf_dir).withColumn("c", g.clean_ad(F.col("ad"), min_reads=5, min_freq=0.2))
    return cleaned.select("site", "sample", *[F.coalesce(F.get("c", i), F.lit(0)).cast("long").alias(f"c{i}") for i in range(3)])


def _wsaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsaf.site_fractions(depth_cells(spark, sf_dir).select("site", "sample", "ad"))


def wsaf_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_wsaf(spark, sf_dir), "minor_frac", "alt_frac", "plaf", "wsmaf").where("het").drop("het")


def wsaf_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wsaf.histogram(_wsaf(spark, sf_dir))


def wsaf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(wsaf.profile(_wsaf(spark, sf_dir), max_residual_het=0.25, min_sites=500), "het_rate", "min_freq_needed", "dominant_frac", "residual_het_rate", "minor_mode", "minor_median", "minor_q95", "wsmaf_mean")


QUERIES = {
    f.__name__: f
    for f in (
        fws_site_stats, fws_regression, fws_regression_deep, fws_ratio, allele_freqs_global, allele_freqs_group, allele_freqs_per_alt,
        regenotype_default, regenotype_haploid, regenotype_restricted, clean_depths, wsaf_sites, wsaf_hist, wsaf_profile,
    )
}


def _bins(edges: list[float]) -> str:
    return " + ".join(f"(maf >= {e!r}::DOUBLE)::INT" for e in edges)


_SITES = """s0 AS (
  SELECT site, sum(alt_ad)::DOUBLE / nullif(sum(ref_ad + alt_ad), 0) AS p, count(*) FILTER (alt_ad > 0) AS alt_present FROM v_calls GROUP BY site
), s AS (SELECT site, p, least(p, 1 - p) AS maf, 2 * p * (1 - p) AS hs, alt_present FROM s0),
cells AS (SELECT site, sample, ref_ad + alt_ad AS depth, alt_ad::DOUBLE / nullif(ref_ad + alt_ad, 0) AS q FROM v_calls)"""


def _regression(min_depth: int, min_alt: int) -> str:
    return f"""{ctes("v_calls")}, {_SITES},
ok AS (SELECT *, {_bins(fws.edges(10))} AS bin FROM s WHERE maf IS NOT NULL AND alt_present >= {min_alt}),
x AS (SELECT bin, avg(hs) AS x FROM ok GROUP BY bin),
y AS (SELECT sample, bin, avg(2 * q * (1 - q)) AS y, count(*) AS n FROM cells JOIN ok USING (site) WHERE depth > 0 AND depth >= {min_depth} GROUP BY sample, bin),
f AS (SELECT sample, 1 - sum(x * y) / nullif(sum(x * x), 0) AS fws, sum(n) AS n FROM y JOIN x USING (bin) GROUP BY sample)
SELECT sample, round(fws, 6) AS fws, CAST(CASE WHEN fws IS NULL THEN 0 ELSE n END AS BIGINT) AS n_sites, fws >= 0.95 AS monoclonal
FROM (SELECT DISTINCT sample FROM v_calls) LEFT JOIN f USING (sample)"""


def _freqs(keys: str, hit: str, share: str, reads: str, source: str, extra: str = "") -> str:
    return f"""{ctes("v_ad")}, {GT}, cells AS (
  SELECT *, ({hit}) AS hit, CASE WHEN a0 IS NULL THEN 0 ELSE 2 END AS called, CASE WHEN dp > 0 THEN {share} END AS share, {reads} AS reads FROM {source}
)
SELECT {keys}, round(af, 6) AS af, round(least(af, 1 - af), 6) AS maf, ac, an, round(w / nullif(n_samples_ad, 0), 6) AS af_weighted, n_samples_ad, round(n_samples_alt::DOUBLE / nullif(n_samples, 0), 6) AS prevalence,
  n_samples_alt, n_samples, round(n_samples_alt_ad::DOUBLE / nullif(n_samples_ad, 0), 6) AS prevalence_ad, n_samples_alt_ad
FROM (
  SELECT {keys}, CAST(sum(hit) AS BIGINT) AS ac, CAST(sum(called) AS BIGINT) AS an, sum(hit)::DOUBLE / nullif(sum(called), 0) AS af, sum(share) AS w, count(share) AS n_samples_ad, count(*) FILTER (hit > 0) AS n_samples_alt,
    count(*) FILTER (called > 0) AS n_samples, count(*) FILTER (share IS NOT NULL AND reads >= 2 AND share >= 0.01::DOUBLE) AS n_samples_alt_ad
  FROM cells GROUP BY {keys}
)"""


_ANY = "CASE WHEN a0 > 0 THEN 1 ELSE 0 END + CASE WHEN a1 > 0 THEN 1 ELSE 0 END"
_EVERY_GROUP = """(SELECT s.site, s.n_alts, g.grp, v.d0, v.d1, v.d2, v.dp, v.a0, v.a1 FROM (SELECT DISTINCT site, n_alts FROM v_gt) s CROSS JOIN (SELECT DISTINCT grp FROM v_gt) g
  LEFT JOIN v_gt v ON v.site = s.site AND v.grp = g.grp)"""
_WSAF = f"""{ctes("v_ad")}, w0 AS (
  SELECT site, sample, CASE WHEN n_alts = 2 THEN d0 + d1 + d2 ELSE d0 + d1 END AS depth, d0, d1 + d2 AS alt, list_sort([d0, d1, d2])[-2] AS sec FROM v_ad
), w1 AS (
  SELECT site, sample, sec, sec::DOUBLE / depth AS minor_frac, alt::DOUBLE / depth AS alt_frac, avg(alt::DOUBLE / depth) OVER (PARTITION BY site) AS plaf FROM w0 WHERE depth >= 10
), w AS (SELECT *, minor_frac >= 0.02::DOUBLE AND sec >= 2 AS het, CASE WHEN plaf <= 0.5 THEN alt_frac ELSE 1 - alt_frac END AS wsmaf FROM w1),
h AS (SELECT sample, CAST(least(floor(minor_frac / 0.01::DOUBLE), 49) AS INT) AS bin, count(*) AS n FROM w WHERE het GROUP BY ALL)"""
_CENTRE = "(round({0} * 0.01::DOUBLE, 10) + round(({0} + 1) * 0.01::DOUBLE, 10)) / 2"

ORACLES = {
    "fws_site_stats": f"{ctes('v_calls')}, {_SITES} SELECT site, round(p, 6) AS p, round(maf, 6) AS maf, round(hs, 6) AS hs, alt_present FROM s",
    "fws_regression": _regression(0, 0),
    "fws_regression_deep": _regression(20, 3),
    "fws_ratio": f"""{ctes("v_calls")}, {_SITES},
ok AS (SELECT *, {_bins(fws.edges(10)[1:-1])} AS bin FROM s WHERE hs > 0),
b AS (SELECT sample, bin, avg(2 * q * (1 - q)) AS hw, avg(hs) AS hs, count(*) AS n FROM cells JOIN ok USING (site) WHERE depth >= 10 GROUP BY sample, bin),
f AS (SELECT sample, 1 - sum(hw) / nullif(sum(hs), 0) AS fws, sum(n) AS n FROM b GROUP BY sample)
SELECT sample, round(fws, 6) AS fws, CAST(CASE WHEN fws IS NULL THEN 0 ELSE n END AS BIGINT) AS n_sites, fws >= 0.95 AS monoclonal FROM (SELECT DISTINCT sample FROM v_calls) LEFT JOIN f USING (sample)""",
    "allele_freqs_global": _freqs("site, n_alts", _ANY, "1.0::DOUBLE - d0::DOUBLE / dp", "dp - d0", "v_gt"),
    "allele_freqs_group": _freqs("site, n_alts, grp", _ANY, "1.0::DOUBLE - d0::DOUBLE / dp", "dp - d0", _EVERY_GROUP),
    "allele_freqs_per_alt": _freqs(
        "site, n_alts, alt, alt_index", "CASE WHEN a0 = alt_index THEN 1 ELSE 0 END + CASE WHEN a1 = alt_index THEN 1 ELSE 0 END", "(CASE alt_index WHEN 1 THEN d1 ELSE d2 END)::DOUBLE / dp",
        "CASE alt_index WHEN 1 THEN d1 ELSE d2 END", "(SELECT v_gt.*, k.alt, k.alt_index FROM v_gt JOIN (VALUES ('T', 1), ('G', 2)) k(alt, alt_index) ON k.alt_index <= n_alts)",
    ),
    "regenotype_default": f"{ctes('v_ad')}, {GT} SELECT site, sample, a0, a1 FROM v_gt",
    "regenotype_haploid": f"{ctes('v_ad')}, {GT} SELECT site, sample, CASE WHEN dp = 0 THEN NULL ELSE top END AS a0 FROM v_gt",
    "regenotype_restricted": f"{ctes('v_ad')} SELECT site, sample, CASE WHEN d0 > 0 THEN 0 WHEN d1 > 0 THEN 1 END AS a0, CASE WHEN d1 > 0 THEN 1 WHEN d0 > 0 THEN 0 END AS a1 FROM v_ad",
    "clean_depths": ctes("v_ad") + " SELECT site, sample, " + ", ".join(f"CASE WHEN d{i} < 5 OR coalesce(d{i}::DOUBLE / nullif(d0 + d1 + d2, 0), 0) < 0.2::DOUBLE THEN 0 ELSE d{i} END AS c{i}" for i in range(3)) + " FROM v_ad",
    "wsaf_sites": f"{_WSAF} SELECT site, sample, round(minor_frac, 6) AS minor_frac, round(alt_frac, 6) AS alt_frac, round(plaf, 6) AS plaf, round(wsmaf, 6) AS wsmaf FROM w WHERE het",
    "wsaf_hist": f"{_WSAF} SELECT sample, bin, n FROM h",
    "wsaf_profile": f"""{_WSAF}, t AS (
  SELECT sample, count(*) AS n_sites, count(*) FILTER (het) AS n_het, avg(wsmaf) FILTER (het) AS wsmaf_mean FROM w GROUP BY sample
), g AS (
  SELECT t.sample, n_sites, n_het, k.bin, coalesce(h.n, 0) AS n FROM t CROSS JOIN (SELECT unnest(range(50))::INT AS bin) k LEFT JOIN h ON h.sample = t.sample AND h.bin = k.bin
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY bin DESC) AS above, sum(n) OVER (PARTITION BY sample ORDER BY bin) AS upto FROM g
), need AS (
  SELECT sample, min(bin) FILTER (bin >= 2 AND above / n_sites::DOUBLE < 0.25::DOUBLE) AS nb, sum(n) FILTER (bin >= 30) / any_value(n_sites)::DOUBLE AS residual,
    arg_max(bin, struct_pack(n := n, b := -bin)) AS mode, min(bin) FILTER (upto >= n_het * 0.5::DOUBLE) AS med, min(bin) FILTER (upto >= n_het * 0.95::DOUBLE) AS q95 FROM c GROUP BY sample
), co AS (SELECT sample, bin // 2 AS b, sum(n) AS n FROM g GROUP BY ALL),
ta AS (SELECT sample, b, n >= greatest(1.0, max(n) OVER (PARTITION BY sample) * 0.1::DOUBLE) AS tall FROM co),
ba AS (SELECT sample, count(*) FILTER (tall AND NOT coalesce(prev, false)) AS bands FROM (SELECT *, lag(tall) OVER (PARTITION BY sample ORDER BY b) AS prev FROM ta) GROUP BY sample)
SELECT sample, n_sites, n_het, round(n_het::DOUBLE / n_sites, 6) AS het_rate, round(nb * 0.01::DOUBLE, 6) AS min_freq_needed, round(1.0 - nb * 0.01::DOUBLE, 6) AS dominant_frac, round(residual, 6) AS residual_het_rate,
  CASE WHEN n_het > 0 THEN round({_CENTRE.format("mode")}, 6) END AS minor_mode, CASE WHEN n_het > 0 THEN round({_CENTRE.format("med")}, 6) END AS minor_median, CASE WHEN n_het > 0 THEN round({_CENTRE.format("q95")}, 6) END AS minor_q95,
  CASE WHEN n_het > 0 THEN bands ELSE 0 END AS n_bands, round(wsmaf_mean, 6) AS wsmaf_mean,
  CASE WHEN n_sites < 500 THEN 'undetermined' WHEN nb IS NULL THEN 'mixed' WHEN nb <= 2 THEN 'monoclonal' WHEN nb <= 30 THEN 'dominant_clone' ELSE 'mixed' END AS class
FROM t JOIN need USING (sample) JOIN ba USING (sample)""",
}
