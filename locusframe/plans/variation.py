"""Queries of callset filters, masks and harmonization, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.coords import normalise_chr
from locusframe.operators import harmonize as h
from locusframe.operators import intervals as iv
from locusframe.operators import variants as v
from locusframe.plans.adapters import ctes, view
from locusframe.plans.diversity import GT, depth_cells


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: one a site, with the INFO metrics of v_info and the calls of v_ad; pl is flat zeros of the right width."""
    width = F.when(F.col("n_alts") == 2, 6).otherwise(3)
    call = F.struct("sample", "gt", "ad", F.lit(None).cast("int").alias("ads"), F.array_repeat(F.lit(0), width).alias("pl"))
    cells = depth_cells(spark, sf_dir)
    nested = cells.groupBy("site").agg(F.sort_array(F.collect_list(call)).alias("calls"), F.first("n_alts").alias("n_alts"))
    info = view(spark, sf_dir, "v_info")
    alts = F.when(F.col("n_alts") == 2, F.array(F.col("alt"), F.lit("G"))).otherwise(F.array("alt"))
    return info.join(nested, "site").withColumn("alts", alts).withColumn("filters", F.array(F.lit("PASS"))).drop("alt", "n_alts")


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = view(spark, sf_dir, "v_info").where("site % 9 = 0")
    return info.select("chrom", F.col("pos0").alias("start"), (F.col("pos0") + 1).alias("end"))


def gene_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_genes").select(F.col("chr").alias("chrom"), "start", "end", "name")


def hard_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.hard_qc(records(spark, sf_dir)).select("site")


def hard_qc_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.hard_qc(records(spark, sf_dir), fs=60.0, keep=whitelist(spark, sf_dir)).select("site", "rescued")


def singleton_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.singleton_filter(records(spark, sf_dir), min_samples=1)
    return out.select("site", F.explode("calls").alias("c")).select("site", "c.sample", "c.ads")


def biallelic_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.biallelic_snps(records(spark, sf_dir))
    return out.select("site", "ref", F.get("alts", 0).alias("alt"), F.explode("calls").alias("c")).select(
        "site", "ref", "alt", "c.sample", F.get("c.gt", 0).alias("a0"), F.get("c.gt", 1).alias("a1"), F.size("c.ad").cast("long").alias("n_ad"), F.size("c.pl").cast("long").alias("n_pl")
    )


def fill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.fill_tags(records(spark, sf_dir)).select("site", F.col("an").cast("long").alias("an"), F.get("ac", 0).cast("long").alias("ac1"), F.round(F.get("af", 0), 6).alias("af1"), F.round("maf", 6).alias("maf"), F.round("f_missing", 6).alias("f_missing"))


def sample_coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.sample_coverage(v.add_ads(records(spark, sf_dir)), ads_min=40, frac_min=0.5)


def sample_coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = v.sample_coverage_filter(v.add_ads(records(spark, sf_dir)), ads_min=40, frac_min=0.5)
    return out.select("site", F.size("calls").cast("long").alias("n_calls"), F.col("an").cast("long").alias("an"))


def locus_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.locus_missingness(v.add_ads(records(spark, sf_dir)), f_missing_max=0.05, ads_min=20, sample_frac_min=0.7).select("site", F.round("f_missing", 6).alias("f_missing"))


def maf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maf(records(spark, sf_dir), 0.3, 0.45)


def _maf(rows: DataFrame, low: float, high: float | None) -> DataFrame:
    out = v.maf_filter(rows, low, high)
    return out.select("site", F.round(v.nonref_af(out), 6).alias("af"))


def maf_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.maf_filter(records(spark, sf_dir), 0.35, keep=whitelist(spark, sf_dir)).select("site", "rescued")


def maf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.maf_filter_grouped(records(spark, sf_dir), view(spark, sf_dir, "v_meta"), "region", 0.45).select("site")


def ad_regenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.ad_regenotype(records(spark, sf_dir), min_reads=5, min_freq=0.1)
    return out.select("site", F.explode("calls").alias("c")).select("site", "c.sample", "c.ads", F.get("c.gt", 0).alias("a0"), F.get("c.gt", 1).alias("a1"))


def strip_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = records(spark, sf_dir).withColumn("calls", F.transform("calls", lambda c: c.withField("pl", F.when(F.col("site") % 6 == 0, F.array_repeat(F.lit(0), 7)).otherwise(c["pl"]))))
    out = v.strip_stale(stale)
    return out.select("site", "modified", F.size(F.get("calls", 0)["pl"]).cast("long").alias("width"), F.get(F.get("calls", 0)["pl"], 0).alias("first"))


def snp_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.snp_bed(records(spark, sf_dir))


def region_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.region_filter(view(spark, sf_dir, "v_info"), gene_bed(spark, sf_dir)).select("site")


def region_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.region_filter(view(spark, sf_dir, "v_info"), gene_bed(spark, sf_dir), exclude=True).select("site")


def region_drop_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.region_filter(view(spark, sf_dir, "v_info"), gene_bed(spark, sf_dir), exclude=True, keep=whitelist(spark, sf_dir)).select("site", "rescued")


def _blocks_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block as a span of as many bases as it has SNPs: many short intervals, overlapping here and there."""
    return view(spark, sf_dir, "v_blocks").select(F.col("chr").alias("chrom"), "start", (F.col("start") + F.col("Nsnp")).alias("end"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_intervals(_blocks_bed(spark, sf_dir))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_intervals(_blocks_bed(spark, sf_dir), gene_bed(spark, sf_dir))


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.subtract_intervals(_blocks_bed(spark, sf_dir), gene_bed(spark, sf_dir))


def annotate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.annotate(iv.merge_intervals(_blocks_bed(spark, sf_dir)), view(spark, sf_dir, "v_genes"))


def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "v_genes").select("gene_id", F.col("chr").alias("i_chrom"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    return iv.points_in(view(spark, sf_dir, "v_panel"), spans).select("snp_ix", "gene_id")


def chromosome_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "v_info").select("site", F.concat(F.lit("Pf3D7_"), F.lpad((F.col("site") % 14 + 1).cast("string"), 2, "0"), F.lit("_v3")).alias("name"), "chrom")
    return names.select("site", normalise_chr(F.col("name")).alias("bare"), normalise_chr(F.col("chrom")).alias("bare_chr"))


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three cohorts (the sample groups); in a cohort some sites carry their first ALT as C."""
    cells = depth_cells(spark, sf_dir)
    call = F.struct("sample", "gt", "ad")
    nested = cells.groupBy("site", "chrom", "pos0", F.col("grp").alias("cohort")).agg(F.sort_array(F.collect_list(call)).alias("calls"), F.first("n_alts").alias("n_alts"))
    first = F.when((F.col("site") + F.substring("cohort", 2, 1).cast("int")) % 4 == 0, "C").otherwise("T")
    alts = F.when(F.col("n_alts") == 2, F.array(first, F.lit("G"))).otherwise(F.array(first))
    return nested.withColumn("ref", F.lit("A")).withColumn("alts", alts).withColumn("rec_ix", F.col("site")).drop("n_alts")


def harmonize_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = h.allele_union(cohorts(spark, sf_dir), min_ad=30, min_af=0.4)
    return out.select("chrom", "pos0", "ref", F.array_join("union_alts", ",").alias("union_alts"))


def harmonize_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts(spark, sf_dir)
    out = h.rewrite(rows, h.allele_union(rows, 30, 0.4), min_ad=30, min_af=0.4)
    cells = out.select("site", "cohort", F.array_join("alts", ",").alias("alts"), F.explode("calls").alias("c"))
    return cells.select("site", "cohort", "alts", "c.sample", F.array_join("c.ad", ",").alias("ad"))


def harmonize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts(spark, sf_dir)
    return h.stats(rows, h.allele_union(rows, 30, 0.4), 30, 0.4)


QUERIES = {
    f.__name__: f
    for f in (
        hard_qc, hard_qc_whitelist, singleton_filter, biallelic_trim, fill_tags, sample_coverage_table, sample_coverage_filter, locus_missingness, maf_window, maf_whitelist, maf_grouped, ad_regenotype,
        strip_stale, snp_bed, region_keep, region_drop, region_drop_whitelist, interval_merge, interval_union, interval_subtract, annotate_regions, points_in_intervals, chromosome_names,
        harmonize_union, harmonize_rewrite, harmonize_stats,
    )
}

_FAIL = "coalesce(qd < 20, false) OR coalesce(mq < 55, false) OR coalesce(mqranksum < -5, false) OR coalesce(readposranksum < -5, false) OR coalesce(sor > 3, false)"
_REC = f"{ctes('v_ad', 'v_info')}, {GT}"
_TAGS = """tags AS (
  SELECT site, count(*) AS n, count(*) FILTER (a0 IS NULL) AS miss, sum(CASE WHEN a0 IS NULL THEN 0 ELSE 2 END) AS an, any_value(n_alts) AS n_alts,
    sum((a0 = 1)::INT + (a1 = 1)::INT) AS c1, sum((a0 = 2)::INT + (a1 = 2)::INT) AS c2, sum((a0 > 0)::INT + (a1 > 0)::INT) AS calt, count(*) FILTER (a1 > 0) AS carriers FROM v_gt GROUP BY site
)"""
_GENES = "genes AS (SELECT chr, start, \"end\" AS fin, name, gene_id FROM v_genes)"
_BED = "bed AS (SELECT chr AS chrom, start, start + Nsnp AS fin FROM v_blocks)"
_HIT = "EXISTS (SELECT 1 FROM v_genes g WHERE g.chr = i.chrom AND i.pos0 < g.\"end\" AND i.pos0 + length(i.ref) > g.start)"
_WHITE = "EXISTS (SELECT 1 FROM v_info w WHERE w.site % 9 = 0 AND w.chrom = i.chrom AND i.pos0 < w.pos0 + 1 AND i.pos0 + length(i.ref) > w.pos0)"


def _merge(source: str) -> str:
    return f"""(SELECT chrom, min(start) AS start, max(fin) AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max(fin) OVER (PARTITION BY chrom ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source} WHERE fin > start))
  GROUP BY chrom, island)"""


_COHORTS = """coh AS (
  SELECT site, chrom, pos0, grp AS cohort, sample, d0, d1, d2, d0 + d1 + d2 AS dp, n_alts, CASE WHEN (site + CAST(substr(grp, 2, 1) AS INT)) % 4 = 0 THEN 'C' ELSE 'T' END AS first FROM v_ad
), alive AS (
  SELECT site, chrom, pos0, cohort, first AS alt FROM coh WHERE d1 >= 30 AND d1::DOUBLE / dp >= 0.4::DOUBLE UNION
  SELECT site, chrom, pos0, cohort, 'G' FROM coh WHERE n_alts = 2 AND d2 >= 30 AND d2::DOUBLE / dp >= 0.4::DOUBLE
), uni AS (
  SELECT s.site, s.chrom, s.pos0, coalesce(list_sort(list(DISTINCT a.alt) FILTER (a.alt IS NOT NULL)), []) AS u FROM (SELECT DISTINCT site, chrom, pos0 FROM coh) s LEFT JOIN alive a USING (site) GROUP BY ALL
)"""
_CLEAN = "CASE WHEN {0} < 30 OR coalesce({0}::DOUBLE / nullif(dp, 0), 0) < 0.4::DOUBLE THEN 0 ELSE {0} END"

ORACLES = {
    "hard_qc": f"{_REC} SELECT site FROM v_info WHERE site IN (SELECT site FROM v_ad) AND NOT ({_FAIL})",
    "hard_qc_whitelist": f"{_REC} SELECT site, ({_FAIL} OR fs > 60) AS rescued FROM v_info i WHERE site IN (SELECT site FROM v_ad) AND (NOT ({_FAIL} OR fs > 60) OR {_WHITE})",
    "singleton_filter": f"{_REC}, {_TAGS} SELECT site, sample, CAST(dp AS INT) AS ads FROM v_gt JOIN (SELECT site FROM tags WHERE carriers > 1) USING (site) JOIN (SELECT site FROM v_info) USING (site)",
    "biallelic_trim": f"""{_REC}, {_TAGS}, kept AS (
  SELECT t.site, i.ref, i.alt, CASE WHEN n_alts = 2 AND c1 = 0 AND c2 > 0 THEN 2 WHEN (n_alts = 1 OR c2 = 0) AND c1 > 0 THEN 1 END AS keep FROM tags t JOIN v_info i USING (site)
)
SELECT site, ref, CASE keep WHEN 2 THEN 'G' ELSE alt END AS alt, sample, CASE WHEN a0 IS NULL THEN NULL WHEN a0 > 0 THEN 1 ELSE 0 END AS a0, CASE WHEN a1 IS NULL THEN NULL WHEN a1 > 0 THEN 1 ELSE 0 END AS a1,
  2::BIGINT AS n_ad, 3::BIGINT AS n_pl FROM v_gt JOIN kept USING (site) WHERE keep IS NOT NULL AND length(ref) = 1""",
    "fill_tags": f"""{_REC}, {_TAGS} SELECT site, CAST(an AS BIGINT) AS an, CAST(c1 AS BIGINT) AS ac1, round(c1::DOUBLE / nullif(an, 0), 6) AS af1,
  round(CASE WHEN an = 0 THEN NULL WHEN n_alts = 1 THEN least(c1, an - c1) ELSE list_sort([c1, c2, an - c1 - c2])[2] END::DOUBLE / an, 6) AS maf, round(miss::DOUBLE / n, 6) AS f_missing FROM tags JOIN (SELECT site FROM v_info) USING (site)""",
    "sample_coverage_table": f"""{_REC} SELECT sample, count(*) AS n_loci, count(*) FILTER (dp >= 40) AS n_covered, round(count(*) FILTER (dp >= 40)::DOUBLE / count(*), 6) AS frac_covered, 0::BIGINT AS n_missing_ads, round(avg(dp), 2) AS mean_ads,
  40 AS ads_min, 0.5::DOUBLE AS frac_min, round(count(*) FILTER (dp >= 40)::DOUBLE / count(*) - 0.5, 6) AS margin, count(*) FILTER (dp >= 40)::DOUBLE / count(*) < 0.5 AS dropped FROM v_gt GROUP BY sample""",
    "sample_coverage_filter": f"""{_REC}, keep AS (SELECT sample FROM v_gt GROUP BY sample HAVING count(*) FILTER (dp >= 40)::DOUBLE / count(*) >= 0.5)
SELECT site, count(*) AS n_calls, CAST(sum(CASE WHEN a0 IS NULL THEN 0 ELSE 2 END) AS BIGINT) AS an FROM v_gt JOIN keep USING (sample) GROUP BY site HAVING count(*) FILTER (a1 > 0) > 1""",
    "locus_missingness": f"{_REC} SELECT site, round(count(*) FILTER (a0 IS NULL)::DOUBLE / count(*), 6) AS f_missing FROM v_gt GROUP BY site HAVING count(*) FILTER (a0 IS NULL)::DOUBLE / count(*) < 0.05::DOUBLE AND count(*) FILTER (dp >= 20)::DOUBLE / count(*) >= 0.7::DOUBLE",
    "maf_window": f"{_REC}, {_TAGS} SELECT site, round(c1::DOUBLE / an + CASE WHEN n_alts = 2 THEN c2::DOUBLE / an ELSE 0 END, 6) AS af FROM tags WHERE an > 0 AND c1::DOUBLE / an + CASE WHEN n_alts = 2 THEN c2::DOUBLE / an ELSE 0 END BETWEEN 0.3::DOUBLE AND 0.45::DOUBLE",
    "maf_whitelist": f"""{_REC}, {_TAGS}, p AS (SELECT i.*, coalesce(an > 0 AND c1::DOUBLE / an + CASE WHEN n_alts = 2 THEN c2::DOUBLE / an ELSE 0 END BETWEEN 0.35::DOUBLE AND 0.65::DOUBLE, false) AS pass FROM tags JOIN v_info i USING (site))
SELECT site, NOT pass AS rescued FROM p i WHERE pass OR {_WHITE}""",
    "maf_grouped": f"""{ctes("v_ad", "v_meta")}, {GT} SELECT DISTINCT site FROM (
  SELECT site, region, sum((a0 > 0)::INT + (a1 > 0)::INT)::DOUBLE / sum(2) AS af FROM v_gt JOIN v_meta USING (sample) WHERE a0 IS NOT NULL GROUP BY site, region) WHERE least(af, 1 - af) >= 0.45::DOUBLE""",
    "ad_regenotype": f"""{_REC}, c AS (
  SELECT site, sample, {", ".join(f"CASE WHEN d{i} < 5 OR coalesce(d{i}::DOUBLE / nullif(dp, 0), 0) < 0.1::DOUBLE THEN 0 ELSE d{i} END AS d{i}" for i in range(3))} FROM v_gt
), r AS (SELECT *, d0 + d1 + d2 AS dp, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS top FROM c),
s AS (SELECT *, CASE top WHEN 0 THEN CASE WHEN d1 >= d2 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN d0 >= d2 THEN 0 ELSE 2 END ELSE CASE WHEN d0 >= d1 THEN 0 ELSE 1 END END AS sec FROM r),
q AS (SELECT *, CASE sec WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS dsec FROM s)
SELECT site, sample, CAST(dp AS INT) AS ads, CASE WHEN dp = 0 THEN NULL WHEN dsec = 0 OR dsec / dp::DOUBLE < 0.2::DOUBLE THEN top ELSE least(top, sec) END AS a0, CASE WHEN dp = 0 THEN NULL WHEN dsec = 0 OR dsec / dp::DOUBLE < 0.2::DOUBLE THEN top ELSE greatest(top, sec) END AS a1 FROM q""",
    "strip_stale": f"{_REC} SELECT DISTINCT site, site % 6 = 0 AS modified, CASE WHEN n_alts = 2 THEN 6 ELSE 3 END::BIGINT AS width, CASE WHEN site % 6 = 0 THEN NULL ELSE 0 END AS first FROM v_ad",
    "snp_bed": f"{_REC} SELECT chrom, pos0 AS start, pos0 + 1 AS \"end\", concat(chrom, ':', CAST(pos0 AS VARCHAR)) AS name FROM v_info WHERE length(ref) = 1 AND site IN (SELECT site FROM v_ad)",
    "region_keep": f"{ctes('v_info', 'v_genes')} SELECT site FROM v_info i WHERE {_HIT}",
    "region_drop": f"{ctes('v_info', 'v_genes')} SELECT site FROM v_info i WHERE NOT {_HIT}",
    "region_drop_whitelist": f"{ctes('v_info', 'v_genes')} SELECT site, {_HIT} AS rescued FROM v_info i WHERE NOT {_HIT} OR {_WHITE}",
    "interval_merge": f"{ctes('v_blocks')}, {_BED} SELECT chrom, start, \"end\" FROM {_merge('bed')}",
    "interval_union": f"{ctes('v_blocks', 'v_genes')}, {_BED}, both_ AS (SELECT * FROM bed UNION ALL SELECT chr, start, \"end\" FROM v_genes) SELECT chrom, start, \"end\" FROM {_merge('both_')}",
    "interval_subtract": f"""{ctes("v_blocks", "v_genes")}, {_BED}, ev AS (
  SELECT chrom, start AS pt, 1 AS a, 0 AS b FROM bed UNION ALL SELECT chrom, fin, -1, 0 FROM bed UNION ALL SELECT chr, start, 0, 1 FROM v_genes UNION ALL SELECT chr, "end", 0, -1 FROM v_genes
), st AS (SELECT chrom, pt, sum(a) AS a, sum(b) AS b FROM ev GROUP BY chrom, pt),
sg AS (SELECT chrom, pt AS start, lead(pt) OVER w AS fin, sum(a) OVER w AS a, sum(b) OVER w AS b FROM st WINDOW w AS (PARTITION BY chrom ORDER BY pt)),
ok AS (SELECT chrom, start, fin FROM sg WHERE a > 0 AND b = 0 AND fin IS NOT NULL) SELECT chrom, start, "end" FROM {_merge("ok")}""",
    "annotate_regions": f"""{ctes("v_blocks", "v_genes")}, {_BED}, m AS {_merge("bed")}
SELECT m.chrom, m.start, m."end", coalesce(string_agg(DISTINCT g.name, ',' ORDER BY g.name), '') AS genes FROM m LEFT JOIN v_genes g ON g.chr = m.chrom AND g.start < m."end" AND g."end" > m.start GROUP BY ALL""",
    "points_in_intervals": f"{ctes('v_panel', 'v_genes')} SELECT snp_ix, gene_id FROM v_panel p JOIN v_genes g ON p.chrom = g.chr AND p.pos0 >= g.start AND p.pos0 < g.\"end\"",
    "chromosome_names": f"{ctes('v_info')} SELECT site, CAST(site % 14 + 1 AS VARCHAR) AS bare, CAST(site % 14 + 1 AS VARCHAR) AS bare_chr FROM v_info",
    "harmonize_union": f"{ctes('v_ad')}, {_COHORTS} SELECT chrom, pos0, 'A' AS ref, array_to_string(u, ',') AS union_alts FROM uni",
    "harmonize_rewrite": f"""{ctes("v_ad")}, {_COHORTS}, c AS (SELECT *, {_CLEAN.format("d1")} AS c1, CASE WHEN n_alts = 2 THEN {_CLEAN.format("d2")} END AS c2 FROM coh)
SELECT site, cohort, array_to_string(u, ',') AS alts, sample, array_to_string(list_concat([d0], list_transform(u, lambda a: CASE WHEN a = first THEN c1 WHEN a = 'G' AND n_alts = 2 THEN c2 ELSE 0 END)), ',') AS ad FROM c JOIN uni USING (site) WHERE len(u) > 0""",
    "harmonize_stats": f"""{ctes("v_ad")}, {_COHORTS}, r AS (SELECT DISTINCT site, cohort, first, n_alts FROM coh), j AS (SELECT * FROM r JOIN uni USING (site))
SELECT cohort, count(*) FILTER (len(u) > 0) AS written, count(*) FILTER (len(list_filter(u, lambda a: a <> first AND NOT (a = 'G' AND n_alts = 2))) > 0) AS alts_added, count(*) FILTER (len(u) = 0) AS dropped_ref_only,
  (SELECT count(*) FROM uni WHERE len(u) > 0) - count(*) FILTER (len(u) > 0) AS absent FROM j GROUP BY cohort""",
}
