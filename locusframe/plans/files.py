"""Queries that write a table as a file of one of the supported formats, read it back and hold it against the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.coords import contains, get_reference, overlap_span, overlaps, parse_label, snp_label, vcf_pos
from locusframe.functions.stats import chi2_sf, normal_sf, with_workers
from locusframe.operators import fws, variants, wsaf
from locusframe.operators import harmonize as h
from locusframe.operators import intervals as iv
from locusframe.plans import pipeline, variation
from locusframe.plans.adapters import ctes, view
from locusframe.plans.diversity import GT, depth_cells
from locusframe.plans.sharing import TAIL_SQL
from locusframe.sources import bam, masks, reads, text
from locusframe.tables import shared_dir

SAMPLES = [f"s{i}" for i in range(24)]


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


def _lines(df: DataFrame, path: str, *columns) -> str:
    df.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    return path


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    """All records with all samples, as VCF."""
    path = _path(spark, "calls.vcf")
    text.write_vcf(variation.records(spark, sf_dir).withColumn("source_id", F.concat(F.lit("rs"), "site")), path, SAMPLES)
    return path


def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.read_vcf(spark, _vcf(spark, sf_dir)).select("chrom", "pos0", "source_id", "ref", F.array_join("alts", ",").alias("alts"), F.explode("calls").alias("c"))
    return rows.where("c.ad IS NOT NULL").select("chrom", "pos0", "source_id", "ref", "alts", "c.sample", F.get("c.gt", 0).alias("a0"), F.get("c.gt", 1).alias("a1"), F.array_join("c.ad", ",").alias("ad"))


def vcf_region_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples and two regions of the VCF."""
    rows = text.read_vcf(spark, _vcf(spark, sf_dir), samples=["s1", "s5", "s11"], regions=[("chr1", 0, 200_000), ("chr5", 100_000, 10_000_000)])
    return rows.select("chrom", "pos0", F.size("calls").cast("long").alias("n_calls"), F.count_if(F.lit(True)).over(iv.Window.partitionBy("chrom")).alias("n_sites"))


def panel_from_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_panel(spark, _vcf(spark, sf_dir))


def panel_from_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "v_panel")
    return text.read_panel(spark, _lines(panel, _path(spark, "panel.bed"), "chrom", F.col("pos0").cast("string"), (F.col("pos0") + 1).cast("string"), F.when(F.col("snp_ix") % 3 == 0, ".").otherwise(F.concat(F.lit("m"), "snp_ix"))), "bed")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = view(spark, sf_dir, "v_panel")
    named = F.concat(F.lit("Pf3D7_"), F.lpad(F.replace("chrom", F.lit("chr"), F.lit("")), 2, "0"), F.lit("_v3"))
    return text.read_positions(spark, _lines(panel, _path(spark, "sites.bed"), named, F.col("pos0").cast("string"), (F.col("pos0") + 1).cast("string")), "bed")


def bed_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_bed(spark, _lines(variation.gene_bed(spark, sf_dir), _path(spark, "genes.bed"), "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name"))


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's end is the last SNP, so it is one less there."""
    blocks, path = view(spark, sf_dir, "v_blocks").select("sample1", "sample2", "chr", "start", (F.col("end") - 1).alias("end"), "different", "Nsnp"), _path(spark, "blocks.tsv.gz")
    text.write_tsv(blocks, path)
    return text.read_blocks(spark, path)


def depth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a site with ref,alt of every sample; '.' where there is none."""
    cell = lambda s: F.coalesce(F.max(F.when(F.col("sample") == s, F.concat_ws(",", "ref_ad", "alt_ad"))), F.lit("."))
    wide = view(spark, sf_dir, "v_calls").groupBy("chrom", "pos0").agg(*[cell(s).alias(s) for s in SAMPLES])
    return text.read_ad_table(spark, _lines(wide, _path(spark, "ad.tsv"), "chrom", (F.col("pos0") + 1).cast("string"), F.lit("A"), F.lit("T"), *SAMPLES), SAMPLES)


def frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "af.tsv.gz")
    text.write_stamped(view(spark, sf_dir, "v_panel").select(snp_label(F.col("chrom"), F.col("pos0")).alias("snp_id"), (F.pmod("snp_ix", F.lit(64)) / 64).alias("af"), "snp_ix"), path)
    return text.read_af_table(spark, path)


def gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "genes.tsv")
    text.write_tsv(view(spark, sf_dir, "v_genes").withColumnRenamed("chr", "chrom"), path)
    return text.read_genes(spark, path).select("name", F.col("gene_id").cast("long").alias("gene_id"), "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def exclusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls outside the regions of a table of 1-based closed regions."""
    path = _path(spark, "cnv.tsv")
    text.write_tsv(view(spark, sf_dir, "v_genes").select(F.col("chr").alias("chrom"), F.col("start").alias("call_start"), F.col("end").alias("call_end")), path)
    return fws.exclude_sites(view(spark, sf_dir, "v_calls"), text.read_exclusions(spark, path)).select("site", "sample")


def depth_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_reads").where("sample = 's1'")
    return text.read_depth_bed(spark, _lines(rows, _path(spark, "depth.bed"), "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("mapq").cast("string")), "s1")


def matrix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair-by-SNP table, saved and loaded: cells a pair."""
    from locusframe.operators import ibd
    from locusframe.plans.sharing import _blocks, _cells

    path = _path(spark, "matrix")
    text.save_matrix(_cells(spark, sf_dir), ibd.pair_index(_blocks(spark, sf_dir)), view(spark, sf_dir, "v_panel"), path)
    cells, pairs, panel = text.load_matrix(spark, path)
    counted = cells.join(panel.select("snp_ix"), "snp_ix").groupBy("sample1", "sample2").agg(F.count("*").alias("n"))
    return pairs.join(counted, ["sample1", "sample2"], "left").select("sample1", "sample2", F.coalesce("n", F.lit(0).cast("long")).alias("n_cells"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("snp_ix") % 5 == 0, F.concat(F.lit("x"), "snp_ix")).otherwise(snp_label(F.concat(F.lit("a:"), "chrom"), F.col("pos0")))
    named = view(spark, sf_dir, "v_panel").select("snp_ix", label.alias("label"))
    chrom, pos0 = parse_label(F.col("label"))
    return named.select("snp_ix", "label", chrom.alias("chrom"), pos0.alias("pos0"), F.when(pos0 >= 0, vcf_pos(pos0)).otherwise(-1).alias("pos_vcf"))


def overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval predicates of each block against a fixed window."""
    lo, hi = F.lit(300_000), F.lit(400_000)
    a, b = overlap_span(F.col("start"), F.col("end"), lo, hi)
    return view(spark, sf_dir, "v_blocks").groupBy(overlaps(F.col("start"), F.col("end"), lo, hi).alias("meets"), contains(F.col("start"), lo, hi).alias("starts_inside")).agg(F.count("*").alias("n"), F.sum(F.greatest(b - a, F.lit(0))).alias("bp"))


def windows_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth windows that meet a region, kept whole."""
    bed = view(spark, sf_dir, "v_windows").select(F.col("chrom").alias("_bc"), (F.col("start") + 500).alias("_bs"), (F.col("start") + 1200).alias("_be")).where("_bs % 7000 = 500")
    return iv.interval_join(view(spark, sf_dir, "v_windows"), bed, "left_semi", right_on=("_bc", "_bs", "_be")).select("sample", "chrom", "start", "end")


def borderline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = variants.sample_coverage(variants.add_ads(variation.records(spark, sf_dir)), 40, 0.5)
    return variants.borderline(table, 0.02).select("sample", "margin", "dropped")


def stale_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.create_map(*[x for i, k in enumerate(("AC", "AF", "AN", "MQ", "QD")) for x in (F.lit(k), (F.col("site") % (i + 2)).cast("string"))])
    kept = view(spark, sf_dir, "v_info").select("site", h.strip_info(info).alias("info"))
    return kept.select("site", F.array_join(F.array_sort(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("info"))


def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after each of three steps."""
    steps = [{"name": "hard_qc_filter"}, {"name": "locus_missingness_filter", "enabled": False}, {"name": "singleton_filter_add_ads"}, {"name": "maf_filter", "params": {"maf_min": 0.3, "maf_max": 0.45}}]
    _, tally, _ = pipeline.run(variation.records(spark, sf_dir), {"steps": steps}, keep=variation.whitelist(spark, sf_dir))
    return spark.createDataFrame([(i, t["step"], t["count"], t["rescued"]) for i, t in enumerate(tally)], "ix int, step string, n long, rescued long")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads over one site: one a line item."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pick = lambda flag, a, b: F.when(F.col(flag[0]) == flag[1], a).otherwise(b)
    q = F.col("l_quantity").cast("int")
    return items.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 24).alias("sample"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("read"), pick(("l_linestatus", "O"), "fwd", "rev").alias("strand"),
        F.when(F.col("l_returnflag") == "R", "T").when(F.col("l_returnflag") == "A", "A").otherwise("C").alias("base"), q.alias("bq"), (F.col("l_partkey") % 150).cast("int").alias("seq_cycle"),
        F.least(F.col("l_partkey") % 150, 149 - F.col("l_partkey") % 150).cast("int").alias("dist_nearest_end"), (F.col("l_orderkey") % 3).cast("int").alias("sc_5p"), F.lit(0).alias("sc_3p"), (F.col("l_orderkey") % 5 == 0).alias("has_sa"),
        (F.col("l_partkey") % 11).cast("long").alias("seq_start"), F.substring(F.translate(F.md5(F.col("l_orderkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 12).alias("seq"),
    )


def read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bam.summarise_reads(_reads(spark, sf_dir), "T", "A")
    return out.withColumns({c: F.round(c, 6) for c in ("vaf_fwd_pct", "vaf_rev_pct", "bq_below_20_pct", "near_end_pct", "soft_clip_pct", "sa_pct")}).drop("modal_start")


def fastq_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALT reads of the reverse strand as FASTQ, read back by lines of four."""
    found, path = reads.alt_reads(_reads(spark, sf_dir), "T"), _path(spark, "alt.fastq")
    flat = F.array_repeat("bq", F.length("seq"))
    reads.fastq_lines(found.withColumn("qual", flat)).write.text(path, lineSep="\n@@\n")
    part = F.split("value", "\n")
    return spark.read.text(path, lineSep="\n@@\n").select(F.substring(F.get(part, 0), 2, 99).alias("read"), F.get(part, 1).alias("seq"), F.get(part, 3).alias("qual"))


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.pmod("snp_ix", F.lit(121)) - 60) / 10.0
    points = with_workers(view(spark, sf_dir, "v_panel").select("snp_ix", F.when(F.col("snp_ix") % 17 != 0, z).alias("z")))
    return points.select("snp_ix", F.round(normal_sf(F.col("z")), 9).alias("normal_sf"), F.round(chi2_sf(F.col("z") * F.col("z")), 9).alias("chi2_sf"))


def wsaf_with_fws(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = depth_cells(spark, sf_dir)
    found = wsaf.profile(wsaf.site_fractions(cells.select("site", "sample", "ad")), min_sites=10).select("sample")
    values = fws.fws(view(spark, sf_dir, "v_calls"), estimator="ratio", min_depth=10).where("sample <> 's3'")
    return wsaf.with_fws(found, values, 0.2).select("sample", F.round("fws", 6).alias("fws"), "fails")


def core_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the panel, spelt as the annotation does, that the core mask keeps."""
    name = F.concat(F.lit("Pf3D7_"), F.lpad(F.replace("chrom", F.lit("chr"), F.lit("")), 2, "0"), F.lit("_v3"))
    sites = view(spark, sf_dir, "v_info").select("site", name.alias("chrom"), "pos0", "ref", F.array("alt").alias("alts"))
    return iv.region_filter(sites, masks.resolve_bed(spark, "builtin:pf3d7_core_regions")).select("site")


def reference_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, per_cm = get_reference("pf3d7")
    return spark.createDataFrame([(c, n, n / per_cm) for c, n in lengths.items()], "chr string, length long, cm double").withColumn("cm", F.round("cm", 6))


QUERIES = {
    f.__name__: f
    for f in (
        vcf_round_trip, vcf_region_samples, panel_from_vcf, panel_from_bed, positions, bed_merged, block_table, depth_table, frequency_table, gene_table, exclusion_table, depth_bed, matrix_table, labels, overlap_spans,
        windows_in_regions, borderline_samples, stale_info, filter_chain, read_summary, fastq_export, survival, wsaf_with_fws, core_masked, reference_table,
    )
}

_REC = f"{ctes('v_ad', 'v_info')}, {GT}"
_SITE = "(SELECT site FROM v_info WHERE site IN (SELECT site FROM v_ad))"
_RD = """WITH rd AS (SELECT concat('s', CAST(l_suppkey % 24 AS VARCHAR)) AS sample, concat_ws(':', l_orderkey, l_linenumber) AS read, l_linestatus = 'O' AS fwd, CASE l_returnflag WHEN 'R' THEN 'T' WHEN 'A' THEN 'A' ELSE 'C' END AS base,
  CAST(l_quantity AS INT) AS bq, CAST(l_partkey % 150 AS INT) AS cyc, least(l_partkey % 150, 149 - l_partkey % 150) AS d, l_orderkey % 3 AS sc, l_orderkey % 5 = 0 AS sa, substr(translate(md5(CAST(l_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) AS seq FROM lineitem)"""
_CORE = ", ".join(f"('chr{c}', {a}, {b})" for c, spans in masks.PF3D7_CORE.items() for a, b in spans)

ORACLES = {
    "vcf_round_trip": f"""{_REC} SELECT i.chrom, i.pos0, concat('rs', CAST(i.site AS VARCHAR)) AS source_id, i.ref, CASE WHEN n_alts = 2 THEN concat(i.alt, ',G') ELSE i.alt END AS alts, sample, a0, a1,
  CASE WHEN n_alts = 2 THEN concat_ws(',', d0, d1, d2) ELSE concat_ws(',', d0, d1) END AS ad FROM v_gt JOIN v_info i USING (site)""",
    "vcf_region_samples": f"{_REC} SELECT chrom, pos0, 3::BIGINT AS n_calls, count(*) OVER (PARTITION BY chrom) AS n_sites FROM v_info WHERE site IN {_SITE} AND ((chrom = 'chr1' AND pos0 < 200000) OR (chrom = 'chr5' AND pos0 >= 100000 AND pos0 < 10000000))",
    "panel_from_vcf": f"{_REC} SELECT concat(chrom, ':', CAST(pos0 AS VARCHAR)) AS snp_id, chrom, pos0, concat('rs', CAST(site AS VARCHAR)) AS source_id FROM v_info WHERE site IN {_SITE}",
    "panel_from_bed": f"{ctes('v_panel')} SELECT concat(chrom, ':', CAST(pos0 AS VARCHAR)) AS snp_id, chrom, pos0, CASE WHEN snp_ix % 3 <> 0 THEN concat('m', CAST(snp_ix AS VARCHAR)) END AS source_id FROM v_panel",
    "positions": f"{ctes('v_panel')} SELECT replace(chrom, 'chr', '') AS chr, pos0 FROM v_panel",
    "bed_merged": f"{ctes('v_genes')}, bed AS (SELECT chr AS chrom, start, \"end\" AS fin FROM v_genes) SELECT chrom, start, \"end\" FROM {variation._merge('bed')}",
    "block_table": f"{ctes('v_blocks')} SELECT * FROM v_blocks",
    "depth_table": f"""{ctes("v_calls")} SELECT concat(s.chrom, ':', CAST(s.pos0 AS VARCHAR)) AS site, s.chrom, s.pos0, n.sample, coalesce(c.ref_ad, 0) AS ref_ad, coalesce(c.alt_ad, 0) AS alt_ad
  FROM (SELECT DISTINCT chrom, pos0 FROM v_calls) s CROSS JOIN (SELECT concat('s', CAST(unnest(range(24)) AS VARCHAR)) AS sample) n LEFT JOIN v_calls c ON c.chrom = s.chrom AND c.pos0 = s.pos0 AND c.sample = n.sample""",
    "frequency_table": f"{ctes('v_panel')} SELECT concat(chrom, ':', CAST(pos0 AS VARCHAR)) AS snp_id, (snp_ix % 64) / 64.0::DOUBLE AS af FROM v_panel",
    "gene_table": f"{ctes('v_genes')} SELECT * FROM v_genes",
    "exclusion_table": f"{ctes('v_calls', 'v_genes')} SELECT site, sample FROM v_calls c WHERE NOT EXISTS (SELECT 1 FROM v_genes g WHERE g.chr = c.chrom AND c.pos0 + 1 >= g.start AND c.pos0 + 1 <= g.\"end\")",
    "depth_bed": f"{ctes('v_reads')} SELECT sample, chrom, start, \"end\", mapq AS depth FROM v_reads WHERE sample = 's1'",
    "matrix_table": f"""{ctes("v_blocks", "v_panel")}, pb AS (SELECT least(sample1, sample2) AS sample1, greatest(sample1, sample2) AS sample2, chr, start, "end" AS fin, different, Nsnp FROM v_blocks),
cells AS (SELECT DISTINCT sample1, sample2, snp_ix FROM pb JOIN v_panel ON chr = chrom AND start <= pos0 AND pos0 < fin WHERE different = 0 AND fin - start >= 15000 AND Nsnp >= 15)
SELECT sample1, sample2, count(snp_ix) AS n_cells FROM (SELECT DISTINCT sample1, sample2 FROM pb) LEFT JOIN cells USING (sample1, sample2) GROUP BY ALL""",
    "labels": f"""{ctes("v_panel")} SELECT snp_ix, CASE WHEN snp_ix % 5 = 0 THEN concat('x', CAST(snp_ix AS VARCHAR)) ELSE concat('a:', chrom, ':', CAST(pos0 AS VARCHAR)) END AS label, CASE WHEN snp_ix % 5 = 0 THEN 'unknown' ELSE concat('a:', chrom) END AS chrom,
  CASE WHEN snp_ix % 5 = 0 THEN -1 ELSE pos0 END AS pos0, CASE WHEN snp_ix % 5 = 0 THEN -1 ELSE pos0 + 1 END AS pos_vcf FROM v_panel""",
    "overlap_spans": f"{ctes('v_blocks')} SELECT start < 400000 AND \"end\" > 300000 AS meets, start >= 300000 AND start < 400000 AS starts_inside, count(*) AS n, CAST(sum(greatest(least(\"end\", 400000) - greatest(start, 300000), 0)) AS BIGINT) AS bp FROM v_blocks GROUP BY 1, 2",
    "windows_in_regions": f"{ctes('v_windows')} SELECT sample, chrom, start, \"end\" FROM v_windows w WHERE EXISTS (SELECT 1 FROM v_windows b WHERE (b.start + 500) % 7000 = 500 AND b.chrom = w.chrom AND w.start < b.start + 1200 AND w.\"end\" > b.start + 500)",
    "borderline_samples": f"""{_REC}, t AS (SELECT sample, count(*) FILTER (dp >= 40)::DOUBLE / count(*) AS f FROM v_gt WHERE site IN {_SITE} GROUP BY sample)
SELECT sample, round(f - 0.5, 6) AS margin, f < 0.5 AS dropped FROM t WHERE f < 0.5 OR abs(round(f - 0.5, 6)) <= 0.02::DOUBLE""",
    "stale_info": f"{ctes('v_info')} SELECT site, concat('MQ=', CAST(site % 5 AS VARCHAR), ';QD=', CAST(site % 6 AS VARCHAR)) AS info FROM v_info",
    "filter_chain": f"""{_REC}, {variation._TAGS}, r AS (SELECT i.*, t.carriers, t.an, t.c1, t.c2, t.n_alts, {variation._WHITE} AS w FROM v_info i JOIN tags t USING (site)),
a AS (SELECT * FROM r WHERE NOT ({variation._FAIL}) OR w), b AS (SELECT * FROM a WHERE carriers > 1 OR w),
c AS (SELECT *, coalesce(an > 0 AND c1::DOUBLE / an + CASE WHEN n_alts = 2 THEN c2::DOUBLE / an ELSE 0 END BETWEEN 0.3::DOUBLE AND 0.45::DOUBLE, false) AS pass FROM b)
SELECT 0 AS ix, 'input' AS step, count(*) AS n, 0::BIGINT AS rescued FROM r UNION ALL SELECT 1, 'hard_qc_filter', count(*), count(*) FILTER ({variation._FAIL}) FROM a
UNION ALL SELECT 2, 'singleton_filter_add_ads', count(*), count(*) FILTER (carriers <= 1) FROM b UNION ALL SELECT 3, 'maf_filter', count(*) FILTER (pass OR w), count(*) FILTER (w AND NOT pass) FROM c""",
    "read_summary": f"""{_RD}, f AS (SELECT *, base = 'T' AS a, base = 'A' AS r, base = 'T' AND NOT fwd AS v FROM rd)
SELECT sample, count(*) FILTER (r AND fwd) AS ref_fwd, count(*) FILTER (r AND NOT fwd) AS ref_rev, count(*) FILTER (a AND fwd) AS alt_fwd, count(*) FILTER (a AND NOT fwd) AS alt_rev,
  round(100.0::DOUBLE * count(*) FILTER (a AND fwd) / nullif(count(*) FILTER ((a OR r) AND fwd), 0), 6) AS vaf_fwd_pct, round(100.0::DOUBLE * count(*) FILTER (v) / nullif(count(*) FILTER ((a OR r) AND NOT fwd), 0), 6) AS vaf_rev_pct,
  median(bq) FILTER (v) AS bq_median, min(bq) FILTER (v) AS bq_min, max(bq) FILTER (v) AS bq_max, round(100.0::DOUBLE * count(*) FILTER (v AND bq < 20) / nullif(count(*) FILTER (v), 0), 6) AS bq_below_20_pct,
  median(cyc) FILTER (v) AS cycle_median, min(cyc) FILTER (v) AS cycle_min, max(cyc) FILTER (v) AS cycle_max, round(100.0::DOUBLE * count(*) FILTER (v AND d < 10) / nullif(count(*) FILTER (v), 0), 6) AS near_end_pct,
  round(100.0::DOUBLE * count(*) FILTER (v AND sc > 0) / nullif(count(*) FILTER (v), 0), 6) AS soft_clip_pct, round(100.0::DOUBLE * count(*) FILTER (v AND sa) / nullif(count(*) FILTER (v), 0), 6) AS sa_pct FROM f GROUP BY sample""",
    "fastq_export": f"{_RD} SELECT read, seq, repeat(chr(bq + 33), 12) AS qual FROM rd WHERE base = 'T' AND NOT fwd",
    "survival": f"""{ctes("v_panel")}, z AS (SELECT snp_ix, CASE WHEN snp_ix % 17 <> 0 THEN ((snp_ix % 121) - 60) / 10.0::DOUBLE END AS z FROM v_panel), {TAIL_SQL}
SELECT snp_ix, round(p, 9) AS normal_sf, round(CASE WHEN z >= 0 THEN 2 * p ELSE 2 * (1 - p) END, 9) AS chi2_sf FROM pv""",
    "core_masked": f"{ctes('v_info')} SELECT site FROM v_info i WHERE EXISTS (SELECT 1 FROM (VALUES {_CORE}) c(chrom, a, b) WHERE c.chrom = i.chrom AND i.pos0 < c.b AND i.pos0 + length(i.ref) > c.a)",
    "reference_table": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n}::BIGINT, round({n} / 15000.0::DOUBLE, 6))" for c, n in get_reference()[0].items()) + ") l(chr, length, cm)",
}
