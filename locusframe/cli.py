"""Command line over the library: python -m locusframe COMMAND --flags. Inputs and outputs are paths Spark can open."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.coords import get_reference
from locusframe.operators import coverage, freqs, fws, harmonize, ibd, ld, qc, selection, variants, wsaf
from locusframe.operators.intervals import annotate, interval_join
from locusframe.plans import pipeline
from locusframe.sources import bam, bcf, masks, reads, text
from locusframe.tables import materialise

VERSION = "0.1.0"
Args = argparse.Namespace


@dataclass(frozen=True)
class Command:
    group: str
    help: str
    flags: tuple[tuple, ...]
    run: Callable[[SparkSession, Args], None]


COMMANDS: dict[str, Command] = {}


def command(group: str, help: str, *flags: tuple):
    """Register a function under its own name; a name that is taken is an error."""

    def wrap(f: Callable[[SparkSession, Args], None]) -> Callable[[SparkSession, Args], None]:
        if f.__name__ in COMMANDS:
            raise ValueError(f"two commands are named {f.__name__}")
        COMMANDS[f.__name__] = Command(group, help, flags, f)
        return f

    return wrap


def _flag(name: str, default=None, *, kind=str, required: bool = False, many: bool = False, switch: bool = False, choices=None) -> tuple:
    if switch:
        return (name, {"action": "store_true"})
    return (name, {"default": [] if many else default, "type": kind, "required": required, "choices": choices} | ({"action": "append"} if many else {}))


def need(name: str) -> tuple:
    return _flag(name, required=True)


def number(name: str, default: float) -> tuple:
    return _flag(name, default, kind=type(default))


CALLSET = (need("--input"), need("--output"))
KEEP = (_flag("--keep-bed"),)
BLOCKS = (need("--blocks"), number("--min-block-snp", 15), number("--min-block-kb", 15.0), _flag("--sep", "\t"))
OVERWRITE = (_flag("--overwrite", switch=True),)


def records(spark: SparkSession, path: str, **options) -> DataFrame:
    return bcf.read_bcf(spark, path, options.get("samples")) if path.endswith(".bcf") else text.read_vcf(spark, path, **options)


def _write(df: DataFrame, path: str, samples: list[str] | None = None) -> None:
    """Records as Parquet, or as text where the path asks for VCF."""
    if path.endswith((".vcf", ".vcf.gz")):
        names = samples or [r["s"] for r in df.select(F.explode("calls.sample").alias("s")).distinct().orderBy("s").collect()]
        text.write_vcf(df, path, names)
    else:
        df.write.mode("overwrite").parquet(path)


def _bed(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A BED file or builtin:<name>; builtin:<name>@annotation.gff for masks that are built from genes."""
    if path and path.startswith("builtin:"):
        name, _, gff = path.partition("@")
        try:
            return masks.resolve_bed(spark, name, gff or None)
        except ValueError as e:
            raise SystemExit(str(e)) from e
    return text.read_bed(spark, path) if path else None


def _cells(df: DataFrame) -> DataFrame:
    """Long calls with site keys from nested records."""
    return df.select(F.concat_ws(":", "chrom", "pos0").alias("site"), "chrom", "pos0", "ref", "alts", F.posexplode("calls").alias("sample_ix", "c")).select("site", "chrom", "pos0", "ref", "alts", "sample_ix", "c.*")


def _meta(spark: SparkSession, path: str, group: str) -> DataFrame:
    return text.read_table(spark, path, ("sample", group))


def _depths(spark: SparkSession, a: Args) -> DataFrame:
    if a.ad_table:
        return text.read_ad_table(spark, a.ad_table, text.sample_list(a.samples or "", spark), a.snps_only)
    cells = _cells(records(spark, a.input_vcf)).where(F.size("alts") == 1)
    if a.snps_only:
        cells = cells.where((F.length("ref") == 1) & (F.length(F.get("alts", 0)) == 1))
    depth = lambda i: F.greatest(F.coalesce(F.get("ad", i), F.lit(0)), F.lit(0))
    return cells.select("site", "chrom", "pos0", "sample", depth(0).alias("ref_ad"), depth(1).alias("alt_ad"))


@command("fws", "within-host diversity of every sample", _flag("--input-vcf"), _flag("--ad-table"), _flag("--samples"), _flag("--estimator", "regression", choices=["regression", "ratio"]), number("--min-depth", 0), number("--n-bins", 10), number("--min-alt-samples", 0), _flag("--snps-only", switch=True), number("--monoclonal-threshold", 0.95), _flag("--population-name"), _flag("--exclude-call-regions"), need("--out"))
def calculate_fws(spark: SparkSession, a: Args) -> None:
    calls = _depths(spark, a)
    if a.exclude_call_regions:
        calls = fws.exclude_sites(calls, text.read_exclusions(spark, a.exclude_call_regions))
    out = fws.fws_report(fws.fws(calls, a.estimator, a.min_depth, a.n_bins, a.min_alt_samples), a.monoclonal_threshold)
    text.write_tsv(out.withColumn("population_name", F.lit(a.population_name)) if a.population_name else out, a.out)


def _blocks(spark: SparkSession, a: Args) -> DataFrame:
    return text.read_blocks(spark, a.blocks, a.sep)


@command("ibd", "sparse pair-by-SNP table", *BLOCKS, need("--snps"), _flag("--snp-format", "vcf", choices=["vcf", "bed"]), _flag("--output", "ibd_matrix"), _flag("--all-blocks", switch=True))
def build_ibd_matrix(spark: SparkSession, a: Args) -> None:
    blocks, panel = _blocks(spark, a), text.read_panel(spark, a.snps, a.snp_format)
    panel = materialise(ibd.number_panel(panel), "panel")
    text.save_matrix(ibd.ibd_cells(blocks, panel, a.all_blocks, a.min_block_snp, a.min_block_kb), ibd.pair_index(blocks), panel, a.output, overwrite=True)


@command("ibd", "allele frequencies, overall and by group", need("--bcf"), _flag("--meta"), _flag("--group-col", "group"), _flag("--per-alt", switch=True), number("--ad-min-reads", 2), number("--ad-min-freq", 0.01), _flag("--no-weighted", switch=True), _flag("--with-pos-vcf", switch=True), _flag("--output", "."))
def compute_allele_freqs(spark: SparkSession, a: Args) -> None:
    calls = _cells(records(spark, a.bcf))
    options = {"per_alt": a.per_alt, "weighted": not a.no_weighted, "ad_min_reads": a.ad_min_reads, "ad_min_freq": a.ad_min_freq}
    shown = lambda df: df.withColumnRenamed("site", "snp_id").withColumn("pos_vcf", F.col("pos0") + 1) if a.with_pos_vcf else df.withColumnRenamed("site", "snp_id")
    text.write_stamped(shown(freqs.allele_freqs(calls, **options)), f"{a.output}/allele_freqs.tsv.gz", overwrite=True)
    if a.meta:
        grouped = calls.join(_meta(spark, a.meta, a.group_col).select("sample", F.col(a.group_col).alias("group")), "sample", "left")
        text.write_stamped(shown(freqs.allele_freqs(grouped, group="group", **options)), f"{a.output}/group_allele_freqs.tsv.gz", overwrite=True)


@command("ibd", "summaries of the pair-by-SNP table", need("--matrix"), _flag("--meta"), _flag("--group-col", "group"), _flag("--output", "ibd_analysis"), _flag("--pairwise-group-snp", switch=True))
def analyze_ibd_matrix(spark: SparkSession, a: Args) -> None:
    cells, pairs, panel = text.load_matrix(spark, a.matrix)
    per = ibd.per_pair(cells, pairs, panel.count())
    out = {"per_pair": per, "per_snp": ibd.per_snp(cells, panel, pairs.count()), "per_chr": ibd.per_chromosome(cells, panel, pairs)}
    if a.meta:
        known = ibd.annotate_pairs(per, _meta(spark, a.meta, a.group_col), a.group_col)
        out |= {"per_pair_annotated": known, "within_between_group": ibd.within_between(known), "pairwise_group_ibd": ibd.pairwise_groups(known), "per_snp_per_group": ibd.per_snp_within_groups(cells, panel, known)}
        if a.pairwise_group_snp:
            out["per_snp_pairwise_group"] = ibd.per_snp_between_groups(cells, panel, known)
    for name, df in out.items():
        text.write_tsv(df, f"{a.output}.{name}.tsv.gz", overwrite=True)


@command("ibd", "selection scan, overall or by group", need("--matrix"), need("--af"), _flag("--af-col", "af"), _flag("--group-af"), _flag("--meta"), _flag("--group-col", "group"), _flag("--group", many=True), _flag("--tail", "upper", choices=["upper", "two-sided"]), number("--n-bins", 100), number("--alpha", 0.05), _flag("--fdr-alpha", kind=float), number("--permute", 0), number("--permute-seed", 0), _flag("--permute-pool", "global", choices=["global", "bin"]), _flag("--output", "ibd_selection"))
def ibd_selection_statistic(spark: SparkSession, a: Args) -> None:
    cells, pairs, panel = text.load_matrix(spark, a.matrix)
    overall = text.read_af_table(spark, a.af, ("snp_id", a.af_col)).withColumnRenamed(a.af_col, "af")
    tables = text.read_af_table(spark, a.group_af, ("group", "snp_id", a.af_col)).withColumnRenamed(a.af_col, "af") if a.group_af else None
    n_snps = panel.count()
    wanted: list[str | None] = [None]
    if a.meta:
        meta = _meta(spark, a.meta, a.group_col)
        wanted = a.group or [r[0] for r in meta.select(a.group_col).distinct().orderBy(a.group_col).collect()]
    for group in wanted:
        mine, some = pairs, cells
        if group is not None:
            inside = meta.where(F.col(a.group_col) == group).select("sample").distinct()
            for end in ("sample1", "sample2"):
                mine = mine.join(inside.withColumnRenamed("sample", end), end, "left_semi")
            some = cells.join(mine.select("sample1", "sample2"), ["sample1", "sample2"], "left_semi")
        if (n_pairs := mine.count()) == 0:
            print(f"{group}: no pairs")
            continue
        try:
            af = selection.group_frequencies(panel.select("snp_id"), tables if group is not None else None, overall, group or "")
        except ValueError as e:
            raise SystemExit(str(e)) from e
        counts = ibd.per_snp(some, panel, n_pairs).join(af, "snp_id")
        scored = selection.scan(counts, n_pairs, n_snps, a.n_bins, a.tail, a.alpha, a.fdr_alpha)
        null = selection.permutation_null(scored, selection.runs(some), n_pairs, n_snps, a.permute, a.alpha, a.permute_seed, a.tail) if a.permute else None
        out, info = selection.assemble(scored, null, a.alpha, a.fdr_alpha, a.tail, a.permute_pool, group)
        name = f"{a.output}.{group or 'global'}"
        text.write_tsv(out, f"{name}.selection_stats.tsv.gz", overwrite=True)
        text.write_tsv(selection.bin_stats(scored), f"{name}.bin_stats.tsv.gz", overwrite=True)
        text.write_tsv(info, f"{name}.threshold.txt", overwrite=True)
        if null is not None:
            text.write_tsv(null.bins, f"{name}.permutation_bins.tsv", overwrite=True)


@command("ibd", "shared fraction of every pair, and SNP density", *BLOCKS, need("--snps"), _flag("--snp-format", "vcf"), _flag("--reference", "pf3d7"), _flag("--bp-per-cm", kind=float), _flag("--output", "ibd_frac"))
def ibd_fraction_and_snp_density(spark: SparkSession, a: Args) -> None:
    lengths, per_cm = get_reference(a.reference)
    per_cm = a.bp_per_cm or per_cm
    panel = text.read_panel(spark, a.snps, a.snp_format)
    reach = ibd.callable_spans(panel).agg(F.sum("span")).first()[0] or 1
    text.write_tsv(ibd.pair_fraction(_blocks(spark, a), float(reach), float(sum(lengths.values())), per_cm, a.min_block_snp, a.min_block_kb), f"{a.output}.pair_ibd_fraction.tsv.gz", overwrite=True)
    text.write_tsv(ibd.snp_density(panel, lengths, per_cm), f"{a.output}.snp_density_windows.tsv.gz", overwrite=True)


@command("ibd", "pairs that share genes, by group", *BLOCKS, need("--genes"), need("--meta"), _flag("--group-col", "group"), number("--within", 0), need("--output"))
def ibd_gene_overlap(spark: SparkSession, a: Args) -> None:
    text.write_tsv(ibd.gene_overlap(_blocks(spark, a), text.read_genes(spark, a.genes), _meta(spark, a.meta, a.group_col), a.group_col, a.within, a.min_block_snp, a.min_block_kb), a.output, overwrite=True)


@command("ibd", "every pair, block and gene that meet, with clusters", *BLOCKS, need("--genes"), _flag("--gene", many=True), number("--within", 0), _flag("--complete-only", switch=True), _flag("--min-percent-covered", kind=float), need("--output"))
def ibd_gene_pairs(spark: SparkSession, a: Args) -> None:
    out = ibd.gene_pairs(_blocks(spark, a), text.read_genes(spark, a.genes), a.within, a.min_block_snp, a.min_block_kb)
    if a.gene:
        out = out.where(F.lower("gene").isin([g.lower() for g in a.gene]))
    if a.complete_only:
        out = out.where("coverage = 'complete'")
    if a.min_percent_covered is not None:
        out = out.where(F.col("percent_covered") >= a.min_percent_covered)
    groups = ibd.clusters(out.select("gene", "sample1", "sample2").distinct(), key="gene").withColumnRenamed("sample", "sample1")
    text.write_tsv(out.join(groups, ["gene", "sample1"], "left"), a.output, overwrite=True)


@command("ld", "linkage decay by group", need("--vcf"), _flag("--meta"), _flag("--group-col", "region"), number("--max-dist", 50_000), number("--bins", 20), number("--maf", 0.05), number("--max-snps", 3000), number("--min-samples", 4), number("--min-depth", 0), _flag("--het", "missing", choices=["missing", "dosage"]), need("--output"), _flag("--half-decay-output"), *OVERWRITE)
def ld_decay(spark: SparkSession, a: Args) -> None:
    cells = _cells(records(spark, a.vcf)).withColumn("grp", F.lit("all"))
    if a.meta:
        cells = cells.drop("grp").join(_meta(spark, a.meta, a.group_col).select("sample", F.col(a.group_col).alias("grp")), "sample")
    table = ld.ld_decay(cells.select("grp", "chrom", "pos0", "sample", ld.dosage(F.col("gt"), F.col("dp"), a.min_depth, a.het).alias("d")), a.max_dist, a.bins, a.maf, a.max_snps, a.min_samples)
    text.write_tsv(table, a.output, overwrite=a.overwrite)
    if a.half_decay_output:
        text.write_tsv(ld.half_decay(table), a.half_decay_output, overwrite=a.overwrite)


@command("coverage", "depth statistics of BAM files", _flag("--bam", many=True), _flag("--bam-list"), _flag("--engine", "auto"), _flag("--regions"), _flag("--chrom", many=True), number("--window", 1000), number("--min-mapq", 0), number("--min-baseq", 0), need("--output"), _flag("--windows-output"), *OVERWRITE)
def coverage_depth_stats(spark: SparkSession, a: Args) -> None:
    try:
        bam.resolve_engine(a.engine, a.min_baseq)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    paths = {p.rsplit("/", 1)[-1].removesuffix(".bam"): p for p in a.bam}
    if a.bam_list:
        for line in text.first_lines(spark, a.bam_list, None):
            path, _, name = line.partition("\t")
            paths[name or path.rsplit("/", 1)[-1].removesuffix(".bam")] = path
    if not paths:
        raise SystemExit("no BAM file given")
    lengths = bam.reference_lengths(spark, next(iter(paths.values())))
    blocks = bam.read_alignments(spark, paths, a.min_mapq, a.min_baseq)
    if a.chrom:
        lengths, blocks = lengths.where(F.col("chrom").isin(a.chrom)), blocks.where(F.col("chrom").isin(a.chrom))
    runs, regions = coverage.depth_runs(blocks, lengths), _bed(spark, a.regions)
    text.write_tsv(coverage.depth_summary(coverage.depth_histogram(runs, regions)), a.output, overwrite=a.overwrite)
    if a.windows_output:
        text.write_tsv(coverage.depth_windows(runs, a.window, lengths, regions), a.windows_output, overwrite=a.overwrite)


@command("coverage", "regions that hardly any sample covers", _flag("--windows", many=True, required=True), number("--min-depth", 5.0), number("--min-frac-samples", 0.9), number("--merge-gap", 0), number("--min-length", 0), _flag("--regions"), _flag("--genes"), need("--output"), *OVERWRITE)
def coverage_dropout_regions(spark: SparkSession, a: Args) -> None:
    windows = text.read_table(spark, a.windows[0], ("sample", "chrom", "start", "end", "mean_depth"))
    for path in a.windows[1:]:
        windows = windows.unionByName(text.read_table(spark, path))
    if a.regions:
        bed = _bed(spark, a.regions).toDF("_bc", "_bs", "_be")
        windows = interval_join(windows, bed, "left_semi", right_on=("_bc", "_bs", "_be"))
    out = coverage.dropout_regions(windows, a.min_depth, a.min_frac_samples, a.merge_gap, a.min_length)
    text.write_tsv(annotate(out, text.read_genes(spark, a.genes)) if a.genes else out, a.output, overwrite=a.overwrite)


def _simple(name: str, help: str, flags: tuple, step: Callable[[SparkSession, DataFrame, Args], DataFrame]) -> None:
    def run(spark: SparkSession, a: Args) -> None:
        out = step(spark, records(spark, a.input), a).drop("rescued", "modified")
        _write(out, a.output)
        print(f"{name}: {out.count()} records")

    run.__name__ = name
    command("vcf", help, *CALLSET, *flags)(run)


_simple("hard_qc_filter", "drop records with failing metrics", (number("--qd", 20.0), number("--mq", 55.0), number("--sor", 3.0), number("--mqranksum", -5.0), number("--readposranksum", -5.0), _flag("--fs", kind=float), *KEEP), lambda s, r, a: variants.hard_qc(r, a.qd, a.mq, a.sor, a.mqranksum, a.readposranksum, a.fs, _bed(s, a.keep_bed)))
_simple("singleton_filter_add_ads", "drop records with few carriers, add ADS", (number("--min-samples", 1), *KEEP), lambda s, r, a: variants.singleton_filter(r, a.min_samples, _bed(s, a.keep_bed)))
_simple("biallelic_snp_filter", "keep biallelic SNPs", (_flag("--no-trim", switch=True),), lambda s, r, a: variants.biallelic_snps(r, not a.no_trim))
_simple("strip_stale_format", "null fields of the wrong length", (_flag("--fields", "PL"), _flag("--mode", "mismatch", choices=["mismatch", "always"])), lambda s, r, a: variants.strip_stale(r, tuple(x.lower() for x in a.fields.split(",")), a.mode))
for _name, _exclude in (("tandem_repeat_mask", True), ("paralog_mask", True), ("core_region_filter", False)):
    _simple(_name, "drop records in regions" if _exclude else "keep records in regions", (need("--bed"), *KEEP), lambda s, r, a, x=_exclude: pipeline._mask(x)(r, _bed(s, a.bed), _bed(s, a.keep_bed)))
_simple("locus_missingness_filter", "drop records with missing or shallow calls", (number("--f-missing-max", 0.05), number("--ads-min", 10), number("--sample-frac-min", 0.95), *KEEP), lambda s, r, a: variants.locus_missingness(variants.add_ads(r), a.f_missing_max, a.ads_min, a.sample_frac_min, _bed(s, a.keep_bed)))
_simple("filter_ad_regenotype", "zero weak depths and call again", (number("--min-reads", 2), number("--min-freq", 0.01), number("--het-min-af", 0.2), _flag("--restrict-to-called-alleles", switch=True), _flag("--ploidy", kind=int, choices=[1, 2]), _flag("--no-add-ads", switch=True)), lambda s, r, a: variants.ad_regenotype(r, a.min_reads, a.min_freq, a.het_min_af, a.ploidy, a.restrict_to_called_alleles, not a.no_add_ads))
_simple("maf_filter", "keep records in a frequency window, or by group", (number("--maf-min", 0.01), _flag("--maf-max", kind=float), _flag("--meta"), _flag("--group-col"), *KEEP), lambda s, r, a: variants.maf_filter_grouped(r, _meta(s, a.meta, a.group_col), a.group_col, a.maf_min) if a.meta else variants.maf_filter(r, a.maf_min, a.maf_max, _bed(s, a.keep_bed)))


@command("vcf", "drop samples that cover too little", *CALLSET, number("--ads-min", 10), number("--frac-min", 0.80), _flag("--dropped-samples"), _flag("--cov-table"))
def sample_coverage_filter(spark: SparkSession, a: Args) -> None:
    out, table = variants.sample_coverage_filter(variants.add_ads(records(spark, a.input)), a.ads_min, a.frac_min)
    _write(out, a.output)
    if a.cov_table:
        text.write_tsv(table, a.cov_table, overwrite=True)
    if a.dropped_samples:
        text.write_tsv(table.where("dropped").select("sample"), a.dropped_samples, overwrite=True)


@command("vcf", "bring callsets to one allele list", _flag("--files", many=True, required=True), need("--stub"), number("--min-ad", 3), number("--min-af", 0.005), number("--het-min-af", 0.2), _flag("--keep-indels", switch=True))
def harmonize_bcf(spark: SparkSession, a: Args) -> None:
    if len(a.files) < 2:
        raise SystemExit("harmonizing takes two files or more")
    rows = None
    for path in a.files:
        one = records(spark, path).withColumn("cohort", F.lit(path)).withColumn("rec_ix", F.monotonically_increasing_id())
        rows = one if rows is None else rows.unionByName(one)
    union = harmonize.allele_union(rows, a.min_ad, a.min_af, a.keep_indels)
    out = harmonize.rewrite(rows, union, a.min_ad, a.min_af, a.het_min_af, a.keep_indels)
    for path in a.files:
        _write(out.where(F.col("cohort") == path).drop("cohort", "rec_ix"), f"{a.stub}.{path.rsplit('/', 1)[-1].split('.')[0]}")


@command("vcf", "a chain of filters from a JSON configuration", _flag("--input"), _flag("--config"), _flag("--outdir", "filter_pipeline"), _flag("--emit-default-config", switch=True), *KEEP)
def filter_pipeline(spark: SparkSession, a: Args) -> None:
    if a.emit_default_config:
        print(json.dumps(pipeline.DEFAULT, indent=2))
        return
    config = pipeline.load_config("\n".join(text.first_lines(spark, a.config, None))) if a.config else pipeline.DEFAULT
    beds = {step["name"]: _bed(spark, step["params"].pop("bed")) for step in config.get("steps", []) if step.get("enabled", True) and "bed" in step.get("params", {})}
    out, tally, reports = pipeline.run(records(spark, a.input), config, keep=_bed(spark, a.keep_bed), beds=beds, outdir=f"{a.outdir}/steps")
    _write(out, f"{a.outdir}/records")
    text.write_tsv(variants.snp_bed(out), f"{a.outdir}/snps.bed", overwrite=True)
    text.write_tsv(spark.createDataFrame(tally), f"{a.outdir}/variant_counts.tsv", overwrite=True)
    for name, df in reports.items():
        text.write_tsv(df, f"{a.outdir}/{name}.tsv", overwrite=True)


@command("vcf", "private variants and near-identical samples", need("--vcf"), _flag("--samples"), number("--max-missing-frac", 0.2), number("--min-depth", 5), number("--mad-cutoff", 5.0), number("--duplicate-frac", 0.9), need("--output"), *OVERWRITE)
def singleton_counts(spark: SparkSession, a: Args) -> None:
    cells = _cells(records(spark, a.vcf, samples=text.sample_list(a.samples, spark) if a.samples else None))
    flat = cells.select("site", "sample", "sample_ix", F.coalesce(F.exists("gt", lambda x: x > 0), F.lit(False)).alias("alt"), F.coalesce(F.exists("gt", lambda x: x.isNull()), F.lit(True)).alias("missing"), F.coalesce("dp", F.lit(-1)).alias("depth"))
    text.write_tsv(qc.flag_outliers(qc.singleton_counts(flat, a.max_missing_frac, a.min_depth), a.mad_cutoff, a.duplicate_frac), a.output, overwrite=a.overwrite)


@command("vcf", "strand-bias verdicts", need("--input-vcf"), need("--out-tsv"), _flag("--out-bed"), number("--min-drop-samples", 1), number("--min-vaf", 0.05), number("--min-minor-depth", 20), number("--ratio-hard", 0.15), number("--ratio-soft", 0.30), number("--sb-hard", 60.0))
def strand_bias_scan(spark: SparkSession, a: Args) -> None:
    rows = records(spark, a.input_vcf)
    if rows.where("size(alts) <> 1").limit(1).count():
        raise SystemExit("the callset is not biallelic")
    cells = _cells(rows)
    flat = cells.select("chrom", "pos0", "sample", *[F.get(c, i).alias(n) for c, i, n in (("adf", 0, "ref_fwd"), ("adf", 1, "alt_fwd"), ("adr", 0, "ref_rev"), ("adr", 1, "alt_rev"))])
    verdicts = qc.strand_bias(flat, a.min_vaf, a.min_minor_depth, a.ratio_hard, a.ratio_soft, a.sb_hard)
    text.write_tsv(verdicts, a.out_tsv, overwrite=True)
    if a.out_bed:
        text.write_tsv(qc.strand_blacklist(verdicts, a.min_drop_samples), a.out_bed, overwrite=True)


@command("vcf", "the reads over one site", need("--bam"), need("--pos"), need("--ref-base"), need("--alt-base"), number("--min-mapq", 0), _flag("--out"))
def strand_read_check(spark: SparkSession, a: Args) -> None:
    chrom, _, pos = a.pos.rpartition(":")
    rows = bam.pileup(spark, {a.bam.rsplit("/", 1)[-1]: a.bam}, chrom, int(pos) - 1, a.min_mapq)
    print(reads.site_report(bam.summarise_reads(rows, a.alt_base, a.ref_base), [r["seq_cycle"] for r in rows.where(F.col("base") == a.alt_base).limit(100_000).collect()], f"{a.pos} {a.ref_base}>{a.alt_base}"))
    if a.out:
        text.write_tsv(rows, a.out, overwrite=True)


@command("vcf", "mixture profiles", need("--input-vcf"), need("--out"), _flag("--sites-out"), _flag("--fws"), number("--monoclonal-threshold", 0.92), number("--min-dominant", 0.70), number("--max-residual-het", 0.02), number("--min-depth", 10), number("--min-minor", 0.02), number("--min-minor-reads", 2), number("--min-sites", 1000))
def wsaf_profile(spark: SparkSession, a: Args) -> None:
    found = wsaf.site_fractions(_cells(records(spark, a.input_vcf)).where("ad IS NOT NULL").select("site", "sample", "ad"), a.min_depth, a.min_minor, a.min_minor_reads)
    out = wsaf.profile(found, a.max_residual_het, a.min_minor, a.min_dominant, a.min_sites)
    if a.fws:
        out = wsaf.with_fws(out, text.read_table(spark, a.fws, ("sample", "fws")), a.monoclonal_threshold)
    text.write_tsv(out, a.out, overwrite=True)
    if a.sites_out:
        text.write_tsv(found.where("het").drop("het"), a.sites_out, overwrite=True)


def parser(name: str) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog=f"locusframe {name}", description=COMMANDS[name].help)
    for flag, options in COMMANDS[name].flags:
        out.add_argument(flag, **options)
    return out


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] in ("-h", "--help", "--list"):
        for group in dict.fromkeys(c.group for c in COMMANDS.values()):
            print(group)
            for name, c in COMMANDS.items():
                if c.group == group:
                    print(f"  {name:32} {c.help}")
        return 0
    if argv[0] == "--version":
        print(VERSION)
        return 0
    if argv[0] == "--list-plain":
        print("\n".join(COMMANDS))
        return 0
    if argv[0] not in COMMANDS:
        print(f"unknown command {argv[0]!r}; see --list", file=sys.stderr)
        return 2
    args = parser(argv[0]).parse_args(argv[1:])
    spark = SparkSession.builder.appName(f"locusframe {argv[0]}").getOrCreate()
    COMMANDS[argv[0]].run(spark, args)
    return 0
