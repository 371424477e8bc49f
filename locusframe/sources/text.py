"""Text sources and sinks: VCF, BED, IBD blocks, depth and frequency tables, sample lists.

Lines are read by Spark's text reader (gzip included) and taken apart with SQL functions. BGZF counts as
gzip. A gzip file is one task whatever its size, so it is dealt out again right after the split.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.coords import STAMP, CoordinateError, check_stamp, normalise_chr, snp_label
from locusframe.operators.intervals import merge_intervals

_INFO = {"QD": "qd", "MQ": "mq", "SOR": "sor", "FS": "fs", "MQRankSum": "mqranksum", "ReadPosRankSum": "readposranksum"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")


def first_lines(spark: SparkSession, path: str, n: int | None = 1) -> list[str]:
    """The first lines of a file, or all of a list or configuration that the driver needs whole."""
    rows = spark.read.text(path)
    return [r["value"] for r in (rows if n is None else rows.limit(n)).collect()]


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no #CHROM line")
    return head[0]["value"].split("\t")[9:]


def _snp_columns(chrom: Column, pos0: Column, source: Column) -> list[Column]:
    own = F.when((source != "") & (source != "."), source)
    return [snp_label(chrom, pos0).alias("snp_id"), chrom.alias("chrom"), pos0.alias("pos0"), own.alias("source_id")]


def read_panel(spark: SparkSession, path: str, fmt: str = "vcf") -> DataFrame:
    """snp_id, chrom, pos0, source_id of the sites of a VCF or BED file."""
    if fmt == "vcf":
        f = F.split("line", "\t")
        rows = _lines(spark, path).where(~F.col("line").startswith("#"))
        return rows.select(*_snp_columns(F.get(f, 0), F.get(f, 1).cast("long") - 1, F.get(f, 2)))
    if fmt == "bed":
        f = F.split("line", "\t")
        rows = _lines(spark, path).where(~F.col("line").rlike("^(#|track|browser)"))
        return rows.select(*_snp_columns(F.get(f, 0), F.get(f, 1).cast("long"), F.coalesce(F.get(f, 3), F.lit(""))))
    raise ValueError(f"unknown SNP format {fmt!r} (vcf or bed)")


def read_positions(spark: SparkSession, path: str, fmt: str = "vcf") -> DataFrame:
    return read_panel(spark, path, fmt).select(normalise_chr(F.col("chrom")).alias("chr"), "pos0")


def _ints(text: Column) -> Column:
    return F.when(text.isNotNull() & (text != "."), F.transform(F.split(text, ","), lambda x: F.when(x != ".", x).cast("int")))


def read_vcf(spark: SparkSession, path: str, samples: Sequence[str] | None = None, regions: Sequence[tuple[str, int, int]] = ()) -> DataFrame:
    """Records with nested calls: gt, phased, ad, ads, dp, pl, adf, adr of every sample (or those wanted, in file order).

    regions are 0-based half-open and narrow the lines before they are taken apart. Fields a record lacks are null."""
    names = vcf_samples(spark, path)
    if samples is not None and (unknown := set(samples) - set(names)):
        raise ValueError(f"{path}: no such samples: {', '.join(sorted(unknown))}")
    f = F.split("line", "\t")
    rows = _lines(spark, path).where(~F.col("line").startswith("#")).select(f.alias("f"))
    rows = rows.withColumn("chrom", F.get("f", 0)).withColumn("pos0", F.get("f", 1).cast("long") - 1)
    if regions:
        inside = F.lit(False)
        for c, a, b in regions:
            inside = inside | ((F.col("chrom") == c) & (F.col("pos0") >= a) & (F.col("pos0") < b))
        rows = rows.where(inside)
    info = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.split(F.get("f", 7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", ""))))))
    rows = rows.withColumn("keys", F.split(F.coalesce(F.get("f", 8), F.lit("")), ":")).withColumn("info", info)
    kept = [i for i, n in enumerate(names) if samples is None or n in set(samples)]

    def call(i: int) -> Column:
        cell = F.split(F.coalesce(F.get("f", 9 + i), F.lit(".")), ":")
        value = lambda key: F.when(F.array_contains("keys", key), F.get(cell, (F.array_position("keys", key) - 1).cast("int")))
        gt = value("GT")
        number = lambda key: F.when(value(key) != ".", value(key)).cast("int")
        return F.struct(
            F.lit(names[i]).alias("sample"), F.when(gt.isNotNull(), F.transform(F.split(gt, "[/|]"), lambda x: F.when(x != ".", x).cast("int"))).alias("gt"), F.coalesce(F.contains(gt, F.lit("|")), F.lit(False)).alias("phased"),
            _ints(value("AD")).alias("ad"), number("ADS").alias("ads"), number("DP").alias("dp"), _ints(value("PL")).alias("pl"), _ints(value("ADF")).alias("adf"), _ints(value("ADR")).alias("adr"),
        )

    metrics = [F.try_element_at("info", F.lit(k)).try_cast("double").alias(v) for k, v in _INFO.items()]
    alts = F.when(F.get("f", 4) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("f", 4), ","))
    filters = F.when(F.get("f", 6).isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(F.get("f", 6), ";"))
    source = F.when(~F.get("f", 2).isin(".", ""), F.get("f", 2))
    return rows.select("chrom", "pos0", source.alias("source_id"), F.get("f", 3).alias("ref"), alts.alias("alts"), filters.alias("filters"), "info", *metrics, F.array(*[call(i) for i in kept]).alias("calls"))


def write_vcf(records: DataFrame, path: str, samples: Sequence[str]) -> None:
    """Text VCF of GT, AD and ADS in coordinate order; part files, the header in the first."""
    def joined(values: Column) -> Column:
        return F.when(values.isNull(), ".").otherwise(F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("."))), ","))

    def cell(name: str) -> Column:
        c = F.get(F.filter("calls", lambda x: x["sample"] == name), 0)
        gt = F.coalesce(F.array_join(F.transform(c["gt"], lambda a: F.coalesce(a.cast("string"), F.lit("."))), "/"), F.lit("./."))
        return F.concat_ws(":", gt, joined(c["ad"]), F.coalesce(c["ads"].cast("string"), F.lit(".")))

    head = "\n".join([
        "##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allele depths">', '##FORMAT=<ID=ADS,Number=1,Type=Integer,Description="Sum of allele depths">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ])
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    source = F.col("source_id") if "source_id" in records.columns else F.lit(None).cast("string")
    line = F.concat_ws("\t", "chrom", (F.col("pos0") + 1).cast("string"), dot(source), "ref", dot(F.array_join("alts", ",")), F.lit("."), dot(F.array_join("filters", ";")), F.lit("."), F.lit("GT:AD:ADS"), *[cell(s) for s in samples])
    body = records.select(F.lit(1).alias("o"), "chrom", "pos0", line.alias("value"))
    top = records.sparkSession.createDataFrame([(0, "", -1, head)], "o int, chrom string, pos0 long, value string")
    top.unionByName(body).orderBy("o", "chrom", "pos0").select("value").write.text(path)


def read_bed(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    """chrom, start, end (and name unless merged); a line of fewer than three fields is an error."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).where(~F.col("line").rlike("^(#|track|browser)")).select(f.alias("f"))
    checked = rows.withColumn("f", F.when(F.size("f") >= 3, F.col("f")).otherwise(F.raise_error(F.lit(f"{path}: a BED line needs three fields"))))
    out = checked.select(F.get("f", 0).alias("chrom"), F.get("f", 1).cast("long").alias("start"), F.get("f", 2).cast("long").alias("end"), F.get("f", 3).alias("name"))
    return merge_intervals(out.select("chrom", "start", "end")) if merged else out


def read_blocks(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """IBD blocks; the file's end is the last SNP and becomes half-open."""
    head = next(x for x in first_lines(spark, path, 100) if not x.startswith("#")).split(sep)
    kinds = {"sample1": "string", "sample2": "string", "chr": "string"}
    raw = spark.read.csv(path, sep=sep, header=True, comment="#", schema=", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in head))
    return raw.withColumn("end", F.col("end") + 1)


def read_table(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A table whose first line has tabs, or else commas; required columns are found whatever their case."""
    line = first_lines(spark, path)[0]
    df = spark.read.csv(path, sep="\t" if "\t" in line else ",", header=True, inferSchema=True)
    for want in required:
        df = resolve_column(df, want)
    return df


def resolve_column(df: DataFrame, want: str) -> DataFrame:
    """Rename the column that equals `want` but for case; none, or several, is an error."""
    if want in df.columns:
        return df
    found = [c for c in df.columns if c.lower() == want.lower()]
    if len(found) != 1:
        raise ValueError(f"column {want!r}: {'ambiguous, ' + ', '.join(found) if found else 'missing; there are ' + ', '.join(df.columns)}")
    return df.withColumnRenamed(found[0], want)


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    df = df.withColumnRenamed("chrom", "chr") if "chr" not in df.columns and "chrom" in df.columns else df
    if missing := {"name", "chr", "start", "end"} - set(df.columns):
        raise ValueError(f"{path}: gene table lacks {', '.join(sorted(missing))}")
    return df if "gene_id" in df.columns else df.withColumn("gene_id", F.lit(None).cast("string"))


def read_af_table(spark: SparkSession, path: str, columns: Sequence[str] = ("snp_id", "af")) -> DataFrame:
    """A stamped frequency table; a missing stamp, a missing column or a repeated snp_id is an error."""
    check_stamp(first_lines(spark, path)[0])
    df = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=True)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    keys = [c for c in ("group", "snp_id") if c in df.columns]
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CoordinateError(f"{path}: snp_id occurs more than once; a table by ALT cannot be joined by SNP")
    return df.select(*[c for c in ("group",) if c in df.columns], *columns)


def read_ad_table(spark: SparkSession, path: str, samples: Sequence[str], snps_only: bool = False) -> DataFrame:
    """Depths site, chrom, pos0, sample, ref_ad, alt_ad from lines CHROM POS REF ALT and one `ref,alt` a sample; '.' is 0,0.

    Lines without ALT are skipped and lines with another number of fields left out; if none is left, that is an error."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path).where(~F.col("line").startswith("#")).select(f.alias("f")).where(~F.get("f", 3).isin(".", "<*>"))
    good = rows.where(F.size("f") == 4 + len(samples))
    if rows.limit(1).count() and not good.limit(1).count():
        raise ValueError(f"{path}: no line has {4 + len(samples)} fields")
    if snps_only:
        good = good.where((F.length(F.get("f", 2)) == 1) & (F.length(F.get("f", 3)) == 1))
    names = F.array(*[F.lit(s) for s in samples])
    cells = good.select(F.get("f", 0).alias("chrom"), (F.get("f", 1).cast("long") - 1).alias("pos0"), F.explode(F.arrays_zip(names.alias("sample"), F.slice("f", 5, len(samples)).alias("ad"))).alias("x"))
    part = lambda i: F.coalesce(F.get(F.split("x.ad", ","), i).try_cast("long"), F.lit(0).cast("long"))
    return cells.select(snp_label(F.col("chrom"), F.col("pos0")).alias("site"), "chrom", "pos0", "x.sample", part(0).alias("ref_ad"), part(1).alias("alt_ad"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ("chrom", "call_start", "call_end")).select("chrom", F.col("call_start").cast("long"), F.col("call_end").cast("long"))


def read_depth_bed(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Per-base depth as runs: sample, chrom, start, end, depth; runs stay runs."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, depth long")
    return raw.select(F.lit(sample).alias("sample"), "chrom", "start", "end", "depth")


def sample_list(text: str, spark: SparkSession | None = None) -> list[str]:
    """Names from a comma list, or one a line from a file."""
    if "," in text or spark is None or not re.search(r"[./]", text):
        return [s.strip() for s in text.split(",") if s.strip()]
    return [s.strip() for s in first_lines(spark, text, None) if s.strip()]


def write_tsv(df: DataFrame, path: str, comment: str | None = None, overwrite: bool = False) -> None:
    """One tab-separated file with a header, for reports; gzip if the path ends in .gz. A comment becomes a line before it."""
    gz = {"compression": "gzip"} if path.endswith(".gz") else {}
    mode = "overwrite" if overwrite else "errorifexists"
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    rows = df.select(F.concat_ws("\t", *columns).alias("value"))
    head = [*([comment if comment.startswith("#") else f"#{comment}"] if comment else []), "\t".join(df.columns)]
    top = df.sparkSession.createDataFrame([(0, "\n".join(head))], "o int, value string")
    top.union(rows.select(F.lit(1), "value")).coalesce(1).sortWithinPartitions("o").select("value").write.mode(mode).options(**gz).text(path)


def write_stamped(df: DataFrame, path: str, overwrite: bool = False) -> None:
    write_tsv(df, path, STAMP, overwrite)


def save_matrix(cells: DataFrame, pairs: DataFrame, panel: DataFrame, prefix: str, overwrite: bool = False) -> None:
    """The sparse pair-by-SNP table as three Parquet tables; the panel carries the coordinate stamp."""
    mode = "overwrite" if overwrite else "errorifexists"
    cells.write.mode(mode).parquet(f"{prefix}/cells")
    pairs.write.mode(mode).parquet(f"{prefix}/pairs")
    panel.withColumn("snp_coord_system", F.lit("0-based")).write.mode(mode).parquet(f"{prefix}/snps")


def load_matrix(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    panel = spark.read.parquet(f"{prefix}/snps")
    if "snp_coord_system" not in panel.columns or panel.where("snp_coord_system <> '0-based'").limit(1).count():
        raise CoordinateError(f"{prefix}: SNP labels do not state 0-based coordinates")
    return spark.read.parquet(f"{prefix}/cells"), spark.read.parquet(f"{prefix}/pairs"), panel.drop("snp_coord_system")
