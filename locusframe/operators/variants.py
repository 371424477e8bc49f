"""Callset filters and transforms over nested records.

A record is one row: chrom, pos0, ref, alts (array), filters (array), INFO metrics as columns, and calls, an
array of structs (sample, gt, ad, ads, pl). Everything that looks across samples is a higher-order
function over calls, so no filter shuffles. A missing metric never fails a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import genotype as g


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def rescue(records: DataFrame, passed: Column, keep: DataFrame | None) -> DataFrame:
    """Records that pass or whose position and alleles are those of a record meeting `keep`; adds rescued."""
    if keep is None:
        return records.where(passed).withColumn("rescued", F.lit(False))
    from locusframe.operators.intervals import region_filter

    marked = records.withColumn("_pass", passed)
    listed = region_filter(records.select("chrom", "pos0", "ref", "alts"), keep).select("chrom", "pos0", "ref", "alts", F.lit(True).alias("_white")).distinct()
    joined = marked.join(listed, ["chrom", "pos0", "ref", "alts"], "left")
    return joined.where(F.col("_pass") | _true(F.col("_white"))).withColumn("rescued", ~F.col("_pass")).drop("_pass", "_white")


def hard_qc(records: DataFrame, qd: float = 20, mq: float = 55, sor: float = 3, mqranksum: float = -5, readposranksum: float = -5, fs: float | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Records without a failing metric; a rescued one keeps FAIL among its filters."""
    have = set(records.columns)
    fails = [F.col(c) < v for c, v in (("qd", qd), ("mq", mq), ("mqranksum", mqranksum), ("readposranksum", readposranksum)) if c in have]
    fails += [F.col(c) > v for c, v in (("sor", sor), ("fs", fs)) if c in have and v is not None]
    failed = F.lit(False)
    for f in fails:
        failed = failed | _true(f)
    marked = records.withColumn("filters", F.when(failed, F.array_append(F.coalesce("filters", F.array().cast("array<string>")), F.lit("FAIL"))).otherwise(F.col("filters")))
    return rescue(marked, ~F.array_contains(F.coalesce("filters", F.array().cast("array<string>")), "FAIL"), keep)


def carriers(calls: Column) -> Column:
    """Samples whose genotype has a non-reference allele and nothing missing."""
    return F.size(F.filter(calls, lambda c: g.is_alt(c["gt"])))


def add_ads(records: DataFrame) -> DataFrame:
    """ADS of each sample: the sum of its AD over all alleles; null without AD."""
    return records.withColumn("calls", F.transform("calls", lambda c: c.withField("ads", F.when(c["ad"].isNotNull(), g.total(c["ad"])).cast("int"))))


def singleton_filter(records: DataFrame, min_samples: int = 1, keep: DataFrame | None = None) -> DataFrame:
    """Records with more than min_samples carriers, ADS added."""
    return add_ads(rescue(records, carriers(F.col("calls")) > min_samples, keep))


def _indices(kept: Column, ploidy: int = 2) -> Column:
    """Places of the genotypes over the kept alleles in a PL array over all alleles (diploid order)."""
    pairs = F.flatten(F.transform(kept, lambda b, j: F.transform(F.slice(kept, 1, j + 1), lambda a: (b * (b + 1) / 2 + a).cast("int"))))
    return pairs


def trim_alts(records: DataFrame) -> DataFrame:
    """Drop the ALTs that occur in no genotype; gt, ad and pl are renumbered by allele."""
    used = F.array_distinct(F.flatten(F.transform("calls", lambda c: F.filter(c["gt"], lambda a: a.isNotNull()))))
    marked = records.withColumn("_used", used).withColumn("_keep", F.filter(F.sequence(F.lit(0), F.size("alts")), lambda i: (i == 0) | F.array_contains("_used", i.cast("int"))))
    trimmed = F.size("_keep") < F.size("alts") + 1
    n = F.size("alts") + 1

    def fix(c: Column) -> Column:
        gt = F.transform(c["gt"], lambda a: F.when(a.isNull(), F.lit(None)).otherwise(F.array_position("_keep", a) - 1).cast("int"))
        ad = F.when(F.size(c["ad"]) == n, F.transform("_keep", lambda k: F.get(c["ad"], k))).otherwise(c["ad"])
        pl = F.when(F.size(c["pl"]) == g.genotype_count(n), F.transform(_indices(F.col("_keep")), lambda k: F.get(c["pl"], k))).otherwise(c["pl"])
        return c.withField("gt", gt).withField("ad", ad).withField("pl", pl)

    return marked.withColumn("calls", F.when(trimmed, F.transform("calls", fix)).otherwise(F.col("calls"))).withColumn(
        "alts", F.transform(F.slice("_keep", 2, F.greatest(F.size("_keep") - 1, F.lit(0))), lambda k: F.get("alts", k - 1))
    ).drop("_used", "_keep")


def is_snp(ref: Column, alts: Column) -> Column:
    return (F.length(ref) == 1) & F.forall(alts, lambda a: (F.length(a) == 1) & (a != "*"))


def biallelic_snps(records: DataFrame, trim: bool = True) -> DataFrame:
    rows = trim_alts(records) if trim else records
    return rows.where((F.size("alts") == 1) & is_snp(F.col("ref"), F.col("alts")))


def fill_tags(records: DataFrame) -> DataFrame:
    """ac (array), an, af (array), maf (share of the second commonest allele) and f_missing, from the genotypes."""
    slots = F.filter(F.flatten(F.transform("calls", lambda c: c["gt"])), lambda a: a.isNotNull())
    out = records.withColumn("_slots", slots).withColumn("an", F.size("_slots"))
    count = lambda k: F.size(F.filter("_slots", lambda a: a == k))
    out = out.withColumn("ac", F.transform(F.sequence(F.lit(1), F.greatest(F.size("alts"), F.lit(1))), lambda k: count(k)))
    out = out.withColumn("af", F.transform("ac", lambda x: F.try_divide(x.cast("double"), F.col("an"))))
    shares = F.sort_array(F.concat(F.transform("af", lambda x: x), F.array(1 - F.aggregate("af", F.lit(0.0), lambda s, x: s + x))), asc=False)
    missing = F.size(F.filter("calls", lambda c: g.is_missing(c["gt"])))
    return out.withColumn("maf", F.get(shares, 1)).withColumn("f_missing", F.try_divide(missing.cast("double"), F.size("calls"))).drop("_slots")


def sample_coverage(records: DataFrame, ads_min: int = 10, frac_min: float = 0.80) -> DataFrame:
    """How many loci each sample covers at ads_min, and whether it is dropped; the unrounded share decides."""
    cells = records.select(F.explode("calls").alias("c")).select("c.sample", "c.ads")
    sums = cells.groupBy("sample").agg(F.count("*").alias("n_loci"), F.count_if(F.col("ads") >= ads_min).alias("n_covered"), F.count_if(F.col("ads").isNull()).alias("n_missing_ads"), F.avg("ads").alias("_mean"))
    frac = F.try_divide(F.col("n_covered").cast("double"), F.col("n_loci"))
    return sums.select(
        "sample", "n_loci", "n_covered", F.round(frac, 6).alias("frac_covered"), "n_missing_ads", F.round("_mean", 2).alias("mean_ads"), F.lit(ads_min).alias("ads_min"), F.lit(frac_min).alias("frac_min"),
        F.round(frac - frac_min, 6).alias("margin"), (frac < frac_min).alias("dropped"),
    )


def borderline(table: DataFrame, within: float = 0.05) -> DataFrame:
    return table.where(F.col("dropped") | (F.abs("margin") <= within))


def drop_samples(records: DataFrame, dropped: list[str]) -> DataFrame:
    names = F.array(*[F.lit(s) for s in dropped]).cast("array<string>")
    return records.withColumn("calls", F.filter("calls", lambda c: ~F.array_contains(names, c["sample"])))


def sample_coverage_filter(records: DataFrame, ads_min: int = 10, frac_min: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """Records without the samples that cover too little, sites left with at most one carrier gone, tags refreshed; and the table.

    The names of the dropped samples are brought to the driver: they are columns of the callset, not rows."""
    table = sample_coverage(records, ads_min, frac_min)
    dropped = [r["sample"] for r in table.where("dropped").select("sample").collect()]
    return fill_tags(drop_samples(records, dropped).where(carriers(F.col("calls")) > 1)), table


def locus_missingness(records: DataFrame, f_missing_max: float = 0.05, ads_min: int = 10, sample_frac_min: float = 0.95, keep: DataFrame | None = None) -> DataFrame:
    tagged = fill_tags(records)
    deep = F.size(F.filter("calls", lambda c: _true(c["ads"] >= ads_min)))
    passed = _true(F.col("f_missing") < f_missing_max) & _true(F.try_divide(deep.cast("double"), F.size("calls")) >= sample_frac_min)
    return rescue(tagged, passed, keep)


def nonref_af(records: DataFrame) -> Column:
    return F.aggregate("af", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def maf_filter(records: DataFrame, maf_min: float = 0.01, maf_max: float | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Records whose non-reference frequency lies in [maf_min, maf_max], ends included; maf_max is 1 - maf_min unless given."""
    tagged = fill_tags(records)
    high = 1 - maf_min if maf_max is None else maf_max
    return rescue(tagged, _true((F.col("an") > 0) & nonref_af(tagged).between(maf_min, high)), keep)


def maf_filter_grouped(records: DataFrame, meta: DataFrame, group: str, maf_min: float = 0.01) -> DataFrame:
    """Records at positions where the minor-allele frequency reaches maf_min in any group; genotypes stay as they are."""
    cells = records.select("chrom", "pos0", "ref", "alts", F.explode("calls").alias("c")).select("chrom", "pos0", "ref", "alts", "c.sample", "c.gt")
    known = cells.join(meta.select("sample", F.col(group).alias("_g")), "sample")
    if not known.limit(1).count():
        raise ValueError("no sample of the callset has a group")
    alleles = known.select("chrom", "pos0", "ref", "alts", "_g", F.explode("gt").alias("a")).where("a IS NOT NULL")
    af = F.count_if(F.col("a") > 0) / F.count("*")
    by_group = alleles.groupBy("chrom", "pos0", "ref", "alts", "_g").agg(F.least(af, 1 - af).alias("_maf"))
    good = by_group.where(F.col("_maf") >= maf_min).select("chrom", "pos0").distinct()
    return records.join(good, ["chrom", "pos0"], "left_semi")


def ad_regenotype(records: DataFrame, min_reads: int = 2, min_freq: float = 0.01, het_min_af: float = 0.2, ploidy: int | None = None, restrict_to_called: bool = False, add_ads_field: bool = True) -> DataFrame:
    """Zero weak depths (REF is not protected), sum ADS again and call genotypes from what is left.

    A record in which any sample lacks AD or ADS passes unchanged; ADS is derived where it is absent and
    add_ads_field is set. Likelihoods no longer fit and become missing, at the width of their genotypes. With
    ploidy None samples stay diploid; 2 refuses haploid input; 1 makes calls haploid."""
    rows = records
    if ploidy == 2 and rows.where(F.exists("calls", lambda c: F.size(c["gt"]) == 1)).limit(1).count():
        raise ValueError("ploidy 2 was asked for, but the callset has haploid genotypes")
    if add_ads_field:
        rows = rows.withColumn("calls", F.transform("calls", lambda c: c.withField("ads", F.coalesce(c["ads"], F.when(c["ad"].isNotNull() & ~F.exists(c["ad"], lambda d: d.isNull()), g.total(c["ad"])).cast("int")))))
    broken = F.exists("calls", lambda c: c["ad"].isNull() | c["ads"].isNull() | F.exists(c["ad"], lambda d: d.isNull()))
    width = g.genotype_count(F.size("alts") + 1, ploidy or 2)

    def again(c: Column) -> Column:
        ad = g.clean_ad(c["ad"], min_reads, min_freq, depth=c["ads"])
        if restrict_to_called and ploidy != 1:
            gt = g.call_within(ad, c["gt"])
        else:
            gt = g.call_genotype(ad, het_min_af, ploidy or 2)
        pl = F.when(c["pl"].isNotNull(), F.array_repeat(F.lit(None).cast("int"), width))
        return c.withField("ad", ad).withField("ads", g.total(ad).cast("int")).withField("gt", gt).withField("pl", pl)

    return rows.withColumn("calls", F.when(broken, F.col("calls")).otherwise(F.transform("calls", again)))


def _null_misfits(records: DataFrame, field: str, width: Column) -> DataFrame:
    bad = F.exists("calls", lambda c: _true(F.size(c[field]) != width))
    out = records.withColumn("_bad", bad).withColumn("modified", F.col("modified") | F.col("_bad"))
    nulled = F.transform("calls", lambda c: c.withField(field, F.array_repeat(F.lit(None).cast("int"), width)))
    return out.withColumn("calls", F.when(F.col("_bad"), nulled).otherwise(F.col("calls"))).drop("_bad")


def strip_stale(records: DataFrame, fields: tuple[str, ...] = ("pl",), mode: str = "mismatch", ploidy: int = 2) -> DataFrame:
    """Null the fields of records where a sample's length is not that of the record's genotypes, or drop them (always).

    Adds modified."""
    if mode == "always":
        return records.withColumn("calls", F.transform("calls", lambda c: c.dropFields(*fields))).withColumn("modified", F.lit(True))
    if mode != "mismatch":
        raise ValueError(f"mode must be 'mismatch' or 'always', got {mode!r}")
    width = {"pl": g.genotype_count(F.size("alts") + 1, ploidy), "ad": F.size("alts") + 1}
    out = records.withColumn("modified", F.lit(False))
    for f in fields:
        out = _null_misfits(out, f, width[f])
    return out


def snp_bed(records: DataFrame) -> DataFrame:
    """chrom, start, end, name of the SNP records."""
    return records.where(is_snp(F.col("ref"), F.col("alts"))).select("chrom", F.col("pos0").alias("start"), (F.col("pos0") + 1).alias("end"), F.concat_ws(":", "chrom", "pos0").alias("name"))


def is_indel_context(ref: Column, alts: Column) -> Column:
    return (F.length(ref) != 1) | F.exists(alts, lambda a: F.length(a) != 1)
