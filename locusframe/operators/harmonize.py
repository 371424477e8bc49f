"""Harmonizing callsets of several cohorts to one allele list per position.

Records of all cohorts stand in one frame with a cohort column and rec_ix, their order in the file. Pass
one finds, for each cohort and position, the ALTs that any sample still supports; pass two rewrites
every record to the union by allele string, so that genotypes, depths and alleles always agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import genotype as g
from locusframe.operators.variants import is_indel_context

#: INFO fields that no longer hold after alleles change.
STALE_INFO = ("AC", "AF", "AN", "MLEAC", "MLEAF", "MAF", "F_MISSING", "NS", "AC_Hom", "AC_Het", "AC_Hemi", "HWE")


def _weak(d: Column, depth: Column, min_ad: int, min_af: float) -> Column:
    return (d < min_ad) | (F.coalesce(F.try_divide(d.cast("double"), depth), F.lit(0.0)) < min_af)


def surviving(records: DataFrame, min_ad: int = 3, min_af: float = 0.005) -> DataFrame:
    """Adds `alive`: ALTs that some sample supports at min_ad reads and min_af of its depth ('.' never is)."""
    def supported(a: Column, k: Column) -> Column:
        return (a != ".") & F.exists("calls", lambda c: F.coalesce(~_weak(F.get(c["ad"], k + 1), g.total(c["ad"]), min_ad, min_af), F.lit(False)))

    return records.withColumn("alive", F.filter("alts", lambda a, k: supported(a, k)))


def one_a_position(records: DataFrame) -> DataFrame:
    """Of several records of a cohort at a position the one with most real ALTs, the later one on a tie; adds duplicates and ambiguous."""
    at = Window.partitionBy("cohort", "chrom", "pos0")
    real = F.size(F.filter("alts", lambda a: a != "."))
    out = records.withColumn("_real", real).withColumn("duplicates", F.count("*").over(at) - 1).withColumn("ambiguous", F.count_if(F.col("_real") > 0).over(at) > 1)
    best = F.row_number().over(at.orderBy(F.desc("_real"), F.desc("rec_ix")))
    return out.withColumn("_rn", best).where("_rn = 1").drop("_rn", "_real")


def allele_union(records: DataFrame, min_ad: int = 3, min_af: float = 0.005, keep_indels: bool = False) -> DataFrame:
    """chrom, pos0, ref (of the first cohort that has the position) and union_alts, sorted, over all cohorts."""
    rows = records if keep_indels else records.where(~is_indel_context(F.col("ref"), F.col("alts")))
    alive = surviving(one_a_position(rows), min_ad, min_af)
    return alive.groupBy("chrom", "pos0").agg(F.min_by("ref", "cohort").alias("ref"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("alive")))).alias("union_alts"))


def rewrite(records: DataFrame, union: DataFrame, min_ad: int = 3, min_af: float = 0.005, het_min_af: float = 0.2, keep_indels: bool = False) -> DataFrame:
    """Each cohort's record in terms of the union: alts, AD padded with 0, genotypes by allele string.

    Weak ALT depths are zeroed (REF never), samples that lose their support or gain alleles are called
    again, missing depths stay missing, and positions without any ALT go. Adds alts_added."""
    rows = records if keep_indels else records.where(~is_indel_context(F.col("ref"), F.col("alts")))
    joined = one_a_position(rows).join(union.select("chrom", "pos0", F.col("ref").alias("_ref"), "union_alts"), ["chrom", "pos0"]).where(F.size("union_alts") > 0)
    old, new = F.concat(F.array("ref"), F.col("alts")), F.concat(F.array("_ref"), F.col("union_alts"))
    marked = joined.withColumn("_old", old).withColumn("_new", new).withColumn("_added", F.size(F.array_except("union_alts", "alts")))

    def again(c: Column) -> Column:
        depth = g.total(c["ad"])
        clean = F.transform(c["ad"], lambda d, i: F.when((i > 0) & _weak(d, depth, min_ad, min_af), F.lit(0)).otherwise(d).cast("int"))
        moved = F.transform("_new", lambda a: F.coalesce(F.get(clean, (F.array_position("_old", a) - 1).cast("int")), F.lit(0)).cast("int"))
        changed = (F.col("_added") > 0) | F.exists(F.arrays_zip(c["ad"].alias("x"), clean.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"]))
        kept = F.transform(c["gt"], lambda i: F.when(i.isNotNull(), F.array_position("_new", F.get("_old", i)) - 1).cast("int"))
        gt = F.when(c["ad"].isNull(), kept).when(changed, g.call_genotype(moved, het_min_af)).otherwise(kept)
        return c.withField("ad", F.when(c["ad"].isNotNull(), moved)).withField("gt", gt)

    return marked.withColumn("calls", F.transform("calls", again)).withColumn("ref", F.col("_ref")).withColumn("alts", F.col("union_alts")).withColumn("alts_added", F.col("_added").cast("long")).drop("_ref", "union_alts", "_old", "_new", "_added")


def stats(records: DataFrame, union: DataFrame, min_ad: int = 3, min_af: float = 0.005) -> DataFrame:
    """By cohort: records written, with alleles added, left out for lack of any ALT, union positions it does not have."""
    rows = one_a_position(records.where(~is_indel_context(F.col("ref"), F.col("alts"))))
    marked = rows.join(union.select("chrom", "pos0", "union_alts"), ["chrom", "pos0"])
    sites = union.where(F.size("union_alts") > 0).agg(F.count("*").alias("_sites"))
    has = F.size("union_alts") > 0
    out = marked.groupBy("cohort").agg(
        F.count_if(has).alias("written"), F.count_if(has & (F.size(F.array_except("union_alts", "alts")) > 0)).alias("alts_added"), F.count_if(~has).alias("dropped_ref_only")
    )
    return out.crossJoin(F.broadcast(sites)).withColumn("absent", F.col("_sites") - F.col("written")).drop("_sites")


def strip_info(info: Column) -> Column:
    """INFO map without the fields that are stale after rewriting."""
    stale = F.array(*[F.lit(k) for k in STALE_INFO])
    return F.map_filter(info, lambda k, _: ~F.array_contains(stale, k))
