"""Linkage-disequilibrium decay from genotype dosages packed as one array a site."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dosage(gt: Column, depth: Column | None = None, min_depth: int = 0, het: str = "missing") -> Column:
    """0, 2, or null for missing; a heterozygote is missing, or 1 with het='dosage'."""
    low, high = F.array_min(gt), F.array_max(gt)
    value = F.when(gt.isNull() | F.exists(gt, lambda a: a.isNull()), F.lit(None)).when(high == 0, 0).when(low > 0, 2).otherwise(F.lit(1) if het == "dosage" else F.lit(None))
    return F.when((depth < min_depth), F.lit(None)).otherwise(value).cast("int") if depth is not None and min_depth > 0 else value.cast("int")


def pack(dosages: DataFrame) -> DataFrame:
    """grp, chrom, pos0, d: dosages of a group's samples in one order (null where a sample has none).

    dosages: grp, chrom, pos0, sample, d. The arrays hold one element for every sample of the group."""
    names = dosages.select("grp", "sample").distinct().groupBy("grp").agg(F.sort_array(F.collect_set("sample")).alias("names"))
    maps = dosages.groupBy("grp", "chrom", "pos0").agg(F.map_from_entries(F.collect_list(F.struct("sample", "d"))).alias("m"))
    return maps.join(names, "grp").select("grp", "chrom", "pos0", F.transform("names", lambda s: F.try_element_at("m", s)).alias("d"))


def site_maf(packed: DataFrame) -> DataFrame:
    seen = F.filter("d", lambda x: x.isNotNull())
    p = F.try_divide(F.aggregate(seen, F.lit(0.0), lambda s, x: s + x), 2.0 * F.size(seen))
    return packed.withColumn("maf", F.least(p, 1 - p))


def thin(sites: DataFrame, max_snps: int = 3000) -> DataFrame:
    """At most max_snps sites of a chromosome, evenly by rank: those at the rounded points of a line over all ranks."""
    order = Window.partitionBy("grp", "chrom").orderBy("pos0")
    n = F.count("*").over(Window.partitionBy("grp", "chrom"))
    ranked = sites.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", n)
    step = (F.col("_n") - 1) / F.lit(float(max(max_snps - 1, 1)))
    near = F.bround(F.bround(F.col("_i") / step) * step)
    below = F.bround((F.bround(F.col("_i") / step) - 1) * step)
    above = F.bround((F.bround(F.col("_i") / step) + 1) * step)
    chosen = (F.col("_n") <= max_snps) | (near == F.col("_i")) | (below == F.col("_i")) | (above == F.col("_i"))
    return ranked.where(chosen).drop("_i", "_n")


def pairs(sites: DataFrame, max_dist: int = 50_000) -> DataFrame:
    """grp, chrom, pos_a, pos_b, dist, r2 over pairs of sites at most max_dist apart, by the samples that have both.

    Sites are dealt to windows of max_dist and meet those of their own and the next window only."""
    at = F.floor(F.col("pos0") / max_dist)
    a = sites.select("grp", "chrom", F.col("pos0").alias("pos_a"), F.col("d").alias("da"), F.explode(F.array(at, at + 1)).alias("_w"), at.alias("_own"))
    b = sites.select("grp", "chrom", F.col("pos0").alias("pos_b"), F.col("d").alias("db"), at.alias("_w"))
    met = a.join(b, ["grp", "chrom", "_w"]).where((F.col("pos_b") > F.col("pos_a")) & (F.col("pos_b") - F.col("pos_a") <= max_dist))
    both = F.filter(F.arrays_zip(F.col("da").alias("x"), F.col("db").alias("y")), lambda z: z["x"].isNotNull() & z["y"].isNotNull())
    met = met.withColumn("_z", both)
    total = lambda f: F.aggregate("_z", F.lit(0).cast("long"), lambda s, z: s + f(z))
    n = F.size("_z").cast("long")
    sx, sy = total(lambda z: z["x"]), total(lambda z: z["y"])
    sxx, syy, sxy = total(lambda z: z["x"] * z["x"]), total(lambda z: z["y"] * z["y"]), total(lambda z: z["x"] * z["y"])
    met = met.withColumns({"_n": n, "_sx": sx, "_sy": sy, "_sxx": sxx, "_syy": syy, "_sxy": sxy})
    top = F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    down = (F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")) * (F.col("_n") * F.col("_syy") - F.col("_sy") * F.col("_sy"))
    r2 = F.try_divide(top.cast("double") * top, down.cast("double"))
    return met.select("grp", "chrom", "pos_a", "pos_b", (F.col("pos_b") - F.col("pos_a")).alias("dist"), r2.alias("r2")).where("r2 IS NOT NULL")


def decay(found: DataFrame, groups: DataFrame, max_dist: int = 50_000, bins: int = 20) -> DataFrame:
    """Mean and median r2 by half-open distance bin; bins without pairs stay, with nulls. A pair at max_dist is in none."""
    edges = [float(x) for x in np.linspace(0, max_dist, bins + 1)]
    width = max_dist / bins
    counted = found.where(F.col("dist") < max_dist).groupBy("grp", F.floor(F.col("dist") / width).alias("bin")).agg(F.count("*").alias("n_pairs"), F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"))
    spine = groups.select("grp").distinct().crossJoin(F.broadcast(found.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin long, bin_start double, bin_end double")))
    out = spine.join(counted, ["grp", "bin"], "left").na.fill(0, ["n_pairs"])
    return out.select("grp", "bin_start", "bin_end", ((F.col("bin_start") + F.col("bin_end")) / 2).alias("bin_mid"), "n_pairs", "mean_r2", "median_r2")


def half_decay(table: DataFrame) -> DataFrame:
    """grp, half_decay_bp: where mean r2 falls to half of its first value, between bin middles; null if it never does."""
    order = Window.partitionBy("grp").orderBy("bin_mid")
    seen = table.where("mean_r2 IS NOT NULL").withColumn("_half", F.first("mean_r2").over(order) / 2).withColumn("_r", F.lag("mean_r2").over(order)).withColumn("_m", F.lag("bin_mid").over(order))
    share = F.try_divide(F.col("_r") - F.col("_half"), F.col("_r") - F.col("mean_r2"))
    hit = seen.where("_r IS NOT NULL AND mean_r2 <= _half").groupBy("grp").agg(F.min_by(F.col("_m") + share * (F.col("bin_mid") - F.col("_m")), "bin_mid").alias("half_decay_bp"))
    return table.select("grp").distinct().join(hit, "grp", "left")


def ld_decay(dosages: DataFrame, max_dist: int = 50_000, bins: int = 20, maf: float = 0.05, max_snps: int | None = 3000, min_samples: int = 4) -> DataFrame:
    """Decay table of every group with at least min_samples samples; max_snps None takes all sites of a chromosome."""
    sizes = dosages.select("grp", "sample").distinct().groupBy("grp").count().where(F.col("count") >= min_samples).select("grp")
    used = dosages.join(sizes, "grp", "left_semi")
    sites = site_maf(pack(used)).where(F.col("maf") >= maf)
    sites = sites if max_snps is None else thin(sites, max_snps)
    return decay(pairs(sites, max_dist), sizes, max_dist, bins)
