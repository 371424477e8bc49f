"""Genotypes from allele depths, and arithmetic on allele-indexed arrays.

A genotype is an array of allele indices; null elements are missing. Depths are arrays with one
element an allele; a null depth is a missing one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(ad: Column) -> Column:
    return F.aggregate(ad, F.lit(0).cast("long"), lambda s, d: s + F.coalesce(d, F.lit(0)))


def clean_ad(ad: Column, min_reads: int = 2, min_freq: float = 0.01, depth: Column | None = None, protect_ref: bool = False) -> Column:
    """Depths below min_reads or below min_freq of the sample's depth become 0."""
    whole = total(ad) if depth is None else depth

    def clean(d: Column, i: Column) -> Column:
        weak = (d < min_reads) | (F.coalesce(F.try_divide(d.cast("double"), whole), F.lit(0.0)) < min_freq)
        return F.when(weak & (i > 0) if protect_ref else weak, F.lit(0)).otherwise(d).cast("int")

    return F.transform(ad, clean)


def call_genotype(ad: Column, het_min_af: float = 0.2, ploidy: int = 2) -> Column:
    """Top allele twice, or the two top alleles in order of index where the second reaches het_min_af.

    Depth ranks first and the lower index breaks ties; no reads give a missing genotype. Ploidy 1
    takes the top allele alone."""
    ranked = F.array_sort(F.transform(ad, lambda d, i: F.struct((-F.coalesce(d, F.lit(0))).alias("k"), i.alias("i"))))
    top, second, depth = F.get(ranked, 0), F.get(ranked, 1), total(ad)
    missing = F.array(*[F.lit(None).cast("int")] * ploidy)
    hom = F.array(*[top["i"].cast("int")] * ploidy)
    if ploidy == 1:
        return F.when(depth == 0, missing).otherwise(hom)
    one = second.isNull() | (second["k"] == 0) | (F.try_divide(-second["k"].cast("double"), depth) < het_min_af)
    het = F.array_sort(F.array(top["i"].cast("int"), second["i"].cast("int")))
    return F.when(depth == 0, missing).when(one, hom).otherwise(het)


def call_within(ad: Column, called: Column) -> Column:
    """Diploid call among the alleles already called: the first two supported ones by index, no share needed."""
    kept = F.filter(F.transform(ad, lambda d, i: F.when((F.coalesce(d, F.lit(0)) > 0) & F.array_contains(called, i.cast("int")), i.cast("int"))), lambda i: i.isNotNull())
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
    return F.when(F.size(kept) == 0, none).when(F.size(kept) == 1, F.array(F.get(kept, 0), F.get(kept, 0))).otherwise(F.slice(kept, 1, 2))


def genotype_count(alleles: Column, ploidy: int = 2) -> Column:
    """Number of genotypes of a ploidy over so many alleles: C(alleles - 1 + ploidy, ploidy)."""
    out = F.lit(1).cast("long")
    for k in range(ploidy):
        out = out * (alleles + k)
    return (out / math.factorial(ploidy)).cast("int")


def is_alt(gt: Column) -> Column:
    """Some allele is not the reference and none is missing."""
    return F.exists(gt, lambda a: a > 0) & ~F.exists(gt, lambda a: a.isNull())


def is_missing(gt: Column) -> Column:
    return gt.isNull() | F.exists(gt, lambda a: a.isNull())


def remap(values: Column, kept: Column, default: Column) -> Column:
    """Elements of an allele-indexed array at the positions in kept; default where a position is null."""
    return F.transform(kept, lambda k: F.when(k.isNull(), default).otherwise(F.get(values, k.cast("int"))))
