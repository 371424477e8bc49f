"""Identity-by-descent: block filters, the sparse pair-by-SNP table and its summaries.

The table stays long, one row a (pair, SNP) cell that is shared; pairs and SNPs without cells live in
their own frames and come back as zeros. Evidence is filtered, the set of compared pairs never is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.coords import BP_PER_CM, PF3D7_LENGTHS, normalise_chr
from locusframe.operators.intervals import interval_join, merge_intervals
from locusframe.shipping import ship

PAIR = ["sample1", "sample2"]
#: Bins that blocks and genes, some tens of kb both, meet in: a block has fewer than two on average, and no more candidates than in smaller ones.
GENE_BIN = 65_536
#: Samples that the first pass of clusters() keeps before it hands them on.
FOREST = 1 << 18


def _paired(df: DataFrame) -> DataFrame:
    return df.withColumns({"sample1": F.least("sample1", "sample2"), "sample2": F.greatest("sample1", "sample2")})


def filter_blocks(blocks: DataFrame, min_snp: int | None = 15, min_kb: float | None = 15.0) -> DataFrame:
    """Blocks of at least min_kb and min_snp; 0 or None lifts a limit, as does a missing Nsnp column for min_snp."""
    out = blocks
    if min_kb:
        out = out.where(F.col("end") - F.col("start") >= min_kb * 1000)
    if min_snp and "Nsnp" in blocks.columns:
        out = out.where(F.col("Nsnp") >= min_snp)
    return out


def pair_index(blocks: DataFrame) -> DataFrame:
    """Every compared pair once, its samples in order."""
    return _paired(blocks.select(*PAIR)).distinct()


def ibd_cells(blocks: DataFrame, panel: DataFrame, all_blocks: bool = False, min_snp: int | None = 15, min_kb: float | None = 15.0) -> DataFrame:
    """sample1, sample2, chrom, pos0, snp_ix once for every SNP a pair shares; blocks that overlap count once."""
    used = filter_blocks(blocks if all_blocks else blocks.where("different = 0"), min_snp, min_kb)
    spans = _paired(used).select(*PAIR, F.col("chr").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    points = panel.select("chrom", "pos0", "snp_ix", F.col("pos0").alias("_ps"), (F.col("pos0") + 1).alias("_pe"))
    hits = interval_join(spans, points, left_on=("_c", "_s", "_e"), right_on=("chrom", "_ps", "_pe"))
    return hits.select(*PAIR, "chrom", "pos0", "snp_ix").distinct()


def per_pair(cells: DataFrame, pairs: DataFrame, n_snps: int) -> DataFrame:
    counted = cells.groupBy(*PAIR).agg(F.count("*").alias("n_ibd_snps"))
    return pairs.join(counted, PAIR, "left").na.fill(0, ["n_ibd_snps"]).withColumn("frac_ibd", F.col("n_ibd_snps") / F.lit(float(n_snps)))


def per_snp(cells: DataFrame, panel: DataFrame, n_pairs: int) -> DataFrame:
    counted = cells.groupBy("snp_ix").agg(F.count("*").alias("n_pairs_ibd"))
    return panel.join(counted, "snp_ix", "left").na.fill(0, ["n_pairs_ibd"]).withColumn("frac_pairs_ibd", F.col("n_pairs_ibd") / F.lit(float(n_pairs)))


def annotate_pairs(pairs: DataFrame, meta: DataFrame, group: str) -> DataFrame:
    """group1, group2 ('unknown' for samples without one) and same_group."""
    side = lambda n: meta.select(F.col("sample").alias(f"sample{n}"), F.col(group).alias(f"group{n}"))
    out = pairs.join(side(1), "sample1", "left").join(side(2), "sample2", "left").na.fill("unknown", ["group1", "group2"])
    return out.withColumn("same_group", F.col("group1") == F.col("group2"))


def _by_groups(cells: DataFrame, panel: DataFrame, pairs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by group key and SNP, with a row for every SNP of every key that has pairs."""
    totals = kept.groupBy(*keys).agg(F.count("*").alias("n_pairs_total"))
    counted = cells.join(kept.select(*PAIR, *keys), PAIR).groupBy(*keys, "snp_ix").agg(F.count("*").alias("n_pairs_ibd"))
    spine = F.broadcast(totals).crossJoin(panel)
    return spine.join(counted, [*keys, "snp_ix"], "left").na.fill(0, ["n_pairs_ibd"]).withColumn("frac_pairs_ibd", F.col("n_pairs_ibd") / F.col("n_pairs_total"))


def per_snp_within_groups(cells: DataFrame, panel: DataFrame, annotated: DataFrame) -> DataFrame:
    kept = annotated.where("same_group AND group1 <> 'unknown'").withColumnRenamed("group1", "group")
    return _by_groups(cells, panel, annotated, kept, ["group"])


def per_snp_between_groups(cells: DataFrame, panel: DataFrame, annotated: DataFrame) -> DataFrame:
    """Every unordered pair of groups, the diagonal included; pairs with an unknown sample are left out."""
    kept = annotated.where("group1 <> 'unknown' AND group2 <> 'unknown'").withColumns({"group_a": F.least("group1", "group2"), "group_b": F.greatest("group1", "group2")})
    return _by_groups(cells, panel, annotated, kept, ["group_a", "group_b"])


def _moments(value: str, sd: Column) -> list[Column]:
    return [F.avg(value).alias("mean"), F.median(value).alias("median"), sd.alias("std"), F.count("*").alias("count")]


def within_between(annotated: DataFrame, value: str = "frac_ibd") -> DataFrame:
    kind = F.when(F.col("same_group"), "within_group").otherwise("between_group").alias("comparison_type")
    return annotated.groupBy(kind).agg(*_moments(value, F.stddev_samp(value)))


def pairwise_groups(annotated: DataFrame, value: str = "frac_ibd") -> DataFrame:
    return annotated.groupBy(F.least("group1", "group2").alias("reg_a"), F.greatest("group1", "group2").alias("reg_b")).agg(*_moments(value, F.stddev_samp(value)))


def per_chromosome(cells: DataFrame, panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean, median and population SD over all pairs of the share of a chromosome's SNPs they share.

    Pairs that share nothing are put back as a count of zeros, not as rows: moments are taken from the sums,
    and the median from the counts of each value."""
    width = panel.groupBy("chrom").agg(F.count("*").alias("n_snps"))
    total = pairs.agg(F.count("*").alias("n"))
    counted = cells.groupBy(*PAIR, "chrom").agg(F.count("*").alias("k")).groupBy("chrom", "k").agg(F.count("*").alias("m"))
    seen = counted.groupBy("chrom").agg(F.sum("m").alias("with_any"))
    zeros = width.join(seen, "chrom", "left").crossJoin(F.broadcast(total)).select("chrom", F.lit(0).cast("long").alias("k"), (F.col("n") - F.coalesce("with_any", F.lit(0))).alias("m"))
    values = counted.unionByName(zeros).where("m > 0").join(width, "chrom").withColumn("x", F.col("k") / F.col("n_snps").cast("double"))
    order = Window.partitionBy("chrom").orderBy("x")
    cum = F.sum("m").over(order)
    n = F.sum("m").over(Window.partitionBy("chrom"))
    ranked = values.withColumn("_cum", cum).withColumn("_n", n)
    lower = F.min(F.when(F.col("_cum") >= F.floor((F.col("_n") + 1) / 2), F.col("x")))
    upper = F.min(F.when(F.col("_cum") >= F.floor(F.col("_n") / 2) + 1, F.col("x")))
    mean = F.sum(F.col("m") * F.col("x")) / F.sum("m")
    square = F.sum(F.col("m") * F.col("x") * F.col("x")) / F.sum("m")
    return ranked.groupBy("chrom").agg(mean.alias("mean"), ((lower + upper) / 2).alias("median"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def callable_spans(panel: DataFrame) -> DataFrame:
    """chr, first and last SNP, their number, the span between them and the chromosome's full length."""
    spans = panel.groupBy(normalise_chr(F.col("chrom")).alias("chr")).agg(F.min("pos0").alias("first"), F.max("pos0").alias("last"), F.count("*").alias("n_snps"))
    length = F.element_at(F.create_map(*[F.lit(x) for kv in PF3D7_LENGTHS.items() for x in kv]), F.col("chr")).cast("long")
    return spans.withColumn("span", F.greatest(F.col("last") - F.col("first"), F.lit(0))).withColumn("length", length)


def pair_fraction(blocks: DataFrame, accessible_bp: float, full_bp: float | None = None, bp_per_cm: float = BP_PER_CM, min_snp: int | None = 15, min_kb: float | None = 15.0) -> DataFrame:
    """Shared length of every compared pair and its rough time to the common ancestor, null for pairs that share nothing."""
    used = _paired(filter_blocks(blocks.where("different = 0"), min_snp, min_kb)).withColumn("bp", F.col("end") - F.col("start"))
    sums = used.groupBy(*PAIR).agg(F.sum("bp").alias("total_ibd_bp"), F.max("bp").alias("max_ibd_bp"))
    out = pair_index(blocks).join(sums, PAIR, "left").na.fill(0, ["total_ibd_bp", "max_ibd_bp"])
    fraction = F.col("total_ibd_bp") / F.lit(float(accessible_bp))
    clipped = F.least(F.greatest(fraction, F.lit(1e-6)), F.lit(1.0))
    out = out.select(
        F.concat_ws("__", *PAIR).alias("pair"), *PAIR, "total_ibd_bp", "max_ibd_bp", (F.col("total_ibd_bp") / F.lit(bp_per_cm)).alias("total_ibd_cm"), (F.col("max_ibd_bp") / F.lit(bp_per_cm)).alias("max_ibd_cm"),
        fraction.alias("ibd_fraction_accessible"), F.when(fraction > 0, F.greatest(F.lit(0.0), F.log2(1 / clipped))).alias("gen_to_mrca_approx"),
    )
    return out.withColumn("ibd_fraction_full_genome", F.col("total_ibd_bp") / F.lit(float(full_bp))) if full_bp else out


def snp_density(panel: DataFrame, lengths: dict[str, int] | None = None, bp_per_cm: float = BP_PER_CM) -> DataFrame:
    """chr, win, n_snps for every whole 1-cM window of a chromosome; SNPs beyond the last window do not count."""
    spark = panel.sparkSession
    width = int(bp_per_cm)
    known = spark.createDataFrame([(c, n // width) for c, n in (lengths or PF3D7_LENGTHS).items()], "chr string, windows long")
    spine = F.broadcast(known.where("windows > 0")).select("chr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("win"))
    counted = panel.groupBy(normalise_chr(F.col("chrom")).alias("chr"), F.floor(F.col("pos0") / width).alias("win")).agg(F.count("*").alias("n_snps"))
    return spine.join(counted, ["chr", "win"], "left").na.fill(0, ["n_snps"])


def group_pair_totals(blocks: DataFrame, meta: DataFrame, group: str) -> DataFrame:
    """group_a, group_b, n_pairs_total: possible pairs among samples that occur in any block."""
    samples = blocks.select(F.col("sample1").alias("sample")).union(blocks.select("sample2")).distinct()
    sizes = samples.join(meta.select("sample", F.col(group).alias("g")), "sample").groupBy("g").agg(F.count("*").alias("n"))
    a, b = sizes.toDF("group_a", "na"), sizes.toDF("group_b", "nb")
    total = F.when(F.col("group_a") == F.col("group_b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")).cast("long")
    return a.join(b, F.col("group_a") <= F.col("group_b")).select("group_a", "group_b", total.alias("n_pairs_total"))


def _gene_spans(genes: DataFrame, within: int) -> DataFrame:
    return genes.select(
        F.col("name").alias("gene"), "gene_id", normalise_chr(F.col("chr")).alias("_gc"), F.col("start").alias("gene_start"), F.col("end").alias("gene_end"),
        (F.col("start") - within).alias("_ps"), (F.col("end") + within).alias("_pe"),
    )


def gene_sharers(blocks: DataFrame, genes: DataFrame, within: int = 0, min_snp: int | None = 15, min_kb: float | None = 15.0) -> DataFrame:
    """gene, gene_id, sample1, sample2 for every gene that a pair shares in part; a row may repeat.

    A pair's blocks are merged before they meet the genes, so rows grow with genes and pairs, not with blocks."""
    used = _paired(filter_blocks(blocks.where("different = 0"), min_snp, min_kb))
    spans = merge_intervals(used.select(*PAIR, normalise_chr(F.col("chr")).alias("chrom"), "start", "end"), by=tuple(PAIR))
    return interval_join(spans, _gene_spans(genes, within), right_on=("_gc", "_ps", "_pe")).select("gene", "gene_id", *PAIR)


def gene_overlap(blocks: DataFrame, genes: DataFrame, meta: DataFrame, group: str, within: int = 0, min_snp: int | None = 15, min_kb: float | None = 15.0) -> DataFrame:
    """Distinct pairs that share a gene, for every gene and unordered pair of groups."""
    side = lambda n: meta.select(F.col("sample").alias(f"sample{n}"), F.col(group).alias(f"_g{n}"))
    keys = ["gene", "gene_id", "group_a", "group_b"]
    hits = gene_sharers(blocks, genes, within, min_snp, min_kb).join(side(1), "sample1").join(side(2), "sample2")
    hits = hits.select("gene", "gene_id", F.least("_g1", "_g2").alias("group_a"), F.greatest("_g1", "_g2").alias("group_b"), *PAIR)
    counted = hits.repartition(*keys).distinct().groupBy(*keys).agg(F.count("*").alias("n_pairs_ibd"))  # one shuffle for both
    spine = genes.select(F.col("name").alias("gene"), "gene_id", "chr", "start", "end").crossJoin(F.broadcast(group_pair_totals(blocks, meta, group)))
    out = spine.join(counted, keys, "left").na.fill(0, ["n_pairs_ibd"])
    return out.withColumn("frac_pairs_ibd", F.try_divide(F.col("n_pairs_ibd").cast("double"), F.col("n_pairs_total")))


def gene_pairs(blocks: DataFrame, genes: DataFrame, within: int = 0, min_snp: int | None = 15, min_kb: float | None = 15.0) -> DataFrame:
    """A row for each pair, block and gene that meet, with how much of the gene the block covers; padding only selects.

    Both sides are sorted before they are dealt (the optimiser drops a sort right below a join), so neighbouring rows are alike and files of them smaller."""
    used = _paired(filter_blocks(blocks.where("different = 0"), min_snp, min_kb))
    spans = used.select(*PAIR, normalise_chr(F.col("chr")).alias("_bc"), F.col("chr").alias("block_chr"), F.col("start").alias("block_start"), F.col("end").alias("block_end"))
    spans = spans.sortWithinPartitions("_bc", "block_start", "block_end")
    near = _gene_spans(genes, within).sortWithinPartitions("_gc", "gene_start", "gene_end")
    hits = interval_join(spans, near, width=GENE_BIN, left_on=("_bc", "block_start", "block_end"), right_on=("_gc", "_ps", "_pe"))
    lo, hi = F.greatest("block_start", "gene_start"), F.least("block_end", "gene_end")
    bp = F.greatest(hi - lo, F.lit(0))
    complete = (F.col("block_start") <= F.col("gene_start")) & (F.col("block_end") >= F.col("gene_end"))
    return hits.select(
        *PAIR, F.col("block_chr").alias("chr"), "block_start", "block_end", "gene", "gene_id", "gene_start", "gene_end", F.when(complete, "complete").otherwise("partial").alias("coverage"),
        F.when(bp > 0, lo).alias("covered_start"), F.when(bp > 0, hi).alias("covered_end"), bp.alias("covered_bp"), F.try_divide(100.0 * bp.cast("double"), F.col("gene_end") - F.col("gene_start")).alias("percent_covered"),
    )


def number_panel(panel: DataFrame) -> DataFrame:
    """panel with snp_ix from 0 on in genome order, without gaps: places within a chromosome plus one offset a chromosome."""
    place = F.row_number().over(Window.partitionBy("chrom").orderBy("pos0", "snp_id")) - 1
    sizes = panel.groupBy("chrom").agg(F.count("*").alias("_n"))
    first = sizes.select("chrom", (F.sum("_n").over(Window.orderBy("chrom")) - F.col("_n")).alias("_first"))  # one row a chromosome
    return panel.withColumn("_place", place).join(first, "chrom").withColumn("snp_ix", (F.col("_place") + F.col("_first")).cast("long")).drop("_place", "_first")


def _forest(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (key, a, b) to (key, node, smallest node linked to it), by union-find over the samples of a key.

    With whole, a partition holds all edges of its keys in order of keys, and so the result is final;
    without, it is a shorter list of edges with the same components."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        schema, nodes, last = None, 0, None

        def root(up: dict, x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def rows(keys: list) -> pa.RecordBatch:
            found = [(k, x, root(trees[k], x)) for k in keys for x in trees[k]]
            for k in keys:
                del trees[k]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], ["key", "node", "label"])

        for batch in batches:
            schema = batch.schema
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if whole and key != last and nodes > 10_000:
                    yield rows([*trees])
                    nodes = 0
                last = key
                if (up := trees.get(key)) is None:
                    up = trees[key] = {}
                had = len(up)
                up.setdefault(a, a)
                up.setdefault(b, b)
                nodes += len(up) - had
                if (x := root(up, a)) != (y := root(up, b)):
                    if x < y:
                        up[y] = x
                    else:
                        up[x] = y
            if not whole and nodes > FOREST:
                yield rows([*trees])
                nodes = 0
        if trees:
            yield rows([*trees])

    return linked


def clusters(edges: DataFrame, key: str = "gene_id") -> DataFrame:
    """key, sample, gene_cluster_id, gene_cluster_size: single linkage within each key.

    Ids go by size, ties by the smallest member; a sample with an edge to itself alone is a cluster. Every
    task first leaves an edge a sample of what it has of a key, so the task that finishes a key reads its
    samples, not its pairs, and keeps them in memory."""
    used = edges.select(F.col(key).alias("key"), F.col("sample1").alias("node"), F.col("sample2").alias("label")).dropna()
    ship(edges.sparkSession)
    shape = used.schema
    short = used.mapInArrow(_forest(False), shape).repartition("key").sortWithinPartitions("key")
    labels = short.mapInArrow(_forest(True), shape).repartition("key")
    sized = labels.withColumn("gene_cluster_size", F.count("*").over(Window.partitionBy("key", "label")))
    order = Window.partitionBy("key").orderBy(F.desc("gene_cluster_size"), "label")
    return sized.select(F.col("key").alias(key), F.col("node").alias("sample"), F.dense_rank().over(order).cast("long").alias("gene_cluster_id"), "gene_cluster_size")
