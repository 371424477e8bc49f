"""Hand-computed cases of the operators."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.functions import coords, stats
from locusframe.functions import genotype as g
from locusframe.operators import coverage, freqs, fws, harmonize, ibd, ld, qc, selection, variants, wsaf
from locusframe.operators import intervals as iv

CALL = "struct<sample:string,gt:array<int>,ad:array<int>,ads:int,pl:array<int>>"


def records(spark, rows):
    """(pos0, ref, alts, [(gt, ad), ...]) as nested records on chr1."""
    data = [("chr1", p, ref, alts, ["PASS"], [(f"s{i}", gt, ad, None, None) for i, (gt, ad) in enumerate(cells)]) for p, ref, alts, cells in rows]
    return spark.createDataFrame(data, f"chrom string, pos0 long, ref string, alts array<string>, filters array<string>, calls array<{CALL}>")


def spans(df):
    return sorted((r["chrom"], r["start"], r["end"]) for r in df.collect())


def test_normalise_chr(spark):
    names = ["Pf3D7_07_v3", "chr07", "14", "3", "chr00", "PvP01_02_v1", "Pf_M76"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select(coords.normalise_chr(F.col("c")).alias("n"))
    assert [r["n"] for r in df.collect()] == ["7", "7", "14", "3", "0", "2", "M76"]


def test_labels_split_at_last_colon(spark):
    chrom, pos = coords.parse_label(F.col("x"))
    df = spark.createDataFrame([("chr1:9",), ("a:b:12",), ("odd",)], "x string").select(chrom.alias("c"), pos.alias("p"))
    assert [tuple(r) for r in df.collect()] == [("chr1", 9), ("a:b", 12), ("unknown", -1)]


def test_stamp_is_enforced():
    coords.check_stamp("#snp_coord_system=0-based\n")
    with pytest.raises(coords.CoordinateError):
        coords.check_stamp("snp_id\taf")
    with pytest.raises(ValueError):
        coords.get_reference("none")


def test_interval_merge_and_subtract(spark):
    a = spark.createDataFrame([("c", 0, 600), ("c", 400, 1000), ("c", 1000, 1100), ("c", 5, 5), ("d", 1, 2)], "chrom string, start long, end long")
    assert spans(iv.merge_intervals(a)) == [("c", 0, 1100), ("d", 1, 2)]
    b = spark.createDataFrame([("c", 100, 200), ("c", 1050, 2000)], "chrom string, start long, end long")
    assert spans(iv.subtract_intervals(a, b)) == [("c", 0, 100), ("c", 200, 1050), ("d", 1, 2)]


def test_interval_join_is_exact_across_bins(spark):
    import random

    random.seed(3)
    one = [("c", s, s + random.randint(0, 90), i) for i, s in enumerate(random.randint(0, 500) for _ in range(80))]
    two = [("c", s, s + random.randint(0, 90), i) for i, s in enumerate(random.randint(0, 500) for _ in range(60))]
    left = spark.createDataFrame(one, "chrom string, start long, end long, a int")
    right = spark.createDataFrame(two, "rc string, rs long, re long, b int")
    on = {"right_on": ("rc", "rs", "re"), "width": 32}
    want = {(a[3], b[3]) for a in one for b in two if a[1] < b[2] and a[2] > b[1] and a[2] > a[1] and b[2] > b[1]}
    got = [(r["a"], r["b"]) for r in iv.interval_join(left, right, **on).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["a"] for r in iv.interval_join(left, right, "left_semi", **on).collect()} == {a for a, _ in want}
    anti = [r["a"] for r in iv.interval_join(left, right, "left_anti", **on).collect()]
    assert sorted(anti) == sorted({a[3] for a in one} - {a for a, _ in want})


def test_region_filter_and_whitelist(spark):
    rows = spark.createDataFrame([("chr1", p - 1, "A") for p in (150, 550, 950)], "chrom string, pos0 long, ref string")
    bed = spark.createDataFrame([("chr1", 100, 200), ("chr1", 900, 1000), ("chr1", 120, 180)], "chrom string, start long, end long")
    keep = spark.createDataFrame([("chr1", 949, 950)], "chrom string, start long, end long")
    pos = lambda df: sorted(r["pos0"] + 1 for r in df.collect())
    assert pos(iv.region_filter(rows, bed)) == [150, 950]
    assert pos(iv.region_filter(rows, bed, exclude=True)) == [550]
    saved = iv.region_filter(rows, bed, exclude=True, keep=keep)
    assert pos(saved) == [550, 950] and saved.where("rescued").count() == 1


def test_annotate(spark):
    region = spark.createDataFrame([("c", 100, 400), ("c", 2000, 2100)], "chrom string, start long, end long")
    genes = spark.createDataFrame([("geneB", "c", 380, 900), ("geneA", "c", 0, 150), ("far", "c", 400, 500)], "name string, chr string, start long, end long")
    assert [r["genes"] for r in iv.annotate(region, genes).orderBy("start").collect()] == ["geneA,geneB", ""]


@pytest.mark.parametrize(("ad", "want"), [([0, 0], [None, None]), ([10, 0], [0, 0]), ([0, 10], [1, 1]), ([9, 1], [0, 0]), ([5, 5], [0, 1]), ([10, 3], [0, 1]), ([0, 5, 5], [1, 2])])
def test_call_genotype(spark, ad, want):
    df = spark.createDataFrame([(ad,)], "ad array<int>")
    assert df.select(g.call_genotype(F.col("ad")).alias("g")).first()["g"] == want


def test_clean_ad(spark):
    df = spark.createDataFrame([([10, 1],), ([5, 5],), ([1, 20],)], "ad array<int>")
    assert [r["c"] for r in df.select(g.clean_ad(F.col("ad")).alias("c")).collect()] == [[10, 0], [5, 5], [0, 20]]
    assert df.select(g.clean_ad(F.col("ad"), protect_ref=True).alias("c")).collect()[2]["c"] == [1, 20]


def test_ad_regenotype(spark):
    df = records(spark, [(9, "A", ["T"], [([0, 0], [29, 1]), ([0, 1], [15, 15]), ([1, 1], [0, 40])]), (19, "A", ["T"], [([0, 1], [9, 1]), ([0, 0], None), ([0, 0], [5, 5])])])
    out = {r["pos0"]: r["calls"] for r in variants.ad_regenotype(df).collect()}
    assert [c["gt"] for c in out[9]] == [[0, 0], [0, 1], [1, 1]] and [c["ads"] for c in out[9]] == [29, 30, 40]
    assert [c["gt"] for c in out[19]] == [[0, 1], [0, 0], [0, 0]]  # one sample without AD: nothing changes


def test_allele_freqs_by_hand(spark):
    rows = [("a", "s1", "x", [0, 0], [9, 0], ["T"]), ("a", "s2", "x", [0, 1], [5, 5], ["T"]), ("a", "s3", "y", [1, 1], [0, 9], ["T"]), ("b", "s1", "x", [0, 1], None, ["T", "G"]), ("b", "s2", "x", [1, 2], None, ["T", "G"]), ("b", "s3", "y", [None, None], None, ["T", "G"])]
    calls = spark.createDataFrame(rows, "site string, sample string, grp string, gt array<int>, ad array<int>, alts array<string>")
    out = {r["site"]: r for r in freqs.allele_freqs(calls).collect()}
    assert (out["a"]["af"], out["a"]["ac"], out["a"]["an"]) == (0.5, 3, 6) and (out["b"]["af"], out["b"]["ac"], out["b"]["an"]) == (0.75, 3, 4)
    group = {(r["site"], r["grp"]): r for r in freqs.allele_freqs(calls, group="grp").collect()}
    assert group["b", "y"]["af"] is None and group["b", "y"]["an"] == 0


def test_allele_freqs_of_many_groups(spark):
    calls = spark.range(100_500).select(F.lit("a").alias("site"), F.lit("s").alias("sample"), F.col("id").alias("grp"), F.array(F.lit(0), F.lit(1)).alias("gt"), F.array(F.lit(3), F.lit(3)).alias("ad"), F.array(F.lit("T")).alias("alts"))
    out = freqs.allele_freqs(calls, group="grp")
    assert out.where("an = 2 AND af = 0.5").count() == out.select("grp").distinct().count() == 100_500


def test_weighted_freqs(spark):
    rows = [("a", f"s{i}", gt, ad, ["T"]) for i, (gt, ad) in enumerate([([1, 1], [5, 95]), ([1, 1], [95, 5]), ([0, 1], [50, 50]), ([0, 0], [100, 0])])]
    r = freqs.allele_freqs(spark.createDataFrame(rows, "site string, sample string, gt array<int>, ad array<int>, alts array<string>")).first()
    assert (r["af"], r["prevalence"]) == (0.625, 0.75) and r["af_weighted"] == pytest.approx(0.375)


def test_fws_of_clonal_and_of_one_bin(spark):
    calls = spark.createDataFrame([(s, f"p{i}", *((20, 0) if i == 0 else (10, 10))) for s in range(4) for i in range(2)], "site int, sample string, ref_ad int, alt_ad int")
    for estimator in ("regression", "ratio"):
        out = {r["sample"]: r["fws"] for r in fws.fws(calls, estimator).collect()}
        assert out["p0"] == pytest.approx(1.0) and out["p1"] == pytest.approx(1 - 0.5 / 0.375)


def test_wsaf_thresholds(spark):
    def profile(n_sites, frac, n_het, depth=100):
        second = int(depth * frac)
        rows = [(i, "s", [depth - second, second] if i < n_het else [depth, 0]) for i in range(n_sites)]
        return wsaf.profile(wsaf.site_fractions(spark.createDataFrame(rows, "site int, sample string, ad array<int>"))).first()

    assert profile(1000, 0.15, 100)["min_freq_needed"] == 0.16 and profile(1000, 0.15, 100)["class"] == "dominant_clone"
    assert profile(1000, 0.49, 500)["min_freq_needed"] is None and profile(1000, 0.49, 500)["class"] == "mixed"
    assert profile(200, 0.15, 0)["class"] == "undetermined" and profile(1000, 0.15, 5)["class"] == "monoclonal"


def test_block_filter_and_cells(spark):
    blocks = spark.createDataFrame([("a", "b", "c", 0, n, 0, k) for n, k in ((20000, 30), (14999, 30), (20000, 14), (15000, 15))], "sample1 string, sample2 string, chr string, start long, end long, different int, Nsnp long")
    assert sorted(r["end"] for r in ibd.filter_blocks(blocks).collect()) == [15000, 20000]
    panel = spark.createDataFrame([("c", p, i) for i, p in enumerate((99, 199, 299, 399))], "chrom string, pos0 long, snp_ix long")
    more = spark.createDataFrame([("b", "a", "c", 150, 351, 0, 2), ("a", "b", "c", 150, 251, 0, 1), ("b", "x", "c", 0, 500, 1, 4)], blocks.schema)
    cells = ibd.ibd_cells(more, panel, min_snp=0, min_kb=0)
    assert sorted((r["sample1"], r["sample2"], r["snp_ix"]) for r in cells.collect()) == [("a", "b", 1), ("a", "b", 2)]
    assert {(r["sample1"], r["sample2"]): r["n_ibd_snps"] for r in ibd.per_pair(cells, ibd.pair_index(more), 4).collect()} == {("a", "b"): 2, ("b", "x"): 0}


def test_gene_pairs_and_clusters(spark):
    blocks = spark.createDataFrame([("a", "b", "1", s, e, 0, 50) for s, e in ((500, 2500), (1500, 2500), (500, 1250), (0, 900))], "sample1 string, sample2 string, chr string, start long, end long, different int, Nsnp long")
    genes = spark.createDataFrame([("g", "id", "1", 1000, 2000)], "name string, gene_id string, chr string, start long, end long")
    out = ibd.gene_pairs(blocks, genes, within=200, min_snp=0, min_kb=0).orderBy("block_start", "block_end").collect()
    assert [(r["coverage"], r["percent_covered"], r["covered_bp"], r["covered_start"]) for r in out] == [("partial", 0.0, 0, None), ("partial", 25.0, 250, 1000), ("complete", 100.0, 1000, 1000), ("partial", 50.0, 500, 1500)]
    edges = spark.createDataFrame([("g", a, b) for a, b in ("ab", "bc", "de", "fg")], "gene_id string, sample1 string, sample2 string")
    got = {r["sample"]: (r["gene_cluster_id"], r["gene_cluster_size"]) for r in ibd.clusters(edges).collect()}
    assert got == {"a": (1, 3), "b": (1, 3), "c": (1, 3), "d": (2, 2), "e": (2, 2), "f": (3, 2), "g": (3, 2)}


def test_clusters_of_a_long_chain(spark):
    edges = [(g, f"s{i:03}", f"s{i + 1:03}") for g in ("g", "h") for i in range(120) if (g, i) != ("h", 60)]
    got = {(r["gene_id"], r["sample"]): (r["gene_cluster_id"], r["gene_cluster_size"]) for r in ibd.clusters(spark.createDataFrame(edges + [("g", "t", "t")], "gene_id string, sample1 string, sample2 string")).collect()}
    want = {("g", f"s{i:03}"): (1, 121) for i in range(121)} | {("g", "t"): (2, 1)}
    assert got == want | {("h", f"s{i:03}"): (1, 61) if i <= 60 else (2, 60) for i in range(121)}


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, None]
    want, low = [], 1.0
    for k in range(10, 0, -1):
        low = min(low, p[k - 1] * 10 / k)
        want.insert(0, low)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = [r["q"] for r in stats.benjamini_hochberg(df, "p", "q").orderBy("i").collect()]
    assert got[:10] == pytest.approx(want) and got[10] is None


def test_invalid_frequencies_have_no_statistic(spark):
    df = spark.createDataFrame([(i, 3, af) for i, af in enumerate([None, 0.0, 1.0, -0.1, 0.5])], "snp_ix long, n_pairs_ibd long, af double")
    binned = selection.maf_bins(selection.raw_statistic(df, 10, 5), 2).orderBy("snp_ix").collect()
    assert [r["raw_stat"] is None for r in binned] == [True] * 4 + [False] and [r["bin_id"] for r in binned][:4] == [-1] * 4


def test_shifts_keep_totals(spark):
    cells = spark.createDataFrame([("a", "b", i) for i in (0, 1, 2, 7, 9)] + [("a", "c", i) for i in (8, 9)], "sample1 string, sample2 string, snp_ix long")
    shift = F.when(F.col("sample2") == "b", F.when(F.col("rep") == 0, 3).otherwise(0)).otherwise(F.when(F.col("rep") == 0, 5).otherwise(9))
    got = {(r["rep"], r["snp_ix"]): r["n_pairs_ibd"] for r in selection.shifted_counts(selection.runs(cells), shift, 2, 10).collect()}
    for rep, k1, k2 in ((0, 3, 5), (1, 0, 9)):
        want = [0] * 10
        for i in (0, 1, 2, 7, 9):
            want[(i + k1) % 10] += 1
        for i in (8, 9):
            want[(i + k2) % 10] += 1
        assert [got[rep, j] for j in range(10)] == want


def test_permutation_null_against_numpy(spark):
    rng = np.random.default_rng(3)
    n_snps, n_perm, names = 240, 6, [(f"a{i}", f"b{i}") for i in range(30)]
    on = rng.random((30, n_snps)) < 0.3
    cells = spark.createDataFrame([(*names[i], int(j)) for i, j in zip(*np.nonzero(on), strict=True)], "sample1 string, sample2 string, snp_ix long")
    af = (np.arange(n_snps) % 16 + 1) / 33
    counts = spark.createDataFrame([(j, int(on[:, j].sum()), float(af[j])) for j in range(n_snps)], "snp_ix long, n_pairs_ibd long, af double")
    scored = selection.scan(counts, 30, n_snps, n_bins=4)
    null = selection.permutation_null(scored, selection.runs(cells), 30, n_snps, n_perm)
    out, info = selection.assemble(scored, null, pool="bin", group="x")
    pairs = spark.createDataFrame(names, "sample1 string, sample2 string").crossJoin(spark.range(n_perm).withColumnRenamed("id", "rep")).withColumn("k", selection.drawn_shift(n_snps)).collect()
    shift = {(r["rep"], r["sample1"]): r["k"] for r in pairs}
    rows = {r["snp_ix"]: r for r in out.collect()}
    bins = np.array([rows[j]["bin_id"] for j in range(n_snps)])

    def z(mat):
        raw = (mat.sum(0) - mat.sum() / n_snps) / np.sqrt(30 * af * (1 - af))
        return np.array([(raw[j] - raw[bins == bins[j]].mean()) / raw[bins == bins[j]].std(ddof=1) for j in range(n_snps)])

    seen = z(on)
    drawn = np.array([z(np.stack([np.roll(on[i], shift[r, names[i][0]]) for i in range(30)])) for r in range(n_perm)])
    for j in range(n_snps):
        r, mine = rows[j], drawn[:, bins == bins[j]]
        assert r["z_score"] == pytest.approx(seen[j]) and r["group"] == "x"
        assert r["p_pointwise"] == pytest.approx((1 + (drawn[:, j] >= seen[j] - 1e-9).sum()) / (1 + n_perm))
        assert r["p_empirical"] == pytest.approx((1 + (drawn >= seen[j] - 1e-9).sum()) / (1 + drawn.size))
        assert r["p_empirical_binned"] == pytest.approx((1 + (mine >= seen[j] - 1e-9).sum()) / (1 + mine.size))
    best = [-math.log10(math.erfc(t / math.sqrt(2)) / 2) for t in drawn.max(1)]
    one = info.collect()[0]
    assert one["neg_log10_p_perm_threshold"] == pytest.approx(np.quantile(best, 0.95)) and one["n_perm"] == n_perm and one["p_empirical_resolution"] == pytest.approx(1 / (1 + drawn.size))
    assert one["empirical_pool"] == "bin" and one["q_empirical_floor"] == pytest.approx(min(n_snps / (1 + drawn[:, bins == b].size) for b in set(bins)))


def test_group_frequencies_fall_back_and_refuse_gaps(spark):
    panel = spark.createDataFrame([("a",), ("b",)], "snp_id string")
    overall = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "snp_id string, af double")
    groups = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 0.6), ("h", "a", 0.7)], "group string, snp_id string, af double")
    pick = lambda g: {r["snp_id"]: r["af"] for r in selection.group_frequencies(panel, groups, overall, g).collect()}
    assert pick("g") == {"a": 0.5, "b": 0.6} and pick("other") == {"a": 0.1, "b": 0.2}
    with pytest.raises(ValueError, match="1 SNPs"):
        pick("h")


def test_singletons(spark):
    rows = ["1000", "0100", "1100", "1111", "0000", "1000"]
    cells = spark.createDataFrame([(i, s, k, row[k] == "1", False, 50) for i, row in enumerate(rows) for k, s in enumerate("abcd")], "site int, sample string, sample_ix int, alt boolean, missing boolean, depth int")
    out = {r["sample"]: r for r in qc.singleton_counts(cells).collect()}
    assert [out[s]["n_singleton"] for s in "abcd"] == [2, 1, 0, 0] and out["a"]["singleton_rate"] == pytest.approx(2000 / 6) and out["a"]["top_partner"] == "b"


def test_strand_verdicts(spark):
    cells = spark.createDataFrame([(1, 1500, 2, 1200, 1000), (2, 50, 50, 50, 50)], "site int, ref_fwd int, alt_fwd int, ref_rev int, alt_rev int")
    out = {r["site"]: r for r in qc.strand_bias(cells).collect()}
    assert out[1]["drop"] and not out[2]["drop"] and out[2]["sb_phred"] == pytest.approx(0, abs=1e-6) and out[2]["ratio"] == 1.0
    few = spark.createDataFrame([(3, 5, 0, 5, 45)], cells.schema)
    assert not qc.strand_bias(few, sb_hard=1e9).first()["drop"] and qc.strand_bias(few, sb_hard=1e9, min_minor_depth=4).first()["drop"]
    assert stats.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)


def test_ld_pairs(spark):
    rows = [("g", "c", 1000 * i, f"s{k}", (k % 3)) for i in range(12) for k in range(6)]
    packed = ld.site_maf(ld.pack(spark.createDataFrame(rows, "grp string, chrom string, pos0 long, sample string, d int")))
    found = ld.pairs(packed).collect()
    assert len(found) == 66 and all(r["r2"] == pytest.approx(1) for r in found)
    table = spark.createDataFrame([("a", 1000.0, 0.4), ("a", 2000.0, 0.3), ("a", 3000.0, 0.1), ("b", 1000.0, 0.2), ("b", 2000.0, 0.2)], "grp string, bin_mid double, mean_r2 double")
    assert {r["grp"]: r["half_decay_bp"] for r in ld.half_decay(table).collect()} == {"a": pytest.approx(2500), "b": None}


def test_depth(spark):
    reads = spark.createDataFrame([("s", "c", a, a + 100) for a in range(0, 1000, 100) for _ in range(10)], "sample string, chrom string, start long, end long")
    lengths = spark.createDataFrame([("c", 2000)], "chrom string, length long")
    runs = coverage.depth_runs(reads, lengths)
    row = coverage.depth_summary(coverage.depth_histogram(runs)).where("chrom = 'c'").first()
    assert (row["mean"], row["pct_zero"], row["median"]) == (5.0, 50.0, 0.0)
    assert [r["mean_depth"] for r in coverage.depth_windows(runs, 500, lengths).orderBy("start").collect()] == [10.0, 10.0, 0.0, 0.0]
    bed = spark.createDataFrame([("c", 0, 600), ("c", 400, 1000)], "chrom string, start long, end long")
    assert coverage.depth_summary(coverage.depth_histogram(runs, bed)).where("chrom = 'c'").first()["mean"] == 10.0


def test_dropouts(spark):
    rows = [(s, "c", 100 * i, 100 * i + 100, float(d)) for s in "ab" for i, d in enumerate((0, 0, 50, 0))]
    windows = spark.createDataFrame(rows, "sample string, chrom string, start long, end long, mean_depth double")
    assert spans(coverage.dropout_regions(windows)) == [("c", 0, 200), ("c", 300, 400)]
    assert spans(coverage.dropout_regions(windows, merge_gap=100)) == [("c", 0, 400)]
    assert spans(coverage.dropout_regions(windows, min_length=150)) == [("c", 0, 200)]
    assert coverage.dropout_regions(windows.limit(0)).count() == 0


def test_biallelic_and_maf(spark):
    both = [([0, 1], [5, 5, 0]), ([1, 2], [0, 5, 5])]
    df = records(spark, [(99, "A", ["T"], [([0, 1], [5, 5])]), (199, "A", ["T", "G"], [([0, 1], [5, 5, 0])]), (299, "A", ["T", "G"], both), (399, "AT", ["A"], [([0, 1], [5, 5])])])
    assert sorted(r["pos0"] for r in variants.biallelic_snps(df).collect()) == [99, 199]
    assert sorted(r["pos0"] for r in variants.biallelic_snps(df, trim=False).collect()) == [99]
    af = records(spark, [(1, "A", ["T"], [([0, 1], None)]), (2, "A", ["T"], [([0, 0], None), ([0, 1], None)]), (3, "A", ["T"], [([1, 1], None), ([0, 1], None)])])
    assert [r["pos0"] for r in variants.maf_filter(af, 0.3).collect()] == [1]
    assert sorted(r["pos0"] for r in variants.maf_filter(af, 0.3, 0.8).collect()) == [1, 3]


def test_harmonize_union_and_duplicates(spark):
    schema = f"cohort string, rec_ix int, chrom string, pos0 long, ref string, alts array<string>, calls array<{CALL}>"
    call = lambda ad: [("s", [0, 1], ad, None, None)]
    df = spark.createDataFrame([("a", 0, "c", 1, "A", ["T"], call([10, 10])), ("b", 0, "c", 1, "A", ["G"], call([10, 10])), ("a", 1, "c", 9, "A", ["T"], call([5, 5])), ("a", 2, "c", 9, "A", ["."], call([5, 5])), ("a", 3, "c", 20, "A", ["T"], call([50, 1]))], schema)
    union = {r["pos0"]: r["union_alts"] for r in harmonize.allele_union(df).collect()}
    assert union == {1: ["G", "T"], 9: ["T"], 20: []}
    out = {(r["cohort"], r["pos0"]): r for r in harmonize.rewrite(df, harmonize.allele_union(df)).collect()}
    assert set(out) == {("a", 1), ("b", 1), ("a", 9)}
    assert out["a", 1]["calls"][0]["ad"] == [10, 0, 10] and out["a", 1]["calls"][0]["gt"] == [0, 2] and out["b", 1]["calls"][0]["gt"] == [0, 1]


def test_panel_numbers_have_no_gaps(spark):
    rows = [(f"{c}:{p}", c, p) for c, n in (("b", 5), ("a", 3), ("c", 1)) for p in range(10 * n, 0, -10)]
    out = ibd.number_panel(spark.createDataFrame(rows, "snp_id string, chrom string, pos0 long").repartition(5)).collect()
    assert [r["snp_id"] for r in sorted(out, key=lambda r: r["snp_ix"])] == [r[0] for r in sorted(rows, key=lambda r: r[1:])] and {r["snp_ix"] for r in out} == set(range(9))


def test_gene_sharing_does_not_grow_with_blocks(spark):
    blocks = [("a", "b", "1", s, s + 300, 0, 50) for s in range(0, 3000, 10)] + [("b", "a", "chr1", 5000, 5100, 0, 50), ("c", "d", "1", 5101, 5200, 0, 50)]
    blocks = spark.createDataFrame(blocks, "sample1 string, sample2 string, chr string, start long, end long, different int, Nsnp long")
    genes = spark.createDataFrame([("g", "i", "1", 1000, 2000), ("h", "j", "1", 4900, 5000), ("k", "l", "1", 5100, 5101)], "name string, gene_id string, chr string, start long, end long")
    shared = lambda within: sorted((r["gene_id"], r["sample1"], r["sample2"]) for r in ibd.gene_sharers(blocks, genes, within, 0, 0).collect())
    assert shared(0) == [("i", "a", "b")]
    assert shared(1) == [("i", "a", "b"), ("j", "a", "b"), ("l", "a", "b"), ("l", "c", "d")]


def test_clusters_hand_on_samples_instead_of_pairs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(k), f"s{a}", f"s{b}") for k, a, b in zip(rng.integers(0, 9, 4000), rng.integers(0, 40, 4000) % 37, rng.integers(0, 40, 4000) % 37) if a % 3 == b % 3]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges)], ["key", "node", "label"])
    short = [tuple(r.values()) for b in ibd._forest(False)(iter([batch, batch])) for r in b.to_pylist()]
    assert len(short) == len({(k, x) for k, *ends in edges for x in ends}) < len(edges) / 2
    want = {}
    for k, x, label in short:
        want.setdefault((k, label), set()).add(x)
    for k, a, b in edges:
        assert sum(k == key and a in found and b in found for (key, _), found in want.items()) == 1
    df = spark.createDataFrame(edges, "gene_id long, sample1 string, sample2 string").repartition(7)
    got = {}
    for r in ibd.clusters(df).collect():
        got.setdefault((r["gene_id"], r["gene_cluster_id"], r["gene_cluster_size"]), set()).add(r["sample"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(n == len(found) for (_, _, n), found in got.items())
