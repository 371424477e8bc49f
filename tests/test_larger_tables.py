"""Queries against their SQL on tables that the smallest driver tables have no case of."""

import itertools

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from locusframe.operators import ibd, intervals, wsaf
from locusframe.plans import registry


def check(spark, folder, name, **tables):
    """Write the tables, run query and SQL over them; their rows, which must be equal to the last digit."""
    duck = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), path := f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = sorted(map(repr, (tuple(r) for r in registry.queries()[name](spark, str(folder)).select(*columns).collect())))
    assert found == sorted(map(repr, want.fetchall()))
    return found


def line(part, supp, quantity, flag="N", order=0, status="F"):
    return {"l_orderkey": order, "l_partkey": part, "l_suppkey": supp, "l_quantity": float(quantity), "l_returnflag": flag, "l_linestatus": status}


def test_decay_takes_every_site(spark, tmp_path):
    rows = [line(14 * k, s, 40, "NR"[(k * (s + 5) // 7 + s) % 2]) for k in range(1, 3300) for s in (0, 3, 6, 9, 12)]
    for name in ("ld_decay", "ld_half_decay"):
        check(spark, tmp_path, name, lineitem=rows)


def test_fractions_on_a_half_round_like_the_sql(spark, tmp_path):
    """666 of 1280 is 0.5203125, but its product with 10^6 falls below the half."""
    found = check(spark, tmp_path, "wsaf_sites", lineitem=[line(2, 0, 614, "N"), line(2, 0, 666, "R")])
    assert len(found) == 1 and "0.520312" in found[0]


def test_mean_share_does_not_hang_on_the_order_of_samples(spark):
    """The shares add up to 2.875, in floating point to that or a little less."""
    shares = [(13, 35), (14, 28), (0, 11), (25, 23)]
    for order in itertools.permutations(shares):
        rows = [(1, f"s{i}", list(ad)) for i, ad in enumerate([*order, *[(20, 0)] * 12])]
        cells = spark.createDataFrame(rows, "site int, sample string, ad array<int>").coalesce(1)
        assert {r["plaf"] for r in wsaf.site_fractions(cells).collect()} == {0.1796875}


def test_gene_shares_on_a_half_round_like_the_sql(spark, tmp_path):
    """1562.5 millionths of a percent a base: genes of 64 kb have halves at every odd number of bases, of which a tenth or so rounded otherwise."""
    genes = [{"p_partkey": 14 * k, "p_brand": "b", "p_size": 64} for k in range(1, 400)]
    found = check(spark, tmp_path, "gene_pairs", part=genes, lineitem=[line(14 * k + 1, 2 * k, 20 + k % 30, order=14 * k) for k in range(1, 200)])
    assert len(found) > 100 and any("'partial'" in r for r in found)


def test_gene_pairs_of_a_block_come_in_order_of_genes(spark):
    """Files of them are smaller so; a plan that deals both sides must keep the order in which tasks send them."""
    genes = spark.createDataFrame([("g", k, "1", k * 7919 % 60_000, k * 7919 % 60_000 + 900 + k) for k in range(300)], "name string, gene_id long, chr string, start long, end long").coalesce(1)
    blocks = spark.createDataFrame([("a", "b", "1", k * 613 % 40_000, k * 613 % 40_000 + 20_000, 0, 50) for k in range(100)], "sample1 string, sample2 string, chr string, start long, end long, different int, Nsnp long").coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = [(r["block_start"], r["gene_start"]) for r in ibd.gene_pairs(blocks, genes, within=200).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == sum(b < g + 900 + k + 200 and b + 20_000 > g - 200 for b in (k * 613 % 40_000 for k in range(100)) for k, g in ((k, k * 7919 % 60_000) for k in range(300)))
    assert found == sorted(found)


def test_intervals_left_of_zero_and_on_borders_of_bins_meet_once(spark):
    spans = [(s, e) for s in range(-33, 34, 3) for e in range(s + 1, s + 40, 4)]
    left = spark.createDataFrame([("1", *x) for x in spans], "chrom string, start int, end int")
    right = spark.createDataFrame([("1", *x) for x in spans], "c string, s long, e long")
    found = [tuple(r) for r in intervals.interval_join(left, right, width=16, right_on=("c", "s", "e")).select("start", "end", "s", "e").collect()]
    assert sorted(found) == sorted((*x, *y) for x in spans for y in spans if x[0] < y[1] and y[0] < x[1])
