"""Views that give the driver's tables the shape of genomic ones, in SQL that both engines read.

All expressions are integer arithmetic, so both engines agree exactly. Base tables stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("lineitem", "part", "events", "nation", "region")

#: name -> (views it builds on, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_ad": ((), """
        SELECT l_partkey AS site, concat('chr', CAST(l_partkey % 14 + 1 AS STRING)) AS chrom, l_partkey * 500 AS pos0,
          concat('s', CAST(l_suppkey % 24 AS STRING)) AS sample, concat('g', CAST(l_suppkey % 3 AS STRING)) AS grp,
          CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_alts,
          CAST(sum(CASE WHEN l_returnflag = 'N' OR (l_returnflag = 'A' AND l_partkey % 3 <> 0) THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS d0,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS d1,
          CAST(sum(CASE WHEN l_returnflag = 'A' AND l_partkey % 3 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS d2
        FROM {lineitem} GROUP BY l_partkey, l_suppkey % 24, l_suppkey % 3"""),
    "v_calls": ((), """
        SELECT l_partkey AS site, concat('chr', CAST(l_partkey % 14 + 1 AS STRING)) AS chrom, l_partkey * 500 AS pos0,
          concat('s', CAST(l_suppkey % 24 AS STRING)) AS sample, concat('g', CAST(l_suppkey % 3 AS STRING)) AS grp,
          CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS ref_ad,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS alt_ad
        FROM {lineitem} GROUP BY l_partkey, l_suppkey % 24, l_suppkey % 3"""),
    "v_info": ((), """
        SELECT p_partkey AS site, concat('chr', CAST(p_partkey % 14 + 1 AS STRING)) AS chrom, p_partkey * 500 AS pos0,
          CASE WHEN p_partkey % 5 = 4 THEN 'AT' ELSE 'A' END AS ref, CASE WHEN p_partkey % 7 = 6 THEN 'C' ELSE 'T' END AS alt,
          CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS qd, CASE WHEN p_partkey % 11 <> 0 THEN CAST(40 + p_partkey % 30 AS DOUBLE) END AS mq,
          CAST(p_partkey % 5 AS DOUBLE) AS sor, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 17 AS DOUBLE) - 10 END AS mqranksum,
          CASE WHEN p_partkey % 4 = 1 THEN CAST(p_partkey % 13 AS DOUBLE) - 8 END AS readposranksum, CAST(p_partkey % 90 AS DOUBLE) AS fs
        FROM {part}"""),
    "v_blocks": ((), """
        SELECT concat('s', CAST(l_suppkey % 24 AS STRING)) AS sample1, concat('s', CAST(l_partkey % 24 AS STRING)) AS sample2,
          concat('chr', CAST(l_orderkey % 14 + 1 AS STRING)) AS chr, (l_partkey * 613 + l_orderkey * 37) % 1000000 AS start,
          (l_partkey * 613 + l_orderkey * 37) % 1000000 + CAST(l_quantity AS BIGINT) * 1500 AS {q}end{q},
          CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS different, CAST(l_quantity AS BIGINT) AS Nsnp
        FROM {lineitem} WHERE l_suppkey % 24 <> l_partkey % 24"""),
    "v_panel": ((), "SELECT concat('chr', CAST(p_partkey % 14 + 1 AS STRING)) AS chrom, p_partkey * 500 AS pos0, p_partkey AS snp_ix FROM {part}"),
    "v_genes": ((), """
        SELECT p_brand AS name, p_partkey AS gene_id, concat('chr', CAST(p_partkey % 14 + 1 AS STRING)) AS chr, (p_partkey * 7919) % 9000000 AS start,
          (p_partkey * 7919) % 9000000 + p_size * 1000 AS {q}end{q}
        FROM {part}"""),
    "v_strand": ((), """
        SELECT l_partkey AS site, concat('chr', CAST(l_partkey % 14 + 1 AS STRING)) AS chrom, l_partkey * 500 AS pos0, concat('s', CAST(l_suppkey % 24 AS STRING)) AS sample,
          CAST(sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS ref_fwd,
          CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS alt_fwd,
          CAST(sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus <> 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS ref_rev,
          CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS alt_rev
        FROM {lineitem} GROUP BY l_partkey, l_suppkey % 24"""),
    "v_windows": ((), """
        SELECT concat('s', CAST(user_id % 12 AS STRING)) AS sample, event_type AS chrom, CAST(extract(day FROM ts) AS BIGINT) * 1000 AS start,
          CAST(extract(day FROM ts) AS BIGINT) * 1000 + 1000 AS {q}end{q}, round(avg(value), 6) AS mean_depth
        FROM {events} GROUP BY user_id % 12, event_type, extract(day FROM ts)"""),
    "v_meta": ((), "SELECT DISTINCT concat('s', CAST(l_suppkey % 24 AS STRING)) AS sample, concat('r', CAST(l_suppkey % 24 % 5 AS STRING)) AS region FROM {lineitem}"),
    "v_reads": ((), """
        SELECT concat('s', CAST(l_suppkey % 6 AS STRING)) AS sample, concat('chr', CAST(l_orderkey % 3 + 1 AS STRING)) AS chrom, (l_partkey * 97 + l_suppkey * 13) % 50000 AS start,
          (l_partkey * 97 + l_suppkey * 13) % 50000 + CAST(l_quantity AS BIGINT) AS {q}end{q}, l_linenumber * 10 AS mapq
        FROM {lineitem}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in VIEWS[name][1]}
    for t, df in tables.items():
        df.createOrReplaceTempView(f"_lf_{t}")
    return spark.sql(VIEWS[name][1].format(q="`", **{t: f"_lf_{t}" for t in tables}))


def ctes(*names: str) -> str:
    """WITH clause with these views for the other engine, open for more."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].format(q=chr(34), **{t: t for t in BASE})})" for n in names)
