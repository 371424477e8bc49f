"""Approximate nearest neighbours by cross-polytope hashing with exact reranking.

A pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) sends a unit
vector near one signed axis; that axis is its bucket. Several tables hold every vector, queries probe
the nearest axes of each, and what they find is ranked by exact distances of the original vectors.

Tables and probes are parameters and do not change with the input. A bucket is worked on in blocks of
GROUP vectors by QUERIES queries, so one bucket with a third of all rows is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import map_batches, materialise, scratch
from locusframe.shipping import ship

TABLES = 10
PROBES = 16
#: Vectors and query vectors of one block of a bucket, about.
GROUP = 4096
QUERIES = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, by butterflies; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of unit vectors; widths are filled up with zeros to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng([table, 0, width])
    for _ in range(3):
        out = hadamard(out * rng.choice((-1.0, 1.0), width))
    return out


def axes(x: np.ndarray, table: int, probes: int | None) -> np.ndarray:
    """The signed axes nearest each row, nearest first: as many as probes, all without."""
    y = rotate(x, table)
    near = np.concatenate([y, -y], 1)
    if probes == 1:
        return near.argmax(1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def usable(vector: Column) -> Column:
    """Not null, not zero, no null, NaN or infinite component."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # norms of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(rows: DataFrame, tables: int, probes: int | None) -> DataFrame:
    """rows (dim, vector and others) with codes: the buckets of each row, table by table."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(0))
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                for lo in range(0, mine.num_rows, 512):
                    piece = mine.slice(lo, 512)
                    unit = _unit(_matrix(piece.column(1)))
                    codes = np.concatenate([axes(unit, t, probes) + (t << 32) for t in range(tables)], 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel().astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*names, "codes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", codes array<long>"
    return map_batches(rows, run, schema)


def _nearest(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """Number of the query, id and exact distance of the k nearest ids of each query, ties to the smaller id.

    A matrix product finds who can be among them, distances are then taken from the differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = (vectors**2).sum(1), (queries**2).sum(1)
        near = own[:, None] + other - 2 * (vectors @ queries.T)
        slack = 1e-9 * (own.max() + other)
        limit = np.partition(near, k - 1, axis=0)[k - 1] + slack if len(vectors) > k else np.full(len(queries), np.inf)
        open_ = ~(near > limit)  # what is not a number stays
        for j, query in enumerate(queries):
            at = np.flatnonzero(open_[:, j])
            d = np.sqrt(((vectors[at] - query) ** 2).sum(1))
            for score, i in sorted((float(x), v) for x, r in zip(d, at, strict=True) for v in ids[r])[:k]:
                yield j, i, score


def _search(index: DataFrame, queries: DataFrame, k: int, tables: int, probes: int | None) -> DataFrame:
    """q1, q2, vec_id, score: for each query vector and block of a bucket the k + 1 nearest ids of the block.

    index: dim, vector, ids, v1, v2; queries: dim, vector, v1, v2."""
    held = materialise(_coded(index.select("dim", "vector", "ids", "v1"), tables, 1), "held")
    asked = materialise(_coded(queries.select("dim", "vector", "v1", "v2"), tables, probes), "asked")
    key = ["dim", "bucket"]
    count = lambda df, size, name: df.select("dim", F.explode("codes").alias("bucket")).groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = materialise(count(held, GROUP, "parts").join(count(asked, QUERIES, "sides"), key), "blocks")
    place = lambda n: F.pmod(F.xxhash64("v1"), F.col(n)).cast("int")
    both = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.select("dim", F.explode("codes").alias("bucket"), "vector", "ids", "v1").join(blocks, key).withColumn("part", place("parts")).withColumn("side", both("sides")).select(*key, "part", "side", "vector", "ids")
    right = asked.select("dim", F.explode("codes").alias("bucket"), "vector", "v1", "v2").join(blocks, key).withColumn("side", place("sides")).withColumn("part", both("parts")).select(*key, "part", "side", "vector", "v1", "v2")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        q1, q2, ids, scores = [], [], [], []
        if left.num_rows and right.num_rows:
            r1, r2 = right["v1"].to_pylist(), right["v2"].to_pylist()
            vectors, owners = _matrix(left["vector"]), left["ids"].to_pylist()
            points = _matrix(right["vector"])
            for lo in range(0, len(points), 256):
                for j, vec, score in _nearest(vectors, owners, points[lo : lo + 256], k + 1):
                    q1.append(r1[lo + j])
                    q2.append(r2[lo + j])
                    ids.append(vec)
                    scores.append(score)
        return pa.table({"q1": pa.array(q1, pa.int64()), "q2": pa.array(q2, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    ship(index.sparkSession)
    block = [*key, "part", "side"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(nearest, "q1 long, q2 long, vec_id long, score double")


def neighbours(vectors: DataFrame, wanted: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row that is wanted, ties to the smaller vec_id.

    vectors: vec_id, embedding. Rows with a null id and vectors that are null, zero or hold null or
    non-finite components take no part; vectors of another length than the query's are no
    candidates. Repeated rows count once, and a query never finds its own id; an id with several
    vectors is a query with each of them and is ranked by the nearest. Equal vectors are indexed once,
    with their k + 1 smallest ids, which is all that a result can show of them, and searched once. A
    query vector that found no more than k ids is searched again over all buckets of one table, so it
    gets all candidates there are. An empty table has an empty result, which is a table in the shared folder.
    """
    with scratch(vectors.sparkSession) as block:
        rows = (
            vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), wanted.alias("asks"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
            .withColumn("dim", F.size("vector"))
            .withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))  # -0.0 equals 0.0
            .withColumn("v1", F.xxhash64(F.lit(1), "vector"))
            .withColumn("v2", F.xxhash64(F.lit(2), "vector"))
        )
        order = Window.partitionBy("v1", "v2").orderBy("vec_id")
        kept = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
        index = materialise(kept.groupBy("v1", "v2").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
        asking = rows.where("asks")
        queries = materialise(asking.groupBy("v1", "v2").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector")), "queries")
        found = materialise(_search(index, queries, k, tables, probes), "found")
        enough = found.groupBy("q1", "q2").agg(F.countDistinct("vec_id").alias("m")).where(F.col("m") > k).select(F.col("q1").alias("v1"), F.col("q2").alias("v2"))
        short = materialise(queries.join(enough, ["v1", "v2"], "left_anti"), "short")
        if not short.isEmpty():
            found = found.unionByName(_search(index, short, k, 1, None))
        by_vector = Window.partitionBy("q1", "q2").orderBy("score", "vec_id")
        nearest = found.groupBy("q1", "q2", "vec_id").agg(F.min("score").alias("score")).withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
        own = asking.select(F.col("vec_id").alias("query_id"), F.col("v1").alias("q1"), F.col("v2").alias("q2")).distinct()
        best = own.join(nearest, ["q1", "q2"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return block.keep(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
