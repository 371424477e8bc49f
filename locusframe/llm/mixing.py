"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, each source gets a target, and the repetition rate target / source
size decides its documents: floor(rate) whole copies and one more with probability equal to the
fraction, drawn from a hash of seed and document id, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import WORD

SEED = "mix-1:"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets for (source, source_size), one row a source.

    Sources in code-point order, null last, get the weights in turn and share `share` times the
    sum of all sizes; a target stops at `cap` times its source and the excess goes to the others by
    weight until none is above. That fixed point is min(weight * level, cap * size) for one level,
    read off the sources in order of the level at which they fill up. The unpartitioned windows see
    one row a source, never documents. An empty input gives no rows; sources of size 0 get 0.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(n)) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("stop", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything))
    )
    return levels.select(
        "source", "source_size", F.when(F.col("stop").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("stop.level"))).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED, keep: Sequence[str] | None = None) -> DataFrame:
    """One row a document: row (all its columns, or those in keep, doc_id and source among them), size, source_size, target, copies, taken.

    Null or empty texts have size 0 and null sources are one source. Repeated rows draw alike and
    all stay. Extra columns, whatever their names, stay inside row. Sources are summed before they
    are dealt out, and the join back to documents is by source over one row a source, so a source
    with a third of the rows is broadcast or split by AQE, not gathered.
    """
    sized = docs.select(F.struct(*(keep or docs.columns)).alias("row"), word_count(F.col("text")).alias("size"))
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = (F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return (
        sized.join(wanted, F.col("row.source").eqNullSafe(wanted["source"]))
        .withColumn("rate", rate)
        .withColumn("draw", draw)
        .withColumn("copies", copies)
        .select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: every document `copies` times, with the columns it came with."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes
), weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT *, cap / weight AS ratio,
    ((SELECT sum(source_size) FROM sizes) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), stop AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1
), wanted AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM stop)) AS target FROM levels
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN wanted ON sized.source IS NOT DISTINCT FROM wanted.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
