"""Connected components of links kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.tables import materialise, scratch


def components(links: DataFrame, *keys: str) -> DataFrame:
    """keys, node, label for every end of links (keys, a, b): label is the smallest node that can be reached within the keys.

    Each level hooks a node to its smallest neighbour if that is smaller, otherwise to the smallest that
    a neighbour would hook to. A node that hooks to nothing is then the choice of all its neighbours, so
    trees have two nodes at least. Trees are flattened by doubling and become the nodes of the next level,
    which has half as many at most, until no links are left: levels grow with the logarithm of the nodes,
    whatever the order of ids along a path. Tables of nodes and links stay in the shared folder; only
    whether something is left or has moved reaches the driver. Links may repeat, point either way or to
    themselves; a node with links to itself alone has no row.
    All tables but the result are deleted at the end.
    """
    with scratch(links.sparkSession) as block:
        both = links.select(*keys, "a", "b").union(links.select(*keys, "b", "a")).toDF(*keys, "a", "b")
        edges = materialise(both.where("a != b").distinct(), "links")
        levels = [edges.select(*keys, F.col("a").alias("node"), F.col("a").alias("label")).limit(0)]
        while edges.limit(1).count():
            low = materialise(edges.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("low")).select(*keys, "node", F.least("node", "low").alias("label")), "labels")
            far = edges.join(low.toDF(*keys, "b", "far"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("far").alias("far"))
            hook = F.when(F.col("label") < F.col("node"), F.col("label")).otherwise(F.least("label", "far"))
            labels, moved = materialise(low.join(far, [*keys, "node"]).select(*keys, "node", hook.alias("label")), "labels"), 1
            while moved:
                step = labels.join(labels.toDF(*keys, "label", "up"), [*keys, "label"])
                new = materialise(step.select(*keys, "node", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("moved")), "labels")
                labels, moved = new.select(*keys, "node", "label"), new.where("moved").limit(1).count()
            levels.append(labels)
            left = edges.join(labels.toDF(*keys, "a", "x"), [*keys, "a"]).join(labels.toDF(*keys, "b", "y"), [*keys, "b"])
            edges = materialise(left.where("x != y").select(*keys, F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        found = levels.pop()
        while len(levels) > 1:
            top = found.toDF(*keys, "label", "top")
            found = materialise(levels.pop().join(top, [*keys, "label"], "left").select(*keys, "node", F.coalesce("top", "label").alias("label")), "labels")
        return block.keep(found, "components")
