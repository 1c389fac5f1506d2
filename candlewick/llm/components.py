"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import cut


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b); comp is the component's smallest node.

    Each round hooks every remaining component to its smallest neighbour,
    shortens the resulting chains by pointer jumping and contracts the edges, so
    the edge table shrinks from round to round. Minima are pre-aggregated before
    they are shuffled; nothing is gathered by component. Null ends are ignored. ``cut`` materialises a frame.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        up = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")))
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.toDF("node", "comp")
        else:
            labels = labels.join(up.toDF("comp", "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        labels = cut(labels)
        ends = edges.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b").where("ua <> ub")
        edges = cut(ends.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, comp {kind}")
    return labels
