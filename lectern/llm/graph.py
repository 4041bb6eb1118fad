"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.spark import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of every end of an edge ``a, b`` (longs).

    Each round points every vertex at the neighbour with the least hash, if
    that is less than its own, follows pointers twice, and contracts the edges
    to what they point at.  A hash order leaves no long monotone chains, so
    rounds grow with the logarithm of the vertices; each round is a few
    shuffles of what is left of the edges.  Self-loops and repeats are
    harmless, rows with nulls are passed over, and no edges give no rows.
    """
    left = settle(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), light=True)
    labels = settle(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("label", F.col("id")), light=True)
    open_ = left.filter("a <> b")
    while not open_.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        near = open_.union(open_.select("b", "a")).groupBy("a").agg(F.min(order("b")).alias("m"))
        first = settle(near.select(F.col("a").alias("v"), F.when(F.col("m") < order("a"), F.col("m.v")).otherwise(F.col("a")).alias("to")), light=True)
        jump = first.select(F.col("v").alias("to"), F.col("to").alias("further"))
        point = settle(first.join(jump, "to").select("v", F.col("further").alias("to")), light=True)
        moved = settle(labels.join(point, labels.label == point.v, "left").select("id", F.coalesce("to", "label").alias("label")), light=True)
        for end in ("a", "b"):
            open_ = open_.join(point.select(F.col("v").alias(end), F.col("to").alias("new")), end).drop(end).withColumnRenamed("new", end)
        rest = settle(open_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), light=True)
        discard(first, point, labels, left)
        labels, left, open_ = moved, rest, rest
    least = settle(labels.groupBy("label").agg(F.min("id").alias("component")), light=True)
    discard(left)
    return labels.join(least, "label").select("id", "component")
