"""Connected components by label propagation with pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, materialize_at, partitions

#: A key with this many rows is never hot.
FEW_ROWS = 64


def hot_keys(left: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys that hold more than a quarter of an even partition's rows: fewer than four times the partitions."""
    most = max(FEW_ROWS, rows // (4 * partitions(left.sparkSession)))
    return left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` with the row of ``right`` for its key, which is unique there; ``rows``: those of ``left``.

    The rows of ``right`` for hot keys (:func:`hot_keys`, unless they are given)
    are broadcast and ``left``'s rows stay where they are; all others are
    shuffled as usual.
    """
    few = F.broadcast(hot if hot is not None else hot_keys(left, key, rows))  # bounded by four times the partitions
    cold = left.join(few, key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then
    the label of that label, so paths shorten by doubling.  Labels and nodes that
    hold a large share of the rows are not gathered in a task
    (:func:`spread_join`).  Every round is written to the shared folder, and the
    one before is deleted; only counters come to the driver.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both, _ = materialize_at(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    label, last = materialize_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), f"{name}-labels")
    n_edges, n_nodes = both.count(), label.count()
    if not n_nodes:
        return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
    hot = materialize(hot_keys(both, "v", n_edges), f"{name}-hot")
    while True:
        near = spread_join(
            both, label.select(F.col("u").alias("v"), "l"), "v", n_edges, hot=hot
        ).select("u", "l", F.lit(None).cast(label.schema["l"].dataType).alias("old"))
        own = label.select("u", "l", F.col("l").alias("old"))
        step, path = materialize_at(near.unionByName(own).groupBy("u").agg(F.min("l").alias("l"), F.min("old").alias("old")), f"{name}-step")
        after = spread_join(step, step.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", n_nodes, "left")
        label, done = materialize_at(after.select("u", F.least("l", F.coalesce("ll", "l")).alias("l"), "old"), f"{name}-labels")
        drop_scratch(spark, last, path)
        last = done
        if label.filter("l <> old").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
        label = label.select("u", "l")
