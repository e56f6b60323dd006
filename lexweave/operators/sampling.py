"""Deterministic samples in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_order


def hash_sample(rows: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """The first ``size`` rows in hash order."""
    return rows.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(size).drop("_h")


def capped_sample(rows: DataFrame, key: str, group: str, seed: str, size: int, cap: int, strict: bool = True) -> DataFrame:
    """The first ``size`` rows in hash order, at most ``cap`` of a group; fewer are an error if ``strict``."""
    w = Window.partitionBy(group).orderBy("_h", key)
    own = rows.withColumn("_h", hash_order(seed, key)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    out = own.orderBy("_h", key).limit(size).drop("_h", "_n")
    if strict and out.count() < size:
        raise ValueError("not enough rows for the sample")
    return out


def identity_sample(catalogue: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    return hash_sample(catalogue, key, seed + ":identity", size)


def random_screen_partition(rows: DataFrame, key: str, seed: str, random_n: int, screen_n: int) -> tuple[DataFrame, DataFrame]:
    """A random sample, its halves marked calibration and validation, and a disjoint screening sample."""
    random = hash_sample(rows, key, seed + ":random", random_n)
    screen = hash_sample(rows.join(random.select(key), key, "left_anti"), key, seed + ":screen", screen_n)
    w = Window.orderBy(hash_order(seed + ":partition", key), key)  # over the sample, whose size is a parameter
    halves = random.withColumn("_n", F.row_number().over(w)).withColumn(
        "partition", F.when(F.col("_n") <= random_n // 2, "calibration").otherwise("validation")
    ).drop("_n")
    return halves, screen


def quota_selection(rows: DataFrame, key: str, seed: str, rules: list[tuple[str, int, Column, Column]]) -> DataFrame:
    """Disjoint picks by ordered rules (label, count, eligible, priority); short rules are filled in hash order as ``label_fallback``.

    ``rows`` is a screening sample of bounded size, ranked once for each rule.
    """
    left, out = rows, None
    for label, count, eligible, priority in rules:
        order = F.struct(priority.alias("p"), hash_order(f"{seed}:challenge:{label}", key).alias("h"), F.col(key).alias("k"))
        first = left.filter(eligible).orderBy(order).limit(count).withColumn("selection_reason", F.lit(label))
        rest = left.join(first.select(key), key, "left_anti")
        missing = count - first.count()
        picked = first
        if missing:
            more = rest.orderBy(hash_order(f"{seed}:fallback:{label}", key), key).limit(missing).withColumn("selection_reason", F.lit(label + "_fallback"))
            picked = first.unionByName(more)
        out = picked if out is None else out.unionByName(picked)
        left = left.join(picked.select(key), key, "left_anti")
    return out


def review_order(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows with ``position`` in hash order; of a sample of bounded size."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(hash_order(seed + ":review_order", key), key)).cast("long"))
