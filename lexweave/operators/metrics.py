"""Retrieval metrics, intervals and paired comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054
#: Bootstrap resamples and seed.
RESAMPLES, SEED = 2000, 20261003


def hit(rank: str | Column, k: int) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.coalesce((r > 0) & (r <= k), F.lit(False))


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """Queries, hits and recall for each k; recall is null without queries."""
    aggs = [F.count("*").alias("queries")]
    for k in ks:
        aggs += [F.count_if(hit("expected_rank", k)).alias(f"hits_{k}"), F.try_divide(F.count_if(hit("expected_rank", k)), F.count("*")).alias(f"recall_{k}")]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def micro_macro(ranks: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Mean of hits, and mean of the groups' means."""
    g = ranks.groupBy(group).agg(F.avg(hit("expected_rank", k).cast("int")).alias("m"), F.count_if(hit("expected_rank", k)).alias("h"), F.count("*").alias("n"))
    return g.agg(F.try_divide(F.sum("h"), F.sum("n")).alias("micro"), F.avg("m").alias("macro"), F.count("*").alias("groups"))


def paired(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Counts of queries hit by both, one or neither of two methods, the difference and the union's share."""
    both = a.select("query_id", hit("expected_rank", k).alias("a")).join(b.select("query_id", hit("expected_rank", k).alias("b")), "query_id")
    x, y = F.col("a"), F.col("b")
    return both.agg(
        F.count("*").alias("queries"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"),
        F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"),
        F.try_divide(F.count_if(x) - F.count_if(y), F.count("*")).alias("difference"),
        F.try_divide(F.count_if(x | y), F.count("*")).alias("union_recall")
    )


def wilson(successes: str, total: str) -> tuple[Column, Column]:
    """Bounds of Wilson's 95 % interval; null for a total of 0."""
    s, n = F.col(successes).cast("double"), F.col(total).cast("double")
    p, z2 = F.try_divide(s, n), Z95 * Z95
    centre, width = p + F.try_divide(F.lit(z2), 2 * n), Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z2), n)
    return F.try_divide(centre - width, scale), F.try_divide(centre + width, scale)


def group_bootstrap(ranks: DataFrame, group: str, value: Column, resamples: int = RESAMPLES, seed: int = SEED) -> dict[str, float | None]:
    """Mean and 95 % interval over resamples of whole groups, in ascending group order.

    Spark adds up each group; one row per evaluation group reaches the driver, an evaluation sample's size.
    """
    rows = ranks.groupBy(group).agg(F.sum(value.cast("double")).alias("s"), F.count("*").alias("n")).orderBy(group).collect()
    if not rows:
        return {"mean": None, "low": None, "high": None}
    s, n = np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows], float)
    draws = np.random.default_rng(seed).integers(0, len(rows), (resamples, len(rows)))
    means = s[draws].sum(1) / n[draws].sum(1)
    low, high = np.quantile(means, [0.025, 0.975])
    return {"mean": float(s.sum() / n.sum()), "low": float(low), "high": float(high)}


def drawn_bootstrap(rows: DataFrame, group: str, value: Column, resamples: int = RESAMPLES, seed: str = "bootstrap-v1") -> DataFrame:
    """One row: mean of a value (or of a paired difference) and its 95 % interval over resamples of whole groups.

    The draws are hashes of seed, resample and place, so any engine can repeat
    them; groups are added up first and resamples are spread over the tasks.
    """
    sums = rows.groupBy(group).agg(F.sum(value.cast("double")).alias("s"), F.count("*").alias("n"))
    sums = sums.withColumn("i", F.row_number().over(Window.orderBy(group)) - 1)  # over the groups of an evaluation sample
    size = sums.agg(F.count("*").alias("groups"))
    places = rows.sparkSession.range(resamples).withColumnRenamed("id", "r").join(F.broadcast(size)).filter("groups > 0").select(
        "r", "groups", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))).alias("j")
    )
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "r", "j").cast("binary"), 256), 1, 12), 16, 10).cast("bigint") % F.col("groups")
    means = places.withColumn("i", drawn.cast("int")).join(sums, "i").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return sums.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean")).join(bounds)


def by_strata(rows: DataFrame, strata: dict[str, Column], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall in strata that may overlap; empty ones are left out."""
    names = F.array(*[F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in strata.items()])
    return recall_at(rows.withColumn("stratum", F.explode(F.array_compact(names))), ks, ("stratum",))


def membership_recheck(ranks: DataFrame, tops: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Disagreements between the rank field and membership in the top list, for each k (0 where all is well)."""
    lists = tops.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical_id"))), lambda x: x["canonical_id"]).alias("top"))
    j = ranks.join(lists, "query_id", "left")
    return j.agg(
        F.count("*").alias("queries"),
        *[F.count_if(hit("expected_rank", k) != F.coalesce(F.array_contains(F.slice("top", 1, k), F.col("canonical_id")), F.lit(False))).alias(f"disagree_{k}") for k in ks]
    )


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    return df.agg(*[F.percentile(column, F.lit(float(p))).alias(f"p{round(p * 100)}") for p in points])


def replay_agreement(a: DataFrame, b: DataFrame) -> int:
    """Rows that only one of two rankings has."""
    return a.exceptAll(b).count() + b.exceptAll(a).count()
