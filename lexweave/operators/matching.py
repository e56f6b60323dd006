"""Exact and scored matching of queries against a catalogue and its aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..functions.text import contains_all_tokens


def representations(catalogue: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(rep_id, canonical_id, rep_name, is_alias): canonical names, then aliases."""
    names = catalogue.select(F.col("id").alias("rep_id"), F.col("id").alias("canonical_id"), F.col("name").alias("rep_name"), F.lit(False).alias("is_alias"))
    if aliases is None:
        return names
    return names.unionByName(aliases.select(F.col("id").alias("rep_id"), "canonical_id", F.col("name").alias("rep_name"), F.lit(True).alias("is_alias")))


def not_itself() -> Column:
    """A query's own alias is no representation for it."""
    return ~(F.col("is_alias") & (F.col("rep_id") == F.col("query_id")))


def not_same_name() -> Column:
    """The pilot's mask: an alias with the query's very name is no representation for it."""
    return ~(F.col("is_alias") & (F.col("rep_name") == F.col("query_name")))


def exact_match(queries: DataFrame, reps: DataFrame, key: Callable[[str], Column], mask: Column | None = None) -> DataFrame:
    """(query_id, status, targets): unique, ambiguous or no_match by equal normalised names, the query's own alias left out."""
    q = queries.withColumn("key", key("query_name"))
    r = reps.withColumn("key", key("rep_name")).select("key", "rep_id", "rep_name", "canonical_id", "is_alias")
    hits = q.select("query_id", "query_name", "key").join(r, "key").filter(not_itself() if mask is None else mask).groupBy("query_id").agg(
        F.array_sort(F.collect_set("canonical_id")).alias("targets")
    )
    n = F.coalesce(F.size("targets"), F.lit(0))
    return q.select("query_id").join(hits, "query_id", "left").select(
        "query_id", F.when(n <= 0, "no_match").when(n == 1, "unique").otherwise("ambiguous").alias("status"),
        F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets")
    )


def collisions(reps: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """Normalised names of several canonicals, before any masking."""
    return reps.withColumn("key", key("rep_name")).groupBy("key").agg(F.count_distinct("canonical_id").alias("targets")).filter("targets > 1")


def score_listed(queries: DataFrame, reps: DataFrame, lists: DataFrame, scorer: Callable[[str, str], Column]) -> DataFrame:
    """(query_id, canonical_id, rep_id, is_alias, score) of every query with the names of the canonicals listed for it, but its own alias.

    For whole catalogues see :mod:`lexweave.operators.scoring`.
    """
    pairs = lists.select("query_id", "canonical_id").join(queries.select("query_id", "query_name"), "query_id").join(reps, "canonical_id").filter(not_itself())
    return pairs.select("query_id", "canonical_id", "rep_id", "is_alias", scorer("query_name", "rep_name").alias("score"))


def max_pool(scores: DataFrame) -> DataFrame:
    """One score per query and canonical: the best over its name and aliases."""
    return scores.groupBy("query_id", "canonical_id").agg(F.max("score").alias("score"))


def top_k(pooled: DataFrame, k: int = 10, tie: str = "canonical_id") -> DataFrame:
    """(query_id, canonical_id, score, rank): ties by ascending id, or by another column (the pilot's names)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))
    return pooled.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def full_rank(pooled: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, canonical_id, expected_score, expected_rank) of each query's expected canonical, by counting instead of sorting."""
    own = pooled.join(
        expected.select("query_id", "canonical_id"), ["query_id", "canonical_id"]
    ).select("query_id", F.col("canonical_id").alias("t"), F.col("score").alias("s"))
    better = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("canonical_id") < F.col("t")))
    return pooled.join(own, "query_id").groupBy("query_id").agg(
        F.first("t").alias("canonical_id"), F.first("s").alias("expected_score"), (F.count_if(better) + 1).alias("expected_rank")
    )


def check_finite(scores: DataFrame) -> DataFrame:
    """The scores; a null, NaN or infinite one is an error."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return scores.withColumn("score", F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(F.col("score")))


def order_violations(ranked: DataFrame) -> DataFrame:
    """Neighbours in a ranking that break its order by score, then id."""
    w = Window.partitionBy("query_id").orderBy("rank")
    p = ranked.withColumn("ps", F.lag("score").over(w)).withColumn("pi", F.lag("canonical_id").over(w))
    return p.filter((F.col("ps") < F.col("score")) | ((F.col("ps") == F.col("score")) & (F.col("pi") >= F.col("canonical_id"))))


def candidate_union(*tops: DataFrame) -> DataFrame:
    """(query_id, candidates): ids in any of the rankings, ascending."""
    rows = tops[0].select("query_id", "canonical_id")
    for t in tops[1:]:
        rows = rows.unionByName(t.select("query_id", "canonical_id"))
    return rows.distinct().groupBy("query_id").agg(F.array_sort(F.collect_list("canonical_id")).alias("candidates"))


def reciprocal_rank_fusion(*tops: DataFrame, k: int = 60) -> DataFrame:
    """An extension: scores 1 / (k + rank), added up over rankings."""
    rows = None
    for t in tops:
        part = t.select("query_id", "canonical_id", (1.0 / (k + F.col("rank"))).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("query_id", "canonical_id").agg(F.sum("score").alias("score")))


def margin(ranked: DataFrame) -> DataFrame:
    """(query_id, score, margin): the best score and how far the second lies below it (null if there is none)."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    return ranked.groupBy("query_id").agg(first.alias("score"), (first - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))


def listed_names(ranked: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, names): names of the first ``k``, in order."""
    own = ranked.filter(F.col("rank") <= k).join(names.select(F.col("id").alias("canonical_id"), "name"), "canonical_id")
    return own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))


def changed_hits(a: DataFrame, b: DataFrame, seed: str, k: int = 10, most: int = 5) -> DataFrame:
    """(query_id, change, place): the first queries, in hash order, that only one of two methods hits: gains of ``a`` and its losses."""
    from .metrics import hit

    both = a.select("query_id", hit("expected_rank", k).alias("x")).join(b.select("query_id", hit("expected_rank", k).alias("y")), "query_id").filter("x <> y")
    w = Window.partitionBy("change").orderBy(hash_order(seed, "query_id"), "query_id")
    own = both.select("query_id", F.when(F.col("x"), "gain").otherwise("loss").alias("change"))
    return own.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most)


def search_names(catalogue: DataFrame, aliases: DataFrame, asked: str, most: int = 100) -> DataFrame:
    """(id, name, matches): the first canonicals, by id, whose names and aliases hold every word asked for; ``#id`` finds one; ``matches`` counts all."""
    asked = asked.strip()
    own = aliases.groupBy("canonical_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("name"))).alias("others"))
    rows = catalogue.join(own, catalogue["id"] == own["canonical_id"], "left")
    exact = asked[1:] if asked[:1] == "#" and asked[1:].isdigit() else None
    found = rows.filter(F.col("id") == int(exact)) if exact else rows.filter(contains_all_tokens(F.concat_ws(" ", "name", "others"), F.lit(asked)))
    found = found.filter(F.lit(bool(asked))).select("id", "name")
    return found.orderBy("id").limit(most).join(found.agg(F.count("*").alias("matches")))
