"""Checks of a frozen snapshot: references between its tables, splits, and that samples can be derived again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling


def violations(catalogue: DataFrame, aliases: DataFrame, examples: DataFrame) -> DataFrame:
    """(rule, rows) of broken rules; an empty result is a sound snapshot.

    catalogue: (id, name, type, split); aliases: (id, name, canonical_id, canonical_name, split);
    examples: (query_id, query_name, canonical_id, kind), kind synonym or canonical_name.
    """
    target = catalogue.select(F.col("id").alias("canonical_id"), F.col("name").alias("t_name"), F.col("split").alias("t_split"))
    joined = aliases.join(target, "canonical_id", "left")
    own = aliases.select(F.col("id").alias("query_id"), F.col("name").alias("a_name"), F.col("canonical_id").alias("a_target"))
    synonyms = examples.filter("kind = 'synonym'").join(own, "query_id", "left")
    identities = examples.filter("kind = 'canonical_name'").join(target, "canonical_id", "left")
    rules = {
        "repeated catalogue id": catalogue.groupBy("id").count().filter("count > 1"),
        "repeated alias id": aliases.groupBy("id").count().filter("count > 1"),
        "alias is canonical": aliases.join(catalogue.select("id"), "id", "left_semi"),
        "alias without target": joined.filter("t_name IS NULL"),
        "alias disagrees with its target": joined.filter("NOT (canonical_name <=> t_name) OR NOT (split <=> t_split)").filter("t_name IS NOT NULL"),
        "example without alias": synonyms.filter("a_name IS NULL"),
        "example disagrees with its alias": synonyms.filter("a_name IS NOT NULL AND (query_name <> a_name OR canonical_id <> a_target)"),
        "identity is not its canonical": identities.filter("NOT (query_name <=> t_name) OR query_id <> canonical_id"),
    }
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")
        out = one if out is None else out.unionByName(one)
    return out.filter("rows > 0")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).intersect(b.select(key)).isEmpty()


def same_sample(rows: DataFrame, frozen: DataFrame, key: str, group: str, seed: str, size: int, cap: int) -> bool:
    """Whether drawing the sample again gives the frozen one."""
    again = sampling.capped_sample(rows, key, group, seed, size, cap, strict=False).select(key)
    return again.exceptAll(frozen.select(key)).isEmpty() and frozen.select(key).exceptAll(again).isEmpty()
