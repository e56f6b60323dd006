"""Resolution of link graphs in which every node has at most one outgoing link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def conflicting_edges(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Sources with several targets."""
    return edges.groupBy(source).agg(F.count_distinct(target).alias("targets")).filter("targets > 1")


def resolve_links(nodes: DataFrame, key: str = "id", link: str = "merger_id", canonical: str = "canonical") -> DataFrame:
    """(key, terminal, status, hops): where following links from each node ends.

    RESOLVED: at a canonical node without a link.  UNMERGED: at a node with
    neither.  CONFLICT: at a canonical node with a link.  MISSING: at a link to
    an absent node.  CYCLE: nowhere (hops 0).  A null or zero link is none.
    Keys must be unique.  Pointers double each round, so a chain of n links
    takes log2(n) joins; the loop ends when a round decides no further node.
    """
    n = nodes.select(F.col(key).alias("id"), F.when(F.col(link).cast("string") != "0", F.col(link)).alias("link"), F.col(canonical).alias("canonical"))
    unique = n.agg(F.count("*").alias("a"), F.count_distinct("id").alias("b")).first()
    if unique["a"] != unique["b"]:
        raise ValueError("node keys must be unique and not null")
    known = n.select(F.col("id").alias("link"), F.lit(True).alias("present"))
    status = (
        F.when(F.col("canonical") & F.col("link").isNotNull(), "CONFLICT")
        .when(F.col("canonical"), "RESOLVED")
        .when(F.col("link").isNull(), "UNMERGED")
        .when(F.col("present").isNull(), "MISSING")
    )
    state = n.join(known, "link", "left").select("id", "link", status.alias("status"))
    state = cut(
        state.select(
            "id", F.col("link").alias("at"), "status", F.when(F.col("status") == "RESOLVED", F.col("id")).alias("terminal"),
            F.when((F.col("status") == "MISSING") | F.col("status").isNull(), 1).otherwise(0).alias("hops")
        )
    )
    open_before = None
    while (still := state.filter("status IS NULL").count()) and still != open_before:
        open_before = still
        state = cut(_jump(_jump(state)))  # two doublings for each table written
    return state.select(
        F.col("id").alias(key), "terminal", F.coalesce("status", F.lit("CYCLE")).alias("status"),
        F.when(F.col("status").isNull(), 0).otherwise(F.col("hops")).cast("long").alias("hops")
    )


def _jump(state: DataFrame) -> DataFrame:
    """Undecided nodes take over what the node they point at knows: its end, or where it points."""
    ahead = state.select(
        F.col("id").alias("at"), F.col("at").alias("next"), F.col("status").alias("s"), F.col("terminal").alias("t"), F.col("hops").alias("h")
    )
    waiting = state.filter("status IS NULL").join(ahead, "at")
    hops = (F.col("hops") + F.col("h")).alias("hops")
    moved = waiting.select("id", F.col("next").alias("at"), F.col("s").alias("status"), F.col("t").alias("terminal"), hops)
    return state.filter("status IS NOT NULL").unionByName(moved)


def resolve_names(edges: DataFrame, source: str = "from_tag", target: str = "to_tag") -> DataFrame:
    """(source, canonical, hops) of name-keyed chains; names that are no source are canonical; a cycle is an error."""
    names = edges.select(F.col(source).alias("id")).union(edges.select(F.col(target))).distinct()
    e = edges.select(F.col(source).alias("id"), F.col(target).alias("merger_id")).distinct()
    if not conflicting_edges(e, "id", "merger_id").isEmpty():
        raise ValueError("a name has several targets")
    nodes = names.join(e, "id", "left").withColumn("canonical", F.col("merger_id").isNull())
    # digests stand for names: any text is a name, and no digest is taken for a missing link
    keyed = nodes.select(
        F.sha2(F.col("id").cast("binary"), 256).alias("id"), F.col("id").alias("name"),
        F.sha2(F.col("merger_id").cast("binary"), 256).alias("merger_id"), "canonical"
    )
    found = resolve_links(keyed)
    if not found.filter("status = 'CYCLE'").isEmpty():
        raise ValueError("the names form a cycle")
    back = keyed.select(F.col("id").alias("terminal"), F.col("name").alias("canonical_name"))
    return keyed.filter("merger_id IS NOT NULL").join(found, "id").join(back, "terminal").select(
        F.col("name").alias(source), F.col("canonical_name").alias("canonical"), "hops"
    )
