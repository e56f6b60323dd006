"""Tag and work audits: integrity counters, populations, group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ascii

#: Fixed value: the name that stands for a removed one.
REDACTED = "Redacted"


def visible(name: str | Column = "name") -> Column:
    c = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return (F.trim(c) != "") & (c != REDACTED)


def has_link(link: str = "merger_id") -> Column:
    return F.coalesce(F.col(link), F.lit(0)) != 0


def catalogue(tags: DataFrame) -> DataFrame:
    """Canonical, visible, without a link."""
    return tags.filter(F.col("canonical") & visible() & ~has_link())


def unmerged(tags: DataFrame, kind: str | None = None) -> DataFrame:
    """Visible noncanonical tags without a link: unlabelled, never negatives."""
    found = tags.filter(~F.col("canonical") & visible() & ~has_link())
    return found if kind is None else found.filter(F.col("type") == kind)


def with_targets(tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tags with status, hops and their terminal's id, name and type."""
    ends = tags.select(F.col("id").alias("terminal"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return tags.join(resolved, "id").join(ends, "terminal", "left")


def eligible_synonyms(tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """Visible noncanonical tags that resolve to a visible canonical of their type."""
    t = with_targets(tags, resolved)
    good = ~F.col("canonical") & visible() & has_link() & (F.col("status") == "RESOLVED") & visible("target_name") & (F.col("type") == F.col("target_type"))
    return t.filter(good).select(
        "id", "type", "name", "cached_count", F.col("terminal").alias("canonical_id"), F.col("target_name").alias("canonical_name"), "hops"
    )


def integrity_counters(tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of conditional counts over the whole dump."""
    t = with_targets(tags, resolved)
    own, name = visible(), F.coalesce("name", F.lit(""))
    checks = {
        "rows": F.lit(True),
        "redacted": name == REDACTED,
        "blank_names": F.trim(name) == "",
        "redacted_used": (name == REDACTED) & (F.col("cached_count") >= 5),
        "canonical_with_link": F.col("canonical") & has_link(),
        "visible_unmerged": ~F.col("canonical") & own & ~has_link(),
        "cross_type_positives": ~F.col("canonical") & own & has_link() & (F.col("status") == "RESOLVED") & visible("target_name") & (F.col("type") != F.col("target_type")),
        "reach_conflict": ~F.col("canonical") & own & (F.col("status") == "CONFLICT"),
        "missing_targets": F.col("status") == "MISSING",
        "cycles": F.col("status") == "CYCLE",
        "non_ascii": own & ~is_ascii("name"),
        "with_slash": own & F.contains(name, F.lit("/")),
        "with_ampersand": own & F.contains(name, F.lit("&")),
        "with_space": own & name.rlike(r"\s"),
    }
    return t.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])


def by_type(tags: DataFrame, resolved: DataFrame) -> DataFrame:
    """Populations of each type."""
    t = with_targets(tags, resolved)
    good = ~F.col("canonical") & visible() & has_link() & (F.col("status") == "RESOLVED") & visible("target_name") & (F.col("type") == F.col("target_type"))
    return t.groupBy("type").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("canonical") & visible() & ~has_link()).alias("catalogue"),
        F.count_if(good).alias("synonyms"),
        F.count_distinct(F.when(good, F.col("terminal"))).alias("targets"),
        F.count_if(~F.col("canonical") & visible() & ~has_link()).alias("unmerged"),
        F.sum("cached_count").alias("uses"),
    )


def split_pivot(rows: DataFrame, split: str = "split", by: str = "type") -> DataFrame:
    """Rows of each type by split."""
    return rows.groupBy(by).pivot(split, ["development", "calibration", "test"]).count().na.fill(0)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


def duplicate_names(tags: DataFrame) -> DataFrame:
    """(names that several visible tags have, tags beyond the first of each)."""
    n = tags.filter(visible()).groupBy("name").count().filter("count > 1")
    return n.agg(F.count("*").alias("names"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def group_size_stats(rows: DataFrame, group: str) -> DataFrame:
    """Median, 95th percentile, largest, singletons and the ten largest groups' share of all rows."""
    sizes = rows.groupBy(group).count()
    top = sizes.orderBy(F.desc("count"), group).limit(10).agg(F.sum("count").alias("top"))
    stats = sizes.agg(
        F.count("*").alias("groups"), F.percentile("count", F.lit(0.5)).alias("median"), F.percentile("count", F.lit(0.95)).alias("p95"),
        F.max("count").alias("largest"), F.count_if(F.col("count") == 1).alias("singletons"), F.sum("count").alias("total")
    )
    return stats.join(top).select("groups", "median", "p95", "largest", "singletons", F.try_divide("top", "total").alias("top10_share"))


def works_audit(works: DataFrame, work_tags: DataFrame, tags: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One row: works, dates, missing word counts, references that are missing, redacted or synonyms."""
    known = tags.select(F.col("id").alias("tag_id"), (F.coalesce("name", F.lit("")) == REDACTED).alias("redacted"))
    alias = synonyms.select(F.col("id").alias("tag_id"), F.lit(True).alias("synonym"))
    refs = work_tags.join(known, "tag_id", "left").join(alias, "tag_id", "left")
    r = refs.agg(
        F.count("*").alias("references"),
        F.count_if(F.col("redacted").isNull()).alias("missing_references"),
        F.count_if(F.coalesce("redacted", F.lit(False))).alias("redacted_references"),
        F.count_distinct(F.when(F.col("synonym"), F.col("ordinal"))).alias("works_with_synonym"),
        F.count_distinct(F.when(F.col("synonym"), F.col("tag_id"))).alias("observed_synonyms"),
    )
    w = works.agg(
        F.count("*").alias("works"), F.min("creation_date").alias("first_date"), F.max("creation_date").alias("last_date"),
        F.count_if(F.col("word_count").isNull()).alias("missing_words"), F.count_if(F.col("restricted")).alias("restricted_works"),
        F.count_if(F.col("complete")).alias("complete_works")
    )
    return w.join(r)


def missing_references(work_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """References to tags outside the dump, and how many works make each."""
    return work_tags.join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_anti").groupBy("tag_id").agg(F.count("*").alias("references"))


def observed_counts(work_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Works that use each tag, beside the dump's own count."""
    used = work_tags.groupBy("tag_id").agg(F.count("*").alias("observed"))
    return tags.join(used, tags["id"] == used["tag_id"], "left").select("id", "cached_count", F.coalesce("observed", F.lit(0)).alias("observed"))


def pool_sizes(rows: DataFrame, group: str) -> DataFrame:
    """(size, groups): how many groups have how many rows."""
    return rows.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
