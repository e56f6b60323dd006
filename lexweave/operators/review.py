"""Human review: validation of judgments and proposals, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns])


def _target(catalogue: DataFrame, rows: DataFrame) -> DataFrame:
    known = catalogue.select(F.col("id").cast("string").alias("canonical_id"), F.lit(True).alias("known")).distinct()
    return rows.join(known, "canonical_id", "left")


def _ids(rows: DataFrame, cases: DataFrame, problem: Column) -> DataFrame:
    """Adds problems of identity: unknown, repeated and missing sources."""
    repeated = rows.groupBy("source_id").agg(F.count("*").alias("times"))
    expected = cases.select(F.col("source_id").cast("string").alias("source_id"), F.lit(True).alias("expected")).distinct()
    j = rows.join(repeated, "source_id").join(expected, "source_id", "full")
    return j.withColumn(
        "problem",
        F.when(F.col("expected").isNull(), "unknown source").when(F.col("times").isNull(), "missing source").when(F.col("times") > 1, "repeated source").otherwise(problem)
    ).drop("times", "expected", "known")


def validate_references(judgments: DataFrame, cases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Judgments with ``problem`` (null: valid); blank judgments are pending."""
    r = _target(catalogue, _clean(judgments))
    j, no_name, no_id = F.col("judgment"), F.col("proposed_name") == "", F.col("canonical_id") == ""
    problem = (
        F.when(j == "", None)
        .when(~j.isin("synonym", "new_canonical", "unresolved"), "unknown judgment")
        .when((F.col("reviewer") == "") | (F.col("rationale") == "") | ~F.col("confidence").isin("high", "medium", "low"), "incomplete evidence")
        .when(~F.col("catalogue_checked").isin("", "yes", "no"), "catalogue_checked")
        .when((j == "synonym") & (F.col("known").isNull() | ~no_name), "synonym needs a known target only")
        .when((j == "new_canonical") & (~no_id | (F.col("catalogue_checked") != "yes")), "new canonical needs a catalogue search and no target")
        .when((j == "unresolved") & (~no_id | ~no_name), "unresolved has no target")
    )
    return _ids(r, cases, problem)


def validate_proposals(proposals: DataFrame, cases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Proposals with ``problem`` (null: valid); blank actions are not submitted."""
    r = _target(catalogue, _clean(proposals))
    a, no_name, no_id = F.col("action"), F.col("proposed_name") == "", F.col("canonical_id") == ""
    problem = (
        F.when(a == "", None)
        .when(~a.isin("synonym", "new_canonical", "abstain"), "unknown action")
        .when((a == "synonym") & (F.col("known").isNull() | ~no_name), "synonym needs a known target only")
        .when((a == "new_canonical") & ~no_id, "new canonical has no target")
        .when((a == "abstain") & (~no_id | ~no_name), "abstention has no target")
    )
    return _ids(r, cases, problem)


def baseline_proposals(tops: DataFrame, method: str) -> DataFrame:
    """(source_id, action, canonical_id) from the first ids of two rankings (template, pooled)."""
    t, p = F.col("template"), F.col("pooled")
    if method == "always_template":
        return tops.select("source_id", F.lit("synonym").alias("action"), t.alias("canonical_id"))
    if method == "always_alias_max":
        return tops.select("source_id", F.lit("synonym").alias("action"), p.alias("canonical_id"))
    if method == "semantic_agreement_else_abstain":
        return tops.select("source_id", F.when(t == p, "synonym").otherwise("abstain").alias("action"), p.alias("canonical_id"))
    raise ValueError(f"unknown method {method}")


def measure_actions(cases: DataFrame, references: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: coverage, precision, false merges, and what happens to unresolved cases; each rate with its own denominator."""
    r = references.select("source_id", F.col("judgment"), F.col("canonical_id").alias("answer"))
    p = proposals.select("source_id", F.col("action"), F.col("canonical_id").alias("target"))
    j = cases.select("source_id").distinct().join(r, "source_id", "left").join(p, "source_id", "left")
    c, n = F.col, F.count_if
    merge, new, resolved = c("action") == "synonym", c("action") == "new_canonical", c("judgment").isin("synonym", "new_canonical")
    right = (c("judgment") == "synonym") & (c("answer") == c("target"))
    ref_new = c("judgment") == "new_canonical"
    return j.agg(
        n(c("action").isNotNull()).alias("submitted"), n(c("action").isNull()).alias("missing_proposals"), n(merge).alias("synonym_proposals"), n(new).alias("new_canonical_proposals"), n(c("action") == "abstain").alias("abstentions"),
        F.try_divide(n(merge | new), F.count("*")).alias("proposal_coverage"), F.try_divide(n(merge & right), n(merge & resolved)).alias("resolved_synonym_precision"),
        F.try_divide(n(merge & resolved) - n(merge & right), n(merge & resolved)).alias("resolved_false_merge_fraction"),
        F.try_divide(n(merge & ref_new), n(ref_new & c("action").isNotNull())).alias("false_merge_rate_on_new_concepts"),
        n(merge & (c("judgment") == "unresolved")).alias("merges_on_unresolved"), n(merge & c("judgment").isNull()).alias("merges_without_reference"),
        F.try_divide(n(new & ref_new), n(new & resolved)).alias("new_canonical_precision"),
        n(new & (c("judgment") == "unresolved")).alias("new_on_unresolved"), n(new & c("judgment").isNull()).alias("new_without_reference"),
    )


def shortlist_recall(cases: DataFrame, references: DataFrame, tops: DataFrame) -> DataFrame:
    """Recall of reviewed synonyms by method at 1, 3, 5 and 10; tops: (source_id, method, top_ids)."""
    r = references.filter("judgment = 'synonym'").select("source_id", F.col("canonical_id").alias("answer"))
    j = cases.select("source_id").distinct().join(r, "source_id").join(tops, "source_id")
    each = j.groupBy("method").agg(
        F.count("*").alias("synonyms"),
        *[F.try_divide(F.count_if(F.array_contains(F.slice("top_ids", 1, k), F.col("answer"))), F.count("*")).alias(f"recall_{k}") for k in (1, 3, 5, 10)]
    )
    union = j.groupBy("source_id").agg(F.max(F.array_contains(F.slice("top_ids", 1, 10), F.col("answer")).cast("int")).alias("h")).agg(
        F.lit("union").alias("method"), F.count("*").alias("synonyms"), F.avg("h").alias("recall_10")
    )
    return each.unionByName(union, allowMissingColumns=True)


def shared_targets(references: DataFrame) -> DataFrame:
    """Targets that both calibration and validation references have."""
    by = lambda p: references.filter((F.col("partition") == p) & F.col("canonical_id").isNotNull()).select("canonical_id")
    return by("calibration").intersect(by("validation"))


def arm_diagnostics(cases: DataFrame) -> DataFrame:
    """Counts by arm over (arm, name, template, pooled, context_works, score)."""
    return cases.groupBy("arm").agg(
        F.count("*").alias("cases"), F.count_if(F.col("template") == F.col("pooled")).alias("agreement"),
        F.count_if(F.col("name").rlike(r"[^\x00-\x7F]")).alias("non_ascii"), F.count_if(F.col("context_works") > 0).alias("with_context"),
        F.percentile("score", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("score_quantiles")
    )
