"""Adjudication: prompts, answers, decisions and outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the key of the option that rejects all candidates.
NONE = "none_of_these"
#: How far the sum of probabilities may be from 1, and a tie's width.
SUM_TOLERANCE, TIE = 0.02, 1e-6


@dataclass(frozen=True)
class Condition:
    """What a question shows: which prompt, whether aliases and observed co-tags, in what order, and how it asks."""

    prompt: str
    aliases: bool = False
    context: bool = False
    shuffled: bool = False
    none: bool = True
    pairwise: bool = False


#: The conditions of the comparison.
CONDITIONS = {
    "generic_names": Condition("generic", none=False), "strict_names": Condition("strict"), "ao3_names": Condition("ao3"), "ao3_aliases": Condition("ao3", aliases=True),
    "ao3_aliases_shuffled": Condition("ao3", aliases=True, shuffled=True), "ao3_context": Condition("context", aliases=True, context=True), "ao3_pairwise_aliases": Condition("pairwise", aliases=True, none=False, pairwise=True),
}


def json_text(c: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def candidate_description(condition: Condition, name: Column, aliases: Column, context: Column) -> Column:
    """JSON of what a candidate shows: its name and, where the condition has them, aliases (an array) and co-tags (a map of arrays).

    Nothing else is an input, so no label, rank or score can be in it.
    """
    texts = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ", "), F.lit("]"))
    parts = [F.concat(F.lit('"canonical_tag": '), json_text(name))]
    if condition.aliases:
        parts.append(F.when(F.size(aliases) > 0, F.concat(F.lit('"known_alternate_names": '), texts(aliases))))
    if condition.context:
        kinds = F.transform(F.map_entries(context), lambda e: F.concat(json_text(e["key"]), F.lit(": "), texts(e["value"])))
        parts.append(F.when(F.size(context) > 0, F.concat(F.lit('"observed_co_tags": {'), F.array_join(kinds, ", "), F.lit("}"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def question(
    condition: Condition, model: str, prompt: str, incoming: Column, described: Column, none_text: str, own_context: Column | None = None,
    true_text: str = "yes", false_text: str = "no"
) -> Column:
    """JSON of a request about an array of (id, text) candidates in the order shown.

    A choice has one question with an option for each candidate, the rejecting
    one last; the pairwise form asks about each candidate by itself.
    """
    state = [F.concat(F.lit('"incoming_tag":'), json_text(incoming)), F.lit('"type":"Freeform"')]
    if condition.context and own_context is not None:
        state.append(F.concat(F.lit('"observed_co_tags":'), F.to_json(own_context)))
    key = lambda x: F.concat(F.lit('"tag_'), x["id"].cast("string"), F.lit('":'))
    if condition.pairwise:
        ends = F.concat(F.lit(',"criteria":{"true":'), json_text(F.lit(true_text)), F.lit(',"false":'), json_text(F.lit(false_text)), F.lit("}}"))
        asked = F.array_join(
            F.transform(described, lambda x: F.concat(key(x), F.lit('{"type":"noul","instructions":'), json_text(F.concat(F.lit(prompt), x["text"])), ends)),
            ","
        )
    else:
        options = F.transform(described, lambda x: F.concat(key(x), json_text(x["text"])))
        if condition.none:
            options = F.concat(options, F.array(F.concat(F.lit(f'"{NONE}":'), json_text(F.lit(none_text)))))
        asked = F.concat(
            F.lit('"canonical":{"type":"choice","instructions":'), json_text(F.lit(prompt)), F.lit(',"criteria":{'),
            F.array_join(options, ","), F.lit("}}")
        )
    return F.concat(F.lit(f'{{"model":"{model}","state":{{'), F.concat_ws(",", *state), F.lit('},"questions":{'), asked, F.lit("}}"))


def shuffled(ids: str | Column, source: str, seed: str = "order-v1") -> Column:
    """Candidate ids by hash of source and candidate, then id."""
    keyed = F.transform(
        ids,
        lambda i: F.struct(F.sha2(F.concat_ws(":", F.lit(seed), F.col(source).cast("string"), i.cast("string")).cast("binary"), 256).alias("h"), i.alias("i"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def payload(model: str, instructions: str, ids: Column, describe: str, none_description: str | None = None, context: str | None = None) -> Column:
    """Ordered JSON of a choice question; ``describe``: a map column of candidate id to JSON text. Labels are no input of it."""
    options = F.transform(ids, lambda i: F.concat(F.lit('"tag_'), i.cast("string"), F.lit('":'), F.element_at(F.col(describe), i)))
    if none_description is not None:
        options = F.concat(
            options,
            F.array(F.concat(F.lit(f'"{NONE}":'), F.regexp_extract(F.to_json(F.struct(F.lit(none_description).alias("v"))), r"^\{\"v\":(.*)\}$", 1)))
        )
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    state = [F.concat(F.lit('"incoming_tag":'), text(F.col("incoming_tag"))), F.lit('"type":"Freeform"')]
    if context:
        state.append(F.concat(F.lit('"observed_co_tags":'), F.to_json(context)))
    return F.concat(
        F.lit(f'{{"model":"{model}","state":{{'), F.concat_ws(",", *state),
        F.lit('},"questions":{"canonical":{"type":"choice","instructions":'), text(F.lit(instructions)), F.lit(',"criteria":{'),
        F.array_join(options, ","), F.lit("}}}}")
    )


def best_option(probabilities: Column, none: bool = False) -> Column:
    """Key of the highest probability, ties by numeric id; the rejecting option counts only if asked for."""
    rows = F.transform(
        F.map_entries(probabilities),
        lambda e: F.struct((-e["value"]).alias("p"), F.regexp_extract(e["key"], r"^tag_(\d+)$", 1).try_cast("bigint").alias("i"), e["key"].alias("k"))
    )
    use = rows if none else F.filter(rows, lambda r: r["k"] != NONE)
    return F.get(F.array_sort(use), F.lit(0))["k"]


RESPONSE = "model string, error string, answers struct<canonical: struct<type: string, choice: string, probabilities: map<string, string>>>"


def parse_choice(responses: DataFrame, model: str, response: str = "response", options: str = "options") -> DataFrame:
    """Decisions from JSON answers, and ``problem``: null for a valid answer, else what is wrong.

    A choice other than the most probable stays the choice; ``forced_id`` is
    the best candidate when rejecting is not allowed.
    """
    r = responses.withColumn("_r", F.from_json(response, RESPONSE))
    raw = F.col("_r.answers.canonical.probabilities")
    number = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"  # so neither words, nor NaN, nor true and false
    bad_value = F.exists(F.map_values(raw), lambda v: v.isNull() | ~v.rlike(number) | ~F.coalesce(v.try_cast("double").between(0, 1), F.lit(False)))
    r = r.withColumn("_p", F.when(raw.isNotNull() & ~bad_value, F.transform_values(raw, lambda k, v: v.try_cast("double"))))
    total = F.aggregate(F.map_values("_p"), F.lit(0.0), lambda s, v: s + v)
    choice = F.col("_r.answers.canonical.choice")
    same = F.array_sort(F.map_keys(raw)) == F.array_sort(F.col(options))
    problem = (
        F.when(F.col("_r").isNull() | F.col("_r.error").isNotNull(), "error or no answer")
        .when(~F.coalesce((F.col("_r.model") == model) | F.startswith(F.col("_r.model"), F.lit(model + "-")), F.lit(False)), "other model")
        .when(F.col("_r.answers.canonical").isNull(), "missing answer")
        .when(
            ~F.coalesce(
                F.col("_r.answers.canonical.type") == "choice", F.lit(False)
            ) | ~F.coalesce(same, F.lit(False)) | ~F.coalesce(F.array_contains(F.col(options), choice), F.lit(False)),
            "other options"
        )
        .when(F.col("_p").isNull(), "not a probability")
        .when(F.abs(total - 1) > SUM_TOLERANCE, "sum of probabilities")
    )
    tag = lambda c: F.regexp_extract(c, r"^tag_(\d+)$", 1).try_cast("bigint")
    own = F.element_at("_p", choice)
    r = r.withColumn("problem", problem)
    valid = lambda c: F.when(F.col("problem").isNull(), c)
    return r.select(
        *[F.col(c) for c in responses.columns], "problem",
        valid(F.when(choice != NONE, tag(choice))).alias("selected_id"), valid(tag(best_option(F.col("_p")))).alias("forced_id"),
        valid(own).alias("selected_probability"), valid(F.try_element_at("_p", F.lit(NONE))).alias("none_probability"),
        valid(own + TIE < F.array_max(F.map_values("_p"))).alias("choice_disagrees_with_argmax"),
    )


def pairwise_decision(answers: str) -> Column:
    """Best key of a map of yes-probabilities, ties by numeric id."""
    return best_option(F.col(answers))


def rerank(shortlist: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, selected_id): the shortlist's best by score over name and aliases, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "canonical_id")
    best = scores.groupBy("query_id", "canonical_id").agg(F.max("score").alias("score"))
    return shortlist.select("query_id", "canonical_id").join(best, ["query_id", "canonical_id"], "left").withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", F.col("canonical_id").alias("selected_id"))


def outcomes(cases: DataFrame) -> DataFrame:
    """Outcome flags over (query_id, answer, top_ids, selected_id, forced_id); a selection outside the shortlist is an error.

    A rejection on a retrieval miss is a correct shortlist rejection, not a match.
    """
    top, sel, ans = F.col("top_ids"), F.col("selected_id"), F.col("answer")
    outside = sel.isNotNull() & ~F.array_contains(top, sel) | ~F.array_contains(top, F.col("forced_id"))
    present = F.array_contains(top, ans)
    correct, base = F.coalesce(sel == ans, F.lit(False)), F.get(top, F.lit(0)) == ans
    none = sel.isNull()
    flags = {
        "target_present": present, "correct": correct, "abstained": none, "baseline_correct": base, "forced_correct": F.col("forced_id") == ans,
        "rescue": correct & ~base, "regression": base & ~correct, "selection_error": present & ~none & ~correct, "unnecessary_abstention": present & none,
        "correct_shortlist_rejection": ~present & none, "wrong_acceptance_on_retrieval_miss": ~present & ~none,
    }
    checked = cases.withColumn(
        "top_ids",
        F.when(F.coalesce(outside, F.lit(True)), F.raise_error(F.lit("a selection is outside its shortlist")).cast("array<bigint>")).otherwise(top)
    )
    return checked.select(*cases.columns, *[v.alias(k) for k, v in flags.items()])


def summarize(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates of outcomes; rates without a denominator are null."""
    n = F.count_if
    c = F.col
    accepted = ~c("abstained")
    aggs = [
        F.count("*").alias("queries"), n(c("target_present")).alias("present"), n(~c("target_present")).alias("retrieval_misses"), n(c("correct")).alias("successes"),
        F.try_divide(n(c("correct")), F.count("*")).alias("overall_success"), F.try_divide(
            n(c("correct") & c("target_present")), n(c("target_present"))
        ).alias("conditional_success"),
        F.try_divide(n(c("correct") | c("correct_shortlist_rejection")), F.count("*")).alias("shortlist_decision_accuracy"),
        F.try_divide(n(c("correct")), n(accepted)).alias("precision"), F.try_divide(n(accepted), F.count("*")).alias("acceptance"),
        *[n(c(k)).alias(k + "s") for k in ("baseline_correct", "rescue", "regression", "selection_error", "unnecessary_abstention", "correct_shortlist_rejection", "wrong_acceptance_on_retrieval_miss")],
        n(c("forced_correct")).alias("forced_successes"), n(c("forced_correct") & ~c("baseline_correct")).alias("forced_rescues"), n(~c("forced_correct") & c("baseline_correct")).alias("forced_regressions"),
        F.try_divide(n(c("forced_correct")) - n(c("baseline_correct")), F.count("*")).alias("forced_difference"),
    ]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def recount_violations(summary: DataFrame) -> DataFrame:
    """Rows of a summary that break its identities."""
    return summary.filter(
        "successes <> baseline_corrects + rescues - regressions OR queries <> successes + selection_errors + unnecessary_abstentions + retrieval_misses"
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: queries that only one of two conditions gets right, and changed selections."""
    j = a.select("query_id", F.col("correct").alias("x"), F.col("selected_id").alias("s")).join(
        b.select("query_id", F.col("correct").alias("y"), F.col("selected_id").alias("t")), "query_id"
    )
    return j.agg(
        F.count("*").alias("queries"), F.count_if(F.col("x") & ~F.col("y")).alias("a_only"),
        F.count_if(~F.col("x") & F.col("y")).alias("b_only"), F.count_if(~F.col("s").eqNullSafe(F.col("t"))).alias("changed_selections"),
        F.try_divide(F.count_if("x") - F.count_if("y"), F.count("*")).alias("difference")
    )


def operations(log: DataFrame) -> DataFrame:
    """Requests, attempts, latency, and sums that are null as soon as one part is missing."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    return log.agg(
        F.count("*").alias("requests"), whole("cost"), whole("input_tokens"), whole("output_tokens"), F.sum("attempts").alias("attempts"),
        F.percentile("seconds", F.lit(0.5)).alias("p50"), F.percentile("seconds", F.lit(0.95)).alias("p95"),
        F.array_sort(F.collect_set("model")).alias("models")
    )
