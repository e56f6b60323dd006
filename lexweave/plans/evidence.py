"""Further queries: adjudication, review, strata, names, and round trips through sources and sinks; each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import group_split
from ..functions.scratch import cut, shared_path
from ..operators import audit, decisions, graph, matching, metrics, profiles, review, sampling, scoring
from ..sources import tables as src
from . import oracle as o
from .queries import Profiles, _nine, _reviewed, _top, _trigram_ranks, query
from .views import SEED, Host, table

SQL: dict[str, str] = {}
CTE, TOP = o.CTE, o.TOP
TRI_TOP = CTE + o.TRI + f", top AS ({TOP.format('tri')})"


def _ids(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# ----------------------------------------------------------- adjudication --
ASKED = ("generic_names", "strict_names", "ao3_names", "ao3_aliases", "ao3_aliases_shuffled", "ao3_pairwise_aliases")
MODEL, NONE_TEXT = "model-x", "None of them."
PROMPTS = {"generic": "Same concept?", "strict": "Strictly the same?", "ao3": "Which mapping?", "pairwise": "Does it map here?\n"}


def _describer(condition: decisions.Condition) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["id"].alias("id"), decisions.candidate_description(condition, x["name"], x["aliases"], F.create_map()).alias("text"))


@query
def adjudication_questions(h: Host) -> DataFrame:
    """Requests of six conditions about every shortlist (the seventh adds co-tags, which tests cover)."""
    top = cut(_top(h, h.names))
    names = h.freeform.select(F.col("id").alias("canonical_id"), "name")
    own = profiles.select_aliases(h.aliases, h.queries.select(F.col("query_id").alias("id")))
    own = own.groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("aliases"))
    rows = top.join(names, "canonical_id").join(own, "canonical_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("canonical_id").alias("id"), "name", "aliases"))).alias("shown"))
    cases = lists.join(h.queries.select("query_id", "query_name"), "query_id")
    out = None
    for name in ASKED:
        c = decisions.CONDITIONS[name]
        order = F.col("shown")
        if c.shuffled:
            ids = decisions.shuffled(F.transform("shown", lambda x: x["id"]), "query_id")
            order = F.transform(ids, lambda i: F.get(F.filter("shown", lambda x: x["id"] == i), F.lit(0)))
        described = F.transform(order, _describer(c))
        one = cases.select(
            "query_id", F.lit(name).alias("condition"),
            decisions.question(c, MODEL, PROMPTS[c.prompt], F.col("query_name"), described, NONE_TEXT).alias("question")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _question_sql() -> str:
    text = "'{\"canonical_tag\": ' || CAST(to_json(name) AS VARCHAR) || '}'"
    more = "'{\"canonical_tag\": ' || CAST(to_json(name) AS VARCHAR) || coalesce(', \"known_alternate_names\": [' || names || ']', '') || '}'"
    head = f"'{{\"model\":\"{MODEL}\",\"state\":{{\"incoming_tag\":' || CAST(to_json(query_name) AS VARCHAR) || ',\"type\":\"Freeform\"}},\"questions\":{{'"
    sql, parts = TRI_TOP + ", " + o.PROFILE.split("pal AS", 1)[1].join(["pal AS", ""]).rstrip().rstrip(","), []
    sql += ", an AS (SELECT canonical_id, string_agg(CAST(to_json(name) AS VARCHAR), ', ' ORDER BY place) AS names FROM pal GROUP BY canonical_id)"
    sql += ", r AS (SELECT top.*, f.name, names, query_name FROM top JOIN ff f ON f.id = top.canonical_id LEFT JOIN an ON an.canonical_id = top.canonical_id JOIN q ON q.query_id = top.query_id)"
    for name in ASKED:
        c = decisions.CONDITIONS[name]
        described = more if c.aliases else text
        order = "sha256('order-v1:' || query_id || ':' || canonical_id), canonical_id" if c.shuffled else "rank"
        prompt = PROMPTS[c.prompt].replace("\n", "' || chr(10) || '")
        if c.pairwise:
            each = f"'\"tag_' || canonical_id || '\":{{\"type\":\"noul\",\"instructions\":' || CAST(to_json('{prompt}' || {described}) AS VARCHAR) || ',\"criteria\":{{\"true\":\"yes\",\"false\":\"no\"}}}}'"
            body = f"string_agg({each}, ',' ORDER BY {order})"
        else:
            each = f"'\"tag_' || canonical_id || '\":' || CAST(to_json({described}) AS VARCHAR)"
            none = f" || ',\"{decisions.NONE}\":\"{NONE_TEXT}\"'" if c.none else ""
            body = f"'\"canonical\":{{\"type\":\"choice\",\"instructions\":\"{PROMPTS[c.prompt]}\",\"criteria\":{{' || string_agg({each}, ',' ORDER BY {order}){none} || '}}}}'"
        parts.append(f"SELECT query_id, '{name}' AS condition, {head} || {body} || '}}}}' AS question FROM r GROUP BY query_id, query_name")
    return sql + " " + " UNION ALL ".join(parts)


SQL["adjudication_questions"] = _question_sql()


@query
def decision_answers(h: Host) -> DataFrame:
    """Answers of eight kinds, six of them faulty, to the shortlists' questions, and the decisions read from them."""
    lists = _top(h, h.names).groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "canonical_id"))),
            lambda x: F.concat(F.lit("tag_"), x["canonical_id"].cast("string"))
        ).alias("tags")
    )
    k = (F.col("query_id") % 8).alias("k")
    rows = lists.select("query_id", "tags", k).withColumn("options", F.concat("tags", F.array(F.lit(decisions.NONE))))
    liked = F.when(F.col("k") == 1, F.lit(decisions.NONE)).otherwise(F.get("tags", F.lit(0)))
    chosen = F.when(F.col("k") == 7, F.get("tags", F.lit(1))).otherwise(liked)
    shown = F.when(F.col("k") == 5, F.col("tags")).otherwise(F.col("options"))
    value = lambda x: F.when(x != liked, "0.04").when(F.col("k") == 4, "0.7").when(F.col("k") == 6, '"x"').otherwise("0.6")
    chances = F.array_join(F.transform(shown, lambda x: F.concat(F.lit('"'), x, F.lit('":'), value(x))), ",")
    answer = F.concat(
        F.lit('{"model":"'), F.when(F.col("k") == 2, "other").otherwise("m-1"),
        F.lit('","answers":{"canonical":{"type":"choice","choice":"'), chosen, F.lit('","probabilities":{'), chances, F.lit("}}}}")
    )
    rows = rows.withColumn("response", F.when(F.col("k") == 3, '{"error":"busy"}').otherwise(answer))
    return decisions.parse_choice(rows, "m").drop("tags", "k", "options", "response")


SQL["decision_answers"] = TRI_TOP + """, l AS (SELECT query_id, list(canonical_id ORDER BY rank) AS t, query_id % 8 AS k FROM top GROUP BY query_id),
s AS (SELECT *, CASE WHEN k = 4 THEN 0.7 ELSE 0.6 END + 0.04 * (len(t) - CASE WHEN k = 5 THEN 1 ELSE 0 END) AS total FROM l),
p AS (SELECT *, CASE WHEN k = 3 THEN 'error or no answer' WHEN k = 2 THEN 'other model' WHEN k = 5 THEN 'other options' WHEN k = 6 THEN 'not a probability' WHEN abs(total - 1) > 0.02 THEN 'sum of probabilities' END AS problem FROM s)
SELECT query_id, problem, CASE WHEN problem IS NULL THEN CASE k WHEN 1 THEN NULL WHEN 7 THEN t[2] ELSE t[1] END END AS selected_id,
  CASE WHEN problem IS NULL THEN CASE WHEN k = 1 THEN list_min(t) ELSE t[1] END END AS forced_id,
  CASE WHEN problem IS NULL THEN CAST(CASE WHEN k = 7 THEN 0.04 ELSE 0.6 END AS DOUBLE) END AS selected_probability,
  CASE WHEN problem IS NULL THEN CAST(CASE WHEN k = 1 THEN 0.6 ELSE 0.04 END AS DOUBLE) END AS none_probability,
  CASE WHEN problem IS NULL THEN k = 7 END AS choice_disagrees_with_argmax FROM p"""


@query
def baseline_decisions(h: Host) -> DataFrame:
    """What the first choice and the edit distance over names and permitted aliases select from each shortlist."""
    top = cut(_top(h, h.names))
    allowed = h.aliases.join(h.queries.select(F.col("query_id").alias("id")), "id", "left_anti")
    listed = matching.score_listed(h.queries, matching.representations(h.freeform, allowed), top, tx.SCORERS["levenshtein"])
    first = top.filter("rank = 1").select("query_id", F.lit("retrieval_top1").alias("method"), F.col("canonical_id").alias("selected_id"))
    return first.unionByName(decisions.rerank(top, listed).select("query_id", F.lit("levenshtein_aliases").alias("method"), "selected_id"))


SQL["baseline_decisions"] = TRI_TOP + """, ok AS (SELECT * FROM all_reps WHERE NOT is_alias OR rep_id NOT IN (SELECT query_id FROM q)),
s AS (SELECT t.query_id, t.canonical_id, max(1 - levenshtein(query_name, rep_name) / greatest(length(query_name), length(rep_name))) AS score FROM top t JOIN q ON q.query_id = t.query_id JOIN ok r ON r.canonical_id = t.canonical_id GROUP BY ALL)
SELECT query_id, 'retrieval_top1' AS method, canonical_id AS selected_id FROM top WHERE rank = 1
UNION ALL SELECT query_id, 'levenshtein_aliases', canonical_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_id) = 1"""


@query
def wratio_decisions(h: Host) -> DataFrame:
    """What the weighted ratio over names and permitted aliases selects from each shortlist."""
    top = cut(_top(h, h.names))
    allowed = h.aliases.join(h.queries.select(F.col("query_id").alias("id")), "id", "left_anti")
    return decisions.rerank(top, matching.score_listed(h.queries, matching.representations(h.freeform, allowed), top, tx.SCORERS["wratio"]))


@query
def operations_rollup(h: Host) -> DataFrame:
    """Orders as a log of requests by model; input tokens are missing in places, so their sum is null."""
    log = table(h.spark, h.sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 3 + 1).alias("attempts"), (F.col("o_totalprice").cast("double") / 1000).alias("seconds"), F.floor("o_totalprice").cast("long").alias("cost"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey").cast("long")).alias("input_tokens"), F.col("o_custkey").cast("long").alias("output_tokens"),
    )
    return _nine(decisions.operations(log).withColumn("models", F.array_join("models", ",")), "p50", "p95")


SQL["operations_rollup"] = """SELECT count(*) AS requests, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS cost, CASE WHEN count(*) FILTER (o_orderkey % 50 = 0) = 0 THEN CAST(sum(o_custkey) AS BIGINT) END AS input_tokens, CAST(sum(o_custkey) AS BIGINT) AS output_tokens,
  CAST(sum(o_orderkey % 3 + 1) AS BIGINT) AS attempts, round(quantile_cont(CAST(o_totalprice AS DOUBLE) / 1000, 0.5), 9) AS p50, round(quantile_cont(CAST(o_totalprice AS DOUBLE) / 1000, 0.95), 9) AS p95, (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders) AS models FROM orders"""


@query
def recount_check(h: Host) -> DataFrame:
    """Groups of a summary whose counts do not add up; one group's successes are made wrong."""
    top = _top(h, h.names).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical_id"))), lambda x: x["canonical_id"]).alias("top_ids")
    )
    cases = top.join(h.queries.select("query_id", F.col("canonical_id").alias("answer")), "query_id").select(
        "*", F.get("top_ids", F.lit(0)).alias("selected_id"), F.get("top_ids", F.lit(0)).alias("forced_id"),
        (F.col("query_id") % 5).alias("part")
    )
    s = decisions.summarize(decisions.outcomes(cases), ("part",))
    return decisions.recount_violations(s.withColumn("successes", F.col("successes") + (F.col("part") == 3).cast("int"))).select("part", "queries", "successes")


SQL["recount_check"] = TRI_TOP + "SELECT query_id % 5 AS part, count(*) AS queries, count(*) FILTER (top.canonical_id = q.canonical_id) + 1 AS successes FROM top JOIN q USING (query_id) WHERE rank = 1 AND query_id % 5 = 3 GROUP BY ALL"


# ----------------------------------------------------------------- review --
@query
def arm_diagnostics(h: Host) -> DataFrame:
    q = h.queries
    cases = q.select(
        F.when(F.col("query_id") % 3 == 0, "random").otherwise("screen").alias("arm"),
        F.when(F.col("query_id") % 10 == 1, F.concat(F.lit("é"), "query_name")).otherwise(F.col("query_name")).alias("name"),
        F.col("canonical_id").alias("template"),
        (F.col("canonical_id") + F.when(F.col("query_id") % 2 == 0, 20).otherwise(0)).alias("pooled"),
        (F.col("cached_count") % 4).alias("context_works"), F.col("cached_count").cast("double").alias("score")
    )
    found = review.arm_diagnostics(cases)
    return found.select(
        "arm", "cases", "agreement", "non_ascii", "with_context",
        *[F.get("score_quantiles", F.lit(k)).alias(f"score_p{p}") for k, p in enumerate((0, 25, 50, 75, 100))]
    )


SQL["arm_diagnostics"] = CTE + "SELECT CASE WHEN query_id % 3 = 0 THEN 'random' ELSE 'screen' END AS arm, count(*) AS cases, count(*) FILTER (query_id % 2 <> 0) AS agreement, count(*) FILTER (query_id % 10 = 1) AS non_ascii, count(*) FILTER (cached_count % 4 > 0) AS with_context, " + ", ".join(
    f"quantile_cont(CAST(cached_count AS DOUBLE), {p / 100}) AS score_p{p}" for p in (0, 25, 50, 75, 100)
) + " FROM q GROUP BY arm"


@query
def proposal_validation(h: Host) -> DataFrame:
    """Proposals by what is wrong with them; targets, names and sources are spoilt on purpose."""
    cases, _, p = _reviewed(h)
    i = F.col("source_id")
    rows = p.select(
        F.when(i % 17 == 0, i + 5_000_000).otherwise(i).alias("source_id"),
        F.when(i % 19 == 0, "other").otherwise(F.col("action")).alias("action"),
        F.when(i % 11 == 0, F.lit(-1)).otherwise(F.col("canonical_id")).alias("canonical_id"),
        F.when(i % 13 == 0, "x").otherwise("").alias("proposed_name")
    )
    known = h.freeform.unionByName(h.freeform.withColumn("id", F.col("id") + 20))  # the spoilt targets of _reviewed are known as well
    found = review.validate_proposals(rows, cases, known)
    return found.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("rows"))


SQL["proposal_validation"] = o.REVIEW + """, s AS (SELECT source_id AS i, CASE WHEN source_id % 17 = 0 THEN source_id + 5000000 ELSE source_id END AS source_id, CASE WHEN source_id % 19 = 0 AND action IS NOT NULL THEN 'other' ELSE action END AS action, CASE WHEN source_id % 11 = 0 THEN -1 ELSE target END AS target, source_id % 13 = 0 AS named FROM p WHERE action IS NOT NULL),
e AS (SELECT query_id AS source_id FROM q), known AS (SELECT id FROM ff UNION SELECT id + 20 FROM ff),
v AS (SELECT CASE WHEN e.source_id IS NULL THEN 'unknown source' WHEN s.source_id IS NULL THEN 'missing source' WHEN action = 'other' THEN 'unknown action' WHEN action = 'synonym' AND (target IS NULL OR target NOT IN (SELECT id FROM known) OR named) THEN 'synonym needs a known target only'
  WHEN action = 'new_canonical' AND target IS NOT NULL THEN 'new canonical has no target' WHEN action = 'abstain' AND (target IS NOT NULL OR named) THEN 'abstention has no target' ELSE 'valid' END AS problem FROM s FULL JOIN e USING (source_id))
SELECT problem, count(*) AS rows FROM v GROUP BY problem"""


@query
def baseline_proposals(h: Host) -> DataFrame:
    tops = h.queries.select(
        F.col("query_id").alias("source_id"), F.col("canonical_id").alias("template"),
        (F.col("canonical_id") + F.when(F.col("query_id") % 3 == 0, 20).otherwise(0)).alias("pooled")
    )
    out = None
    for method in ("always_template", "always_alias_max", "semantic_agreement_else_abstain"):
        one = review.baseline_proposals(tops, method).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("canonical_id", F.when(F.col("action") != "abstain", F.col("canonical_id")))


SQL["baseline_proposals"] = CTE + """, t AS (SELECT query_id AS source_id, canonical_id AS a, canonical_id + CASE WHEN query_id % 3 = 0 THEN 20 ELSE 0 END AS b FROM q)
SELECT source_id, 'synonym' AS action, a AS canonical_id, 'always_template' AS method FROM t UNION ALL SELECT source_id, 'synonym', b, 'always_alias_max' FROM t
UNION ALL SELECT source_id, CASE WHEN a = b THEN 'synonym' ELSE 'abstain' END, CASE WHEN a = b THEN b END, 'semantic_agreement_else_abstain' FROM t"""


@query
def shared_targets(h: Host) -> DataFrame:
    _, j, _ = _reviewed(h)
    return review.shared_targets(j.withColumn("partition", F.when(F.col("source_id") % 2 == 0, "calibration").otherwise("validation")))


SQL["shared_targets"] = o.REVIEW + "SELECT answer AS canonical_id FROM j WHERE source_id % 2 = 0 AND answer IS NOT NULL INTERSECT SELECT answer FROM j WHERE source_id % 2 <> 0 AND answer IS NOT NULL"


@query
def review_ordering(h: Host) -> DataFrame:
    random, screen = sampling.random_screen_partition(audit.unmerged(h.tags), "id", SEED, 40, 80)
    return sampling.review_order(random.select("id").unionByName(screen.select("id")), "id", SEED)


SQL["review_ordering"] = CTE + f", u AS (SELECT id FROM full_ WHERE NOT canonical AND visible AND merger_id IS NULL), r AS (SELECT id FROM u ORDER BY {o.h(SEED + ':random', 'id')}, id LIMIT 40), s AS (SELECT id FROM u WHERE id NOT IN (SELECT id FROM r) ORDER BY {o.h(SEED + ':screen', 'id')}, id LIMIT 80), a AS (SELECT * FROM r UNION ALL SELECT * FROM s) SELECT id, row_number() OVER (ORDER BY {o.h(SEED + ':review_order', 'id')}, id) AS position FROM a"


@query
def review_challenge(h: Host) -> DataFrame:
    """The six rules of a review's challenge set, over a screening sample scored by trigrams."""
    screen = cut(sampling.hash_sample(audit.unmerged(h.tags), "id", SEED + ":screen", 400).select("id", "name", "cached_count"))
    asked = screen.select(F.col("id").alias("query_id"), F.col("name").alias("query_name"))
    ranked = lambda reps: cut(matching.top_k(matching.max_pool(scoring.best_matches(asked, reps, "similarity"))))
    by_name, pooled = ranked(h.names), ranked(h.names_and_aliases)
    m = matching.margin(pooled).select(
        F.col("query_id").alias("id"), F.col("score").cast("double").alias("score"), F.col("margin").cast("double").alias("margin")
    )
    first = lambda r, c: r.filter("rank = 1").select(F.col("query_id").alias("id"), F.col("canonical_id").alias(c))
    supported = h.aliases.select(F.col("canonical_id").alias("a"), F.lit(True).alias("known")).distinct()
    rows = cut(screen.join(m, "id").join(first(by_name, "a"), "id").join(first(pooled, "b"), "id").join(supported, "a", "left"))
    always = F.lit(True)
    rules = [
        ("low_similarity", 20, always, F.col("score")), ("small_margin", 20, always, F.col("margin")),
        ("semantic_disagreement", 20, F.col("a") != F.col("b"), F.lit(0)),
        ("unsupported_name_target", 20, F.col("known").isNull(), F.lit(0)), ("high_usage", 10, always, -F.col("cached_count")),
        ("non_ascii", 10, ~tx.is_ascii("name"), F.lit(0))
    ]
    return sampling.quota_selection(rows, "id", SEED, rules).select("id", "selection_reason")


def _challenge_sql() -> str:
    asked = CTE.replace("reps AS (SELECT id AS rep_id", "unused AS (SELECT 1 AS one), reps AS (SELECT id AS rep_id", 1)
    sql = asked + f", sc AS (SELECT id, name, cached_count FROM full_ WHERE NOT canonical AND visible AND merger_id IS NULL ORDER BY {o.h(SEED + ':screen', 'id')}, id LIMIT 400), sq AS (SELECT id AS query_id, name AS query_name FROM sc)"
    for reps, name in (("reps", "ta"), ("all_reps", "tb")):
        sql += o.trigram(reps, name).replace("FROM q)", "FROM sq)")
        sql += f", top_{name} AS ({TOP.format(name)})"
    sql += """, mg AS (SELECT query_id AS id, max(score) FILTER (rank = 1) AS score, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM top_tb GROUP BY query_id),
f AS (SELECT sc.*, mg.score, mg.margin, a.canonical_id AS a, b.canonical_id AS b, a.canonical_id IN (SELECT canonical_id FROM al) AS known FROM sc JOIN mg USING (id) JOIN top_ta a ON a.query_id = id AND a.rank = 1 JOIN top_tb b ON b.query_id = id AND b.rank = 1)"""
    before: list[str] = []
    for label, n, eligible, priority in (
        ("low_similarity", 20, "true", "score"), ("small_margin", 20, "true", "margin"), ("semantic_disagreement", 20, "a <> b", "id - id"),
        ("unsupported_name_target", 20, "NOT known", "id - id"), ("high_usage", 10, "true", "-cached_count"),
        ("non_ascii", 10, "regexp_matches(name, '[^\\x00-\\x7F]')", "id - id")
    ):
        gone = " AND ".join(f"id NOT IN (SELECT id FROM k_{b})" for b in before) or "true"
        sql += f", f_{label} AS (SELECT id, '{label}' AS selection_reason FROM f WHERE {eligible} AND {gone} ORDER BY {priority}, {o.h(f'{SEED}:challenge:{label}', 'id')}, id LIMIT {n})"
        sql += f", k_{label} AS (SELECT * FROM (SELECT * FROM f_{label} UNION ALL SELECT id, '{label}_fallback' FROM f WHERE {gone} AND id NOT IN (SELECT id FROM f_{label})) QUALIFY row_number() OVER (ORDER BY selection_reason <> '{label}', {o.h(f'{SEED}:fallback:{label}', 'id')}, id) <= {n})"
        before.append(label)
    return sql + " " + " UNION ALL ".join(f"SELECT * FROM k_{b}" for b in before)


SQL["review_challenge"] = _challenge_sql()


@query
def review_profiles(h: Host) -> DataFrame:
    """Co-tags of the queries' own works, without a background."""
    p = Profiles(h)
    return profiles.associated_tags(profiles.sample_works(p.query_works()), p.context, None)


REVIEWED = o.PROFILE + """, rsm AS (SELECT profile, target, ordinal, row_number() OVER (PARTITION BY profile ORDER BY priority, ordinal) AS place FROM qw QUALIFY place <= 32),
rco AS (SELECT profile, type, tag_id, count(*) AS works FROM rsm JOIN ctx USING (ordinal) WHERE tag_id <> target GROUP BY ALL)
"""
SQL["review_profiles"] = REVIEWED + f"SELECT profile, type, tag_id, works, row_number() OVER (PARTITION BY profile, type ORDER BY works DESC, tag_id) AS place FROM rco WHERE works >= 2 QUALIFY place <= {o.LIMITS}"


@query
def slim_profiles(h: Host) -> DataFrame:
    own = Profiles(h).query_works()
    works = own.groupBy("profile").agg(F.array_sort(F.collect_list("ordinal")).alias("works"))
    return profiles.slim(profiles.accumulate(own).join(works, "profile"))


SQL["slim_profiles"] = o.PROFILE + o.accumulate("qw")


@query
def render_one_work(h: Host) -> DataFrame:
    """The view with co-tags of one work."""
    p = Profiles(h)
    own = p.candidate_works()
    one = profiles.joined_names(profiles.one_work(profiles.sample_works(own), p.context), h.catalogue, "type").groupBy("profile").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "names")))).alias("context")
    )
    base = h.freeform.select("id", "name").join(
        profiles.accumulate(own).withColumnRenamed("profile", "id"), "id", "left"
    ).join(one.withColumnRenamed("profile", "id"), "id", "left").withColumn("aliases", F.lit(""))
    return base.select("id", profiles.render("cotags").alias("view_one_work"))


def _one_work_sql() -> str:
    names = lambda kind: f"(SELECT string_agg(c.name, '; ' ORDER BY a.place) FROM one a JOIN catalogue c ON c.id = a.tag_id WHERE a.profile = f.id AND a.type = '{kind}' AND length(c.name) <= 160)"
    lines = [f"CASE WHEN n > 0 THEN 'Observed {k.lower()} context: ' || {names(k)} END" for k in ("Fandom", "Character", "Relationship", "Freeform")]
    return o.PROFILE + f", acc AS ({o.accumulate('mw')}) SELECT f.id, concat_ws(chr(10), 'Tag: ' || name || chr(10) || 'Type: Freeform', {', '.join(lines)}) AS view_one_work FROM ff f LEFT JOIN acc ON acc.profile = f.id"


SQL["render_one_work"] = _one_work_sql()


# ----------------------------------------------------- strata and intervals --
MARKS = r"[/&|()]"


def _name_strata() -> dict[str, Column]:
    n, size = F.col("cached_count"), F.char_length("query_name")
    return {
        "uses_5_to_9": n < 10, "uses_10_to_99": (n >= 10) & (n < 100), "uses_at_least_100": n >= 100, "name_at_most_20_chars": size <= 20, "name_21_to_50_chars": (size > 20) & (size <= 50), "name_over_50_chars": size > 50,
        "contains_non_ascii": ~tx.is_ascii("query_name"), "ascii_only": tx.is_ascii("query_name"), "contains_slash_ampersand_pipe_or_parenthesis": F.col("query_name").rlike(MARKS),
    }


@query
def name_strata(h: Host) -> DataFrame:
    rows = _trigram_ranks(h, h.names).join(h.queries.select("query_id", "query_name", "cached_count"), "query_id")
    return _nine(metrics.by_strata(rows, _name_strata()), "recall_1", "recall_3", "recall_5", "recall_10")


def _strata_sql(rows: str, flags: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS stratum, {o.recall()} FROM {rows} WHERE {v} HAVING count(*) > 0" for k, v in flags.items())


NAME_FLAGS = {
    "uses_5_to_9": "cached_count < 10", "uses_10_to_99": "cached_count BETWEEN 10 AND 99", "uses_at_least_100": "cached_count >= 100", "name_at_most_20_chars": "length(query_name) <= 20", "name_21_to_50_chars": "length(query_name) BETWEEN 21 AND 50", "name_over_50_chars": "length(query_name) > 50",
    "contains_non_ascii": "regexp_matches(query_name, '[^\\x00-\\x7F]')", "ascii_only": "NOT regexp_matches(query_name, '[^\\x00-\\x7F]')", "contains_slash_ampersand_pipe_or_parenthesis": "regexp_matches(query_name, '[/&|()]')",
}
SQL["name_strata"] = CTE + o.TRI + o.rank("tri", "r") + ", x AS (SELECT r.*, query_name, cached_count FROM r JOIN q USING (query_id)) " + _strata_sql("x", NAME_FLAGS)


@query
def coverage_strata(h: Host) -> DataFrame:
    """Recall by how much is known of the query's works, its target's works and its target's aliases."""
    p = Profiles(h)
    count = lambda works, key: works.groupBy("profile").agg(F.count("*").alias(key))
    own = profiles.select_aliases(h.aliases, p.blocked).select(F.col("canonical_id").alias("t"), F.lit(True).alias("has_aliases")).distinct()
    rows = _trigram_ranks(h, h.names).join(h.queries.select("query_id", "query_name", F.col("canonical_id").alias("t")), "query_id")
    rows = rows.join(
        count(p.query_works(), "qn").withColumnRenamed("profile", "query_id"), "query_id", "left"
    ).join(count(p.candidate_works(), "cn").withColumnRenamed("profile", "t"), "t", "left").join(own, "t", "left")
    q, c, known = F.coalesce("qn", F.lit(0)), F.coalesce("cn", F.lit(0)), F.coalesce("has_aliases", F.lit(False))
    strata = {
        "all": F.lit(True), "query_no_works": q == 0, "target_has_selected_aliases": known, "target_has_no_selected_aliases": ~known, "query_has_any_work": q > 0, "query_1_to_2_works": (q > 0) & (q < 3),
        "query_3_to_9_works": (q >= 3) & (q < 10), "query_at_least_10_works": q >= 10, "both_sides_at_least_3_works": (q >= 3) & (c >= 3), "non_ascii": ~tx.is_ascii("query_name"),
    }
    return _nine(metrics.by_strata(rows, strata), "recall_1", "recall_3", "recall_5", "recall_10")


COVERAGE_FLAGS = {
    "all": "true", "query_no_works": "qn = 0", "target_has_selected_aliases": "known", "target_has_no_selected_aliases": "NOT known", "query_has_any_work": "qn > 0", "query_1_to_2_works": "qn BETWEEN 1 AND 2",
    "query_3_to_9_works": "qn BETWEEN 3 AND 9", "query_at_least_10_works": "qn >= 10", "both_sides_at_least_3_works": "qn >= 3 AND cn >= 3", "non_ascii": "regexp_matches(query_name, '[^\\x00-\\x7F]')",
}
SQL["coverage_strata"] = o.PROFILE + o.TRI + o.rank("tri", "r") + """, x AS (SELECT r.*, q.query_name, (SELECT count(*) FROM qw WHERE profile = q.query_id) AS qn, (SELECT count(*) FROM mw WHERE profile = q.canonical_id) AS cn, q.canonical_id IN (SELECT canonical_id FROM pal) AS known FROM r JOIN q USING (query_id)) """ + _strata_sql("x", COVERAGE_FLAGS)


@query
def adjudication_strata(h: Host) -> DataFrame:
    """Outcomes of the first choice by whether the target has aliases that could be shown."""
    top = _top(h, h.names).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical_id"))), lambda x: x["canonical_id"]).alias("top_ids")
    )
    own = profiles.select_aliases(h.aliases, h.queries.select(F.col("query_id").alias("id"))).select(
        F.col("canonical_id").alias("answer"), F.lit(True).alias("known")
    ).distinct()
    cases = top.join(h.queries.select("query_id", F.col("canonical_id").alias("answer")), "query_id").join(own, "answer", "left")
    cases = cases.select(
        "query_id", "answer", "top_ids", F.get("top_ids", F.lit(0)).alias("selected_id"), F.get("top_ids", F.lit(0)).alias("forced_id"),
        F.coalesce("known", F.lit(False)).alias("target_has_aliases")
    )
    s = decisions.summarize(decisions.outcomes(cases), ("target_has_aliases",))
    return _nine(
        s.select("target_has_aliases", "queries", "present", "successes", "overall_success", "conditional_success"), "overall_success",
        "conditional_success"
    )


SQL["adjudication_strata"] = o.PROFILE + o.TRI + f", top AS ({TOP.format('tri')}), x AS (SELECT q.canonical_id IN (SELECT canonical_id FROM pal) AS target_has_aliases, max(CASE WHEN top.canonical_id = q.canonical_id THEN 1 ELSE 0 END) AS present, max(CASE WHEN rank = 1 AND top.canonical_id = q.canonical_id THEN 1 ELSE 0 END) AS ok FROM top JOIN q USING (query_id) GROUP BY query_id, q.canonical_id) SELECT target_has_aliases, count(*) AS queries, CAST(sum(present) AS BIGINT) AS present, CAST(sum(ok) AS BIGINT) AS successes, round(sum(ok) / count(*), 9) AS overall_success, round(sum(ok) / nullif(sum(present), 0), 9) AS conditional_success FROM x GROUP BY target_has_aliases"


@query
def paired_bootstrap(h: Host) -> DataFrame:
    """Difference of the hits at 1 by trigrams and by edit distance, and its interval over resampled canonicals."""
    a, b = _trigram_ranks(h, h.names), scoring.expected_ranks(h.queries, h.names, "levenshtein")
    rows = a.select("query_id", "canonical_id", metrics.hit("expected_rank", 1).cast("int").alias("x")).join(
        b.select("query_id", metrics.hit("expected_rank", 1).cast("int").alias("y")), "query_id"
    )
    return _nine(metrics.drawn_bootstrap(rows, "canonical_id", F.col("x") - F.col("y"), 500), "mean", "low", "high")


SQL["paired_bootstrap"] = CTE + o.TRI + o.LEV + o.rank("tri", "ra") + o.rank("lev", "rb") + """, z AS (SELECT ra.canonical_id, CAST(ra.expected_rank = 1 AS INTEGER) - CAST(rb.expected_rank = 1 AS INTEGER) AS d FROM ra JOIN rb USING (query_id)),
g AS (SELECT row_number() OVER (ORDER BY canonical_id) - 1 AS i, s, n FROM (SELECT canonical_id, CAST(sum(d) AS DOUBLE) AS s, count(*) AS n FROM z GROUP BY canonical_id)),
draw AS (SELECT r, CAST('0x' || substr(sha256('bootstrap-v1:' || r || ':' || j), 1, 12) AS BIGINT) % (SELECT count(*) FROM g) AS i FROM range(500) a(r), range((SELECT count(*) FROM g)) b(j)),
m AS (SELECT r, sum(s) / sum(n) AS m FROM draw JOIN g USING (i) GROUP BY r) SELECT (SELECT round(sum(s) / sum(n), 9) FROM g) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"""


@query
def score_quantiles(h: Host) -> DataFrame:
    return _nine(metrics.quantiles(h.synonyms.select(tx.levenshtein_similarity("name", "canonical_name").alias("s")), "s"), "p0", "p25", "p50", "p75", "p100")


SQL["score_quantiles"] = CTE + ", s AS (SELECT CAST(1 - levenshtein(name, canonical_name) / greatest(length(name), length(canonical_name)) AS DOUBLE) AS s FROM syn) SELECT " + ", ".join(
    f"round(quantile_cont(s, {p / 100}), 9) AS p{p}" for p in (0, 25, 50, 75, 100)
) + " FROM s"


@query
def replay_agreement(h: Host) -> DataFrame:
    """Rows of two rankings that only one of them has."""
    pick = lambda reps: _top(h, reps).select("query_id", "canonical_id", "rank")
    return h.spark.createDataFrame([(metrics.replay_agreement(cut(pick(h.names)), cut(pick(h.names_and_aliases))),)], "differences bigint")


SQL["replay_agreement"] = CTE + o.TRI + o.TRIA + f", a AS (SELECT query_id, canonical_id, rank FROM ({TOP.format('tri')})), b AS (SELECT query_id, canonical_id, rank FROM ({TOP.format('tria')})) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS differences"


# ------------------------------------------------------------------ names --
@query
def shortlist_names(h: Host) -> DataFrame:
    found = matching.listed_names(_top(h, h.names), h.freeform)
    return found.select("query_id", F.array_join("names", " | ").alias("names"))


SQL["shortlist_names"] = TRI_TOP + "SELECT query_id, string_agg(name, ' | ' ORDER BY rank) AS names FROM top JOIN ff ON id = canonical_id WHERE rank <= 3 GROUP BY query_id"


@query
def margin_feature(h: Host) -> DataFrame:
    m = matching.margin(_top(h, h.names_and_aliases))
    return m.select("query_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("score", "margin")])


SQL["margin_feature"] = CTE + o.TRIA + f", top AS ({TOP.format('tria')}) SELECT query_id, round(CAST(max(score) FILTER (rank = 1) AS DOUBLE), 5) AS score, round(CAST(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS DOUBLE), 5) AS margin FROM top GROUP BY query_id"


@query
def changed_hits(h: Host) -> DataFrame:
    return matching.changed_hits(_trigram_ranks(h, h.names), scoring.expected_ranks(h.queries, h.names, "levenshtein"), SEED + ":errors", 1)


SQL["changed_hits"] = CTE + o.TRI + o.LEV + o.rank("tri", "ra") + o.rank("lev", "rb") + f"SELECT query_id, CASE WHEN ra.expected_rank = 1 THEN 'gain' ELSE 'loss' END AS change, row_number() OVER (PARTITION BY change ORDER BY {o.h(SEED + ':errors', 'query_id')}, query_id) AS place FROM ra JOIN rb USING (query_id) WHERE (ra.expected_rank = 1) <> (rb.expected_rank = 1) QUALIFY place <= 5"


@query
def pilot_ranking(h: Host) -> DataFrame:
    """Shortlists ranked again with ties by name, as in the pilot."""
    top = _top(h, h.names).drop("rank").join(h.freeform.select(F.col("id").alias("canonical_id"), F.col("name").alias("canonical_name")), "canonical_id")
    return matching.top_k(top, 10, "canonical_name").select("query_id", "canonical_id", "rank")


SQL["pilot_ranking"] = TRI_TOP + "SELECT query_id, canonical_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM top JOIN ff ON id = canonical_id"


@query
def pilot_split(h: Host) -> DataFrame:
    return h.tags.select("id", group_split(SEED, "name").alias("split"))


SQL["pilot_split"] = CTE + f"SELECT id, {o.split('name')} AS split FROM tag"


@query
def pool_sizes(h: Host) -> DataFrame:
    return audit.pool_sizes(h.queries, "canonical_id")


SQL["pool_sizes"] = CTE + "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM q GROUP BY canonical_id) GROUP BY size"


@query
def alias_search(h: Host) -> DataFrame:
    """A search for words over names and aliases, and one for an id."""
    rows = matching.search_names(h.freeform, h.aliases, " Brand#1 MY ")
    some = matching.search_names(h.freeform, h.aliases, "#21")
    return rows.withColumn("asked", F.lit("words")).unionByName(some.withColumn("asked", F.lit("id")))


SQL["alias_search"] = CTE + """, t AS (SELECT ff.id, ff.name, lower(ff.name || coalesce(' ' || (SELECT string_agg(a.name, ' ' ORDER BY a.name) FROM al a WHERE a.canonical_id = ff.id), '')) AS all_names FROM ff),
f AS (SELECT id, name FROM t WHERE contains(all_names, 'brand#1') AND contains(all_names, 'my'))
SELECT id, name, (SELECT count(*) FROM f) AS matches, 'words' AS asked FROM (SELECT * FROM f ORDER BY id LIMIT 100) UNION ALL SELECT id, name, 1, 'id' FROM ff WHERE id = 21"""


@query
def name_chains(h: Host) -> DataFrame:
    """Chains keyed by names: where each linked name ends, for the links that end."""
    good = h.resolved.filter("status <> 'CYCLE'").select("id")
    linked = h.tags.join(good, "id").filter("merger_id IS NOT NULL AND NOT canonical")
    label = lambda c: F.concat(F.lit("tag "), F.col(c).cast("string"))
    return graph.resolve_names(linked.select(label("id").alias("from_tag"), label("merger_id").alias("to_tag")))


SQL["name_chains"] = CTE + """, e AS (SELECT id, merger_id FROM tag JOIN resolved USING (id) WHERE status <> 'CYCLE' AND merger_id IS NOT NULL AND NOT canonical),
w AS (SELECT id, merger_id AS cur, 1 AS n FROM e UNION ALL SELECT w.id, e.merger_id, n + 1 FROM w JOIN e ON e.id = w.cur)
SELECT 'tag ' || id AS from_tag, 'tag ' || arg_max(cur, n) AS canonical, CAST(max(n) AS BIGINT) AS hops FROM w GROUP BY id"""


@query
def edge_conflicts(h: Host) -> DataFrame:
    """Parts that several suppliers deliver: a source with several targets."""
    return graph.conflicting_edges(table(h.spark, h.sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


SQL["edge_conflicts"] = "SELECT l_partkey, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY l_partkey HAVING targets > 1"


@query
def duplicate_keys(h: Host) -> DataFrame:
    return graph.duplicate_keys(table(h.spark, h.sf_dir, "lineitem").select("l_orderkey"), "l_orderkey").withColumnRenamed("count", "rows")


SQL["duplicate_keys"] = "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING rows > 1"


@query
def escaped_json(h: Host) -> DataFrame:
    t = F.concat(F.lit("<a href='x&y'>"), "name", F.lit("</a>"))
    return h.tags.select("id", tx.html_safe(t).alias("escaped"))


SQL["escaped_json"] = CTE + "SELECT id, replace(replace(replace('<a href=''x&y''>' || name || '</a>', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS escaped FROM tag"


@query
def safe_punctuation(h: Host) -> DataFrame:
    """Names with marks and letters beyond ASCII, in all modes: marks between letters become plain, others stay."""
    k = F.col("id") % 4
    mark = F.when(k == 0, "’").when(k == 1, "‐").when(k == 2, "‑").otherwise("‘")
    t = F.concat(F.lit("É"), mark, F.lit("A  "), mark, F.lit(" "), F.regexp_replace("name", "[ ]", " "), mark)
    return h.tags.select("id", *[tx.normalize(t, m).alias(m) for m in tx.MODES])


SQL["safe_punctuation"] = CTE + """, m AS (SELECT id, name, CASE id % 4 WHEN 0 THEN '’' WHEN 1 THEN '‐' WHEN 2 THEN '‑' ELSE '‘' END AS mark, CASE WHEN id % 4 IN (0, 3) THEN '''' ELSE '-' END AS plain FROM tag)
SELECT id, 'É' || mark || 'A  ' || mark || ' ' || replace(name, ' ', chr(8201)) || mark AS raw, 'é' || mark || 'a  ' || mark || ' ' || replace(lower(name), ' ', chr(8201)) || mark AS casefold,
  'é' || mark || 'a ' || mark || ' ' || lower(name) || mark AS whitespace, 'é' || plain || 'a ' || mark || ' ' || lower(name) || mark AS safe_punctuation FROM m"""


@query
def type_collisions(h: Host) -> DataFrame:
    """Case-folded first words that several canonicals share."""
    reps = matching.representations(h.catalogue.withColumn("name", F.substring_index("name", " ", 1)))
    return matching.collisions(reps, lambda c: tx.normalize(c, "casefold"))


SQL["type_collisions"] = CTE + "SELECT lower(split_part(name, ' ', 1)) AS key, count(DISTINCT id) AS targets FROM catalogue GROUP BY key HAVING targets > 1"


# ---------------------------------------------------------- planted errors --
@query
def planted_order_errors(h: Host) -> DataFrame:
    """Broken neighbours of rankings in which the first two places of every third query are exchanged."""
    top = _top(h, h.names)
    swap = F.when((F.col("query_id") % 3 == 0) & (F.col("rank") <= 2), 3 - F.col("rank")).otherwise(F.col("rank"))
    return matching.order_violations(top.withColumn("rank", swap.cast("long"))).select("query_id", "canonical_id", "rank")


SQL["planted_order_errors"] = TRI_TOP + ", s AS (SELECT query_id, canonical_id, score, CASE WHEN query_id % 3 = 0 AND rank <= 2 THEN 3 - rank ELSE rank END AS rank FROM top), l AS (SELECT *, lag(score) OVER w AS ps, lag(canonical_id) OVER w AS pi FROM s WINDOW w AS (PARTITION BY query_id ORDER BY rank)) SELECT query_id, canonical_id, CAST(rank AS BIGINT) AS rank FROM l WHERE ps < score OR (ps = score AND pi >= canonical_id)"


@query
def planted_membership_errors(h: Host) -> DataFrame:
    """The membership check where every fourth query's rank field says one too few."""
    r = _trigram_ranks(h, h.names).withColumn("expected_rank", F.col("expected_rank") - (F.col("query_id") % 4 == 0).cast("int"))
    return metrics.membership_recheck(r, _top(h, h.names))


SQL["planted_membership_errors"] = TRI_TOP + o.rank("tri", "r") + ", z AS (SELECT r.query_id, CASE WHEN r.query_id % 4 = 0 THEN r.expected_rank - 1 ELSE r.expected_rank END AS said, (SELECT min(rank) FROM top WHERE top.query_id = r.query_id AND top.canonical_id = r.canonical_id) AS true_rank FROM r) SELECT count(*) AS queries, " + ", ".join(
    f"count(*) FILTER ((said BETWEEN 1 AND {k}) <> coalesce(true_rank <= {k}, false)) AS disagree_{k}" for k in (1, 3, 5, 10)
) + " FROM z"


@query
def planted_snapshot_errors(h: Host) -> DataFrame:
    """Broken rules of a snapshot with repeated, renamed and lost rows."""
    from ..operators import snapshot

    cat = h.freeform.withColumn("split", group_split(SEED, "id"))
    al = h.aliases.withColumn("split", group_split(SEED, "canonical_id"))
    cat = cat.filter("id % 7 <> 0").unionByName(cat.filter("id % 100 = 1"))
    al = al.withColumn("canonical_name", F.when(F.col("id") % 5 == 0, F.upper("canonical_name")).otherwise(F.col("canonical_name")))
    ex = h.queries.select(
        F.when(F.col("query_id") % 9 == 0, -F.col("query_id")).otherwise(F.col("query_id")).alias("query_id"),
        F.when(F.col("query_id") % 8 == 0, "x").otherwise(F.col("query_name")).alias("query_name"), "canonical_id",
        F.lit("synonym").alias("kind")
    )
    return snapshot.violations(cat, al, ex)


SQL["planted_snapshot_errors"] = CTE + f""", c0 AS (SELECT id, name, {o.split('id')} AS split FROM ff WHERE id % 7 <> 0), c AS (SELECT * FROM c0 UNION ALL SELECT id, name, {o.split('id')} FROM ff WHERE id % 100 = 1),
a AS (SELECT id, name, canonical_id, CASE WHEN id % 5 = 0 THEN upper(canonical_name) ELSE canonical_name END AS canonical_name, {o.split('canonical_id')} AS split FROM al),
j AS (SELECT a.*, c.name AS t_name, c.split AS t_split FROM a LEFT JOIN c ON c.id = a.canonical_id),
e AS (SELECT CASE WHEN query_id % 9 = 0 THEN -query_id ELSE query_id END AS query_id, CASE WHEN query_id % 8 = 0 THEN 'x' ELSE query_name END AS query_name, canonical_id FROM q), s AS (SELECT e.*, a.name AS a_name, a.canonical_id AS a_target FROM e LEFT JOIN a ON a.id = e.query_id),
v AS (SELECT 'repeated catalogue id' AS rule, (SELECT count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1)) AS rows UNION ALL SELECT 'repeated alias id', (SELECT count(*) FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1)) UNION ALL SELECT 'alias is canonical', (SELECT count(*) FROM a WHERE id IN (SELECT id FROM c))
UNION ALL SELECT 'alias without target', (SELECT count(*) FROM j WHERE t_name IS NULL) UNION ALL SELECT 'alias disagrees with its target', (SELECT count(*) FROM j WHERE t_name IS NOT NULL AND (canonical_name IS DISTINCT FROM t_name OR split IS DISTINCT FROM t_split))
UNION ALL SELECT 'example without alias', (SELECT count(*) FROM s WHERE a_name IS NULL) UNION ALL SELECT 'example disagrees with its alias', (SELECT count(*) FROM s WHERE a_name IS NOT NULL AND (query_name <> a_name OR canonical_id <> a_target)))
SELECT * FROM v WHERE rows > 0"""


@query
def planted_profile_errors(h: Host) -> DataFrame:
    """Rules that profiles break after bands, words and targets are spoilt."""
    p = Profiles(h)
    own = p.candidate_works()
    sample = profiles.sample_works(own, 1)
    acc = profiles.accumulate(own).withColumn("band_0", F.col("band_0") + (F.col("profile") % 3 == 0).cast("int")).withColumn(
        "n", F.when(F.col("profile") % 5 == 0, F.lit(0)).otherwise(F.col("n"))
    )
    assoc = sample.select("profile", F.lit("Freeform").alias("type"), F.when(F.col("profile") % 2 == 0, F.col("target")).otherwise(F.lit(-1)).alias("tag_id"))
    return profiles.profile_violations(acc, sample, assoc)


SQL["planted_profile_errors"] = o.PROFILE + f", a AS ({o.accumulate('mw')}) SELECT count(*) FILTER (profile % 3 = 0) AS bands, count(*) FILTER (profile % 5 = 0 AND words_n > 0) AS words, 0::BIGINT AS sample, count(*) FILTER (profile % 2 = 0) AS own_tag FROM a"


# ------------------------------------------------------- sources and sinks --
@query
def tag_csv(h: Host) -> DataFrame:
    """The tag dump, written as CSV and read back by its schema."""
    path = shared_path(h.spark, "tag-csv")
    own = h.tags.select(
        "id", "type", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(', "x"'))).otherwise(F.col("name")).alias("name"), "canonical",
        "cached_count", "merger_id"
    )
    src.write_table(own.coalesce(1), path, "csv")
    return src.read_tags(h.spark, path)


SQL["tag_csv"] = CTE + "SELECT id, type, CASE WHEN id % 3 = 0 THEN name || ', \"x\"' ELSE name END AS name, canonical, cached_count, merger_id FROM tag"


@query
def works_csv(h: Host) -> DataFrame:
    """The works dump, written as CSV in order and read back with its ordinals."""
    path = shared_path(h.spark, "works-csv")
    held = h.work_tags.groupBy("ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag_id")), lambda x: x.cast("string")), "+").alias("tags"))
    own = h.works.join(held, "ordinal", "left").orderBy("ordinal").coalesce(1)
    own = own.select(
        F.col("creation_date").cast("string").alias("creation date"), "language", "restricted", "complete",
        F.coalesce(F.col("word_count").cast("string"), F.lit("")).alias("word_count"), F.coalesce("tags", F.lit("")).alias("tags"),
        F.lit("").alias(" ")
    )
    src.write_table(own, path, "csv", emptyValue="")
    r = src.read_works(h.spark, path)
    return r.select(
        "ordinal", F.col("creation_date").cast("string").alias("creation_date"), "language", "restricted", "complete", "word_count",
        _ids("tags").alias("tags")
    )


SQL["works_csv"] = CTE + ", w AS (SELECT * FROM work) SELECT row_number() OVER (ORDER BY ordinal) AS ordinal, CAST(creation_date AS VARCHAR) AS creation_date, language, restricted, complete, word_count, coalesce((SELECT string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY tag_id) FROM wt WHERE wt.ordinal = w.ordinal), '') AS tags FROM w"


@query
def xml_tags(h: Host) -> DataFrame:
    path = shared_path(h.spark, "tags-xml")
    rows = h.tags.select(F.col("id").alias("_Id"), F.col("name").alias("_TagName"), F.col("cached_count").alias("_Count"), F.lit("").alias("v"))
    rows.write.format("xml").option("rowTag", "row").option("rootTag", "tags").option("attributePrefix", "_").save(path)
    return src.read_xml_tags(h.spark, path)


SQL["xml_tags"] = CTE + "SELECT id, name, cached_count AS question_count FROM tag"


@query
def vector_formats(h: Host) -> DataFrame:
    """Vectors through base64 and JSON and back."""

    @F.pandas_udf("string")
    def packed(s: pd.Series) -> pd.Series:
        import base64

        return s.map(lambda v: base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())

    e = table(h.spark, h.sf_dir, "embeddings").select("vec_id", "embedding")
    a = src.decode_base64_vectors(e.withColumn("embedding", packed("embedding")), dimensions=64)
    b = src.decode_json_vectors(e.withColumn("embedding", F.to_json("embedding")), dimensions=64).withColumnRenamed("embedding", "again")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return a.join(b, "vec_id").select("vec_id", F.round(total, 6).alias("total"), (F.col("embedding") == F.col("again")).alias("same"))


SQL["vector_formats"] = "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, true AS same FROM embeddings"


@query
def ranking_files(h: Host) -> DataFrame:
    """Rankings written as gzipped JSON lines with their sidecar, and read back."""
    path = shared_path(h.spark, "rankings")
    src.write_rankings(_top(h, h.names).select("query_id", "canonical_id", "rank"), path, {"method": "trigram"})
    rows, about = src.read_rankings(h.spark, path, "query_id bigint, canonical_id bigint, rank bigint")
    return rows.withColumn("method", F.lit(about["method"]))


SQL["ranking_files"] = TRI_TOP + "SELECT query_id, canonical_id, rank, 'trigram' AS method FROM top"


@query
def answers_by_index(h: Host) -> DataFrame:
    """Responses that came in another order, brought to their requests by index."""
    t = src.distinct_texts(table(h.spark, h.sf_dir, "benchmark"))
    n = t.count()
    asked = t.select(F.col("text_id"), F.octet_length("text").alias("bytes"))
    ordered = asked.groupBy().agg(F.array_sort(F.collect_list("text_id")).alias("all")).select(F.posexplode("all").alias("index", "text_id"))  # the benchmark's items
    answers = ordered.join(asked, "text_id").select("index", "bytes")
    return src.by_index(answers.orderBy(F.desc("index")), ordered, n).select("text_id", F.col("bytes").cast("long").alias("bytes"))


SQL["answers_by_index"] = "SELECT sha256(text) AS text_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM (SELECT DISTINCT text FROM benchmark)"


# ------------------------------------------------------------------ pages --
def _page_sql() -> str:
    plain = "html"
    for pattern in ("<script.*?</script>", "<style.*?</style>", "<!--.*?-->", "<[^>]*>"):
        plain = f"regexp_replace({plain}, '{pattern}', ' ', 'gs')"
    decoded = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
    folded = lambda x: f"trim(regexp_replace({decoded(x)}, '\\s+', ' ', 'g'))"
    first = lambda tag: f"{folded(f"regexp_extract(html, '<{tag}[^>]*>(.*?)</{tag}>', 1, 's')")}"
    return f"SELECT page_id, {first('title')} AS title, {first('h1')} AS heading, CAST(length({folded(plain)}) AS BIGINT) AS text_chars, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS BIGINT) AS headings, CAST(NULL AS VARCHAR) AS work FROM pages"


SQL["page_metadata"] = _page_sql()


@query
def work_pages(h: Host) -> DataFrame:
    """Work pages made of orders, and what is read from them: tags by type, numbers, chapters."""
    from ..operators import pages

    rows = table(h.spark, h.sf_dir, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("Work &amp; "), k)
    html = F.concat(
        F.lit('<html><h2 class="title heading"> '), name, F.lit(
            ' </h2><dl class="work meta group"><dd class="fandom tags"><ul><li><a class="tag" href="/tags/1">A  <i>b</i></a></li></ul></dd><dd class="freeform tags"><a class="tag" href="/tags/2">c'
        ), k,
        F.lit('</a></dd><dd class="language">English</dd><dd class="stats"><dl class="stats"><dd class="words">'), F.format_number(F.floor("o_totalprice"), 0), F.lit(
            '</dd><dd class="hits">7</dd></dl></dd></dl><script>var x = "<b>";</script><div class="chapter" id="chapter-1"><a href="/works/'
        ), k,
        F.lit("/chapters/3\">next</a></p></div></html>"),
    )
    spoilt = F.when(F.col("o_orderkey") % 10 == 0, F.lit("<html>please log in</html>")).otherwise(html)
    found = pages.page_metadata(rows.select("o_orderkey", spoilt.alias("html"))).select("o_orderkey", "work")
    path = lambda p: F.get_json_object("work", p)
    return found.select(
        "o_orderkey", path("$.work_id").cast("bigint").alias("work_id"), path("$.title").alias("title"),
        path("$.language").alias("language"), path("$.tags.Fandom[0].name").alias("fandom"),
        path("$.tags.Freeform[0].name").alias("freeform"), path("$.stats.words").cast("bigint").alias("words"),
        path("$.stats.kudos").cast("bigint").alias("kudos"), path("$.chapter_urls[0]").alias("chapter")
    )


SQL["work_pages"] = """SELECT o_orderkey, CASE WHEN ok THEN CAST(o_orderkey AS BIGINT) END AS work_id, CASE WHEN ok THEN 'Work & ' || o_orderkey END AS title, CASE WHEN ok THEN 'English' END AS language, CASE WHEN ok THEN 'A b' END AS fandom, CASE WHEN ok THEN 'c' || o_orderkey END AS freeform,
  CASE WHEN ok THEN CAST(floor(o_totalprice) AS BIGINT) END AS words, CAST(NULL AS BIGINT) AS kudos, CASE WHEN ok THEN '/works/' || o_orderkey || '/chapters/3' END AS chapter FROM (SELECT *, o_orderkey % 10 <> 0 AS ok FROM orders)"""


@query
def running_profiles(h: Host) -> DataFrame:
    """Profile sums over a stream of works, run to the end of what there is."""
    from ..streaming import replay

    spark, path = h.spark, shared_path(h.spark, "stream")
    own = Profiles(h).candidate_works().select("profile", "word_count", "complete", "restricted")
    own.write.parquet(f"{path}/in")
    name = "profiles_" + path.rsplit("-", 1)[-1]
    stream = replay.running_profiles(spark.readStream.schema(own.schema).parquet(f"{path}/in"))
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


SQL["running_profiles"] = o.PROFILE + "SELECT profile, n, words_n, band_0, band_1, band_2, band_3, complete, restricted FROM (" + o.accumulate("mw") + ")"


# --------------------------------------------------- scorers' twins in SQL --
def _extents(whole_words: bool) -> str:
    """Runs of trigrams (or of whole words): every start and end, its distinct trigrams, and how many of the query's are among them."""
    words = "[w for w in string_split_regex(lower({0}), '[^a-z0-9]+') if w <> '']"
    sql = CTE + f""", nw AS (SELECT rep_id, canonical_id, unnest({words.format('rep_name')}) AS w, generate_subscripts({words.format('rep_name')}, 1) AS wi FROM reps),
np0 AS (SELECT rep_id, canonical_id, wi, unnest(range(1, length(w) + 2)) AS k, '  ' || w || ' ' AS p FROM nw),
np1 AS (SELECT rep_id, canonical_id, wi, substr(p, CAST(k AS INTEGER), 3) AS g, row_number() OVER (PARTITION BY rep_id ORDER BY wi, k) AS pos FROM np0),
np AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY rep_id, g ORDER BY pos), 0) AS prev FROM np1),
qg AS (SELECT query_id, unnest({o.GRAMS.format('query_name')}) AS g FROM q), qn AS (SELECT query_id, len({o.GRAMS.format('query_name')}) AS nq FROM q),
"""
    if whole_words:
        sql += """b AS (SELECT rep_id, wi, min(pos) AS lo, max(pos) AS hi FROM np GROUP BY ALL), x AS (SELECT s.rep_id, s.lo AS a, e.hi AS z FROM b s JOIN b e ON s.rep_id = e.rep_id AND e.wi >= s.wi),
d AS (SELECT x.rep_id, a, z, count(*) AS seen FROM x JOIN np ON np.rep_id = x.rep_id AND pos BETWEEN a AND z AND prev < a GROUP BY ALL),
sh AS (SELECT query_id, np.rep_id, pos, prev FROM np JOIN qg USING (g)),
c AS (SELECT query_id, x.rep_id, a, z, count(*) AS c FROM x JOIN sh ON sh.rep_id = x.rep_id AND pos BETWEEN a AND z AND prev < a GROUP BY ALL),
"""
    else:
        sql += """d AS (SELECT s.rep_id, s.pos AS a, e.pos AS z, count(*) AS seen FROM np s JOIN np e ON s.rep_id = e.rep_id AND e.pos >= s.pos JOIN np p ON p.rep_id = s.rep_id AND p.pos BETWEEN s.pos AND e.pos AND p.prev < s.pos GROUP BY ALL),
sh AS (SELECT query_id, np.rep_id, pos, prev FROM np JOIN qg USING (g)),
c AS (SELECT s.query_id, s.rep_id, s.pos AS a, e.pos AS z, count(*) AS c FROM sh s JOIN sh e ON s.query_id = e.query_id AND s.rep_id = e.rep_id AND e.pos >= s.pos JOIN sh p ON p.query_id = s.query_id AND p.rep_id = s.rep_id AND p.pos BETWEEN s.pos AND e.pos AND p.prev < s.pos GROUP BY ALL),
"""
    sql += """best AS (SELECT query_id, rep_id, max(CAST(c / (nq + seen - c) AS DOUBLE)) AS s FROM c JOIN d USING (rep_id, a, z) JOIN qn USING (query_id) GROUP BY ALL),
ext AS (SELECT q.query_id, r.canonical_id, CAST(coalesce(s, 0) AS FLOAT) AS score FROM q JOIN reps r ON true LEFT JOIN best ON best.query_id = q.query_id AND best.rep_id = r.rep_id) """
    return sql + o.RETURN_TOP.format(TOP.format("ext"))


SQL["word_similarity_topk"] = _extents(False)
SQL["strict_word_similarity_topk"] = _extents(True)


def _wratio(pairs: str) -> str:
    """CTEs up to ``wr`` (query_id, canonical_id, score) over pairs (query_id, canonical_id, rep_id, a, b); common subsequences by bit vectors."""
    words = "list_sort([w for w in string_split({0}, ' ') if w <> ''])"
    mask = "list_reduce([CASE WHEN substr(x, i + 1, 1) = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END for i in range(CAST(length(x) AS INTEGER))], lambda p, q: p | q)"
    state = f"list_reduce(list_prepend(full_, [{mask} for c in string_split(y, '')]), lambda s, m: ((s + (s & m)) | (s - (s & m))) & full_)"
    window = "substr({1}, greatest(i, 0) + 1, least(length({1}), i + length({0})) - greatest(i, 0))"
    far = []
    for a, b, weight in (("a", "b", "scale"), ("sa", "sb", "0.95 * scale"), ("oa", "ob", "0.95 * scale")):
        short, long = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
        free = "" if a == "a" else " AND both_ = ''"
        rows = f"SELECT *, {short} AS sh, {long} AS lo FROM far WHERE {a} <> '' AND {b} <> ''{free}"
        far.append(f"SELECT query_id, canonical_id, rep_id, {weight} AS weight, sh AS x, {window.format('sh', 'lo')} AS y FROM (SELECT *, unnest(range(1 - length(sh), length(lo))) AS i FROM ({rows}))")
    return f"""{pairs},
wp0 AS (SELECT *, greatest(length(a), length(b)) / least(length(a), length(b)) AS longer, {words.format('a')} AS ta, {words.format('b')} AS tb FROM pr WHERE a <> '' AND b <> ''),
wp AS (SELECT query_id, canonical_id, rep_id, a, b, longer, CASE WHEN longer <= 8 THEN 0.9 ELSE 0.6 END AS scale, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb,
  array_to_string(list_sort(list_intersect(list_distinct(ta), tb)), ' ') AS both_, array_to_string(list_sort([w for w in list_distinct(ta) if NOT list_contains(tb, w)]), ' ') AS oa, array_to_string(list_sort([w for w in list_distinct(tb) if NOT list_contains(ta, w)]), ' ') AS ob FROM wp0),
far AS (SELECT * FROM wp WHERE longer >= 1.5), near AS (SELECT *, trim(both_ || ' ' || oa) AS xa, trim(both_ || ' ' || ob) AS xb, both_ <> '' AND (oa = '' OR ob = '') AS covered FROM wp WHERE longer < 1.5),
job AS (SELECT query_id, canonical_id, rep_id, 1.0 AS weight, a AS x, b AS y FROM wp UNION ALL SELECT query_id, canonical_id, rep_id, 0.95, sa, sb FROM near
  UNION ALL SELECT query_id, canonical_id, rep_id, 0.95, xa, xb FROM near WHERE NOT covered UNION ALL SELECT query_id, canonical_id, rep_id, 0.95, both_, xa FROM near WHERE NOT covered AND both_ <> '' UNION ALL SELECT query_id, canonical_id, rep_id, 0.95, both_, xb FROM near WHERE NOT covered AND both_ <> ''
  UNION ALL {' UNION ALL '.join(far)}),
txt AS (SELECT DISTINCT x, y, (1::HUGEINT << CAST(length(x) AS INTEGER)) - 1 AS full_ FROM job WHERE x <> '' AND y <> ''),
lcs AS (SELECT x, y, 200.0 * (length(x) - bit_count({state})) / (length(x) + length(y)) AS r FROM txt),
wr AS (SELECT query_id, canonical_id, max(s) AS score FROM (SELECT query_id, canonical_id, CAST(weight * r AS DOUBLE) AS s FROM job JOIN lcs USING (x, y) UNION ALL SELECT query_id, canonical_id, 95.0 FROM near WHERE covered
  UNION ALL SELECT query_id, canonical_id, CAST(100 * 0.95 * scale AS DOUBLE) FROM far WHERE both_ <> '' UNION ALL SELECT query_id, canonical_id, 0.0 FROM pr) GROUP BY ALL)
"""


SQL["wratio_topk"] = CTE + _wratio(", pr AS (SELECT query_id, r.canonical_id, rep_id, query_name AS a, rep_name AS b FROM q JOIN reps r ON true)") + o.RETURN_TOP.format(TOP.format("wr"))
SQL["wratio_decisions"] = (
    TRI_TOP
    + _wratio(", pr AS (SELECT t.query_id, t.canonical_id, rep_id, query_name AS a, rep_name AS b FROM top t JOIN q ON q.query_id = t.query_id JOIN all_reps r ON r.canonical_id = t.canonical_id WHERE NOT is_alias OR rep_id NOT IN (SELECT query_id FROM q))")
    + "SELECT query_id, canonical_id AS selected_id FROM wr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_id) = 1"
)


def _bootstrap_sql(groups: tuple[int, ...] = (8, 9, 10)) -> str:
    """The resamples are numpy's, so they are given as a table: one for each number of labels that the query set can hold."""
    drawn = {g: np.random.default_rng(metrics.SEED).integers(0, g, (metrics.RESAMPLES, g)).ravel().tolist() for g in groups}
    tables = " ".join(f"WHEN {g} THEN [{','.join(map(str, rows))}]" for g, rows in drawn.items())
    return o.LABEL + f""", g AS (SELECT row_number() OVER (ORDER BY query_label) - 1 AS i, CAST(count(*) FILTER (expected_rank = 1) AS DOUBLE) AS s, count(*) AS n FROM lr GROUP BY query_label),
d AS (SELECT unnest(CASE (SELECT count(*) FROM g) {tables} END) AS i, unnest(range({metrics.RESAMPLES} * (SELECT count(*) FROM g))) // (SELECT count(*) FROM g) AS r),
m AS (SELECT r, sum(s) / sum(n) AS m FROM d JOIN g USING (i) GROUP BY r) SELECT (SELECT round(sum(s) / sum(n), 9) FROM g) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"""


SQL["group_bootstrap_ci"] = _bootstrap_sql()
