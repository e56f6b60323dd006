"""Adjudication questions, strata, searches, intervals and the review page on small tables."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import decisions, graph, matching, metrics, profiles, retrieval, sampling
from lexweave.sources import tables as src


def test_questions_of_all_conditions(spark):
    names = {2: 'b "x"', 1: "a"}
    df = spark.createDataFrame(
        [(7, 'in "q"', [(2, names[2], ["z"], {"Fandom": ["f"]}), (1, names[1], [], {})], {"Character": ["c", "d"]}, 1), (7, 'in "q"', [(2, names[2], ["z"], {"Fandom": ["f"]}), (1, names[1], [], {})], {"Character": ["c", "d"]}, 2)],
        "query_id long, incoming string, shown array<struct<id: long, name: string, aliases: array<string>, context: map<string,array<string>>>>, own map<string,array<string>>, expected long",
    )
    for name, c in decisions.CONDITIONS.items():
        described = F.transform("shown", lambda x: F.struct(x["id"].alias("id"), decisions.candidate_description(c, x["name"], x["aliases"], x["context"]).alias("text")))  # noqa: B023
        rows = [json.loads(r[0]) for r in df.select(decisions.question(c, "m", "P\n", F.col("incoming"), described, "none", F.col("own"))).collect()]
        assert rows[0] == rows[1]  # what is expected is no input
        q = rows[0]
        assert (q["model"], q["state"]["incoming_tag"], "observed_co_tags" in q["state"]) == ("m", 'in "q"', c.context), name
        if c.pairwise:
            assert list(q["questions"]) == ["tag_2", "tag_1"] and all(v["type"] == "noul" and v["instructions"].startswith("P\n{") for v in q["questions"].values())
            texts = [v["instructions"][2:] for v in q["questions"].values()]
        else:
            options = q["questions"]["canonical"]["criteria"]
            assert list(options) == ["tag_2", "tag_1", *([decisions.NONE] if c.none else [])]
            texts = list(options.values())[:2]
        first = {"canonical_tag": names[2]} | ({"known_alternate_names": ["z"]} if c.aliases else {}) | ({"observed_co_tags": {"Fandom": ["f"]}} if c.context else {})
        assert texts[0] == json.dumps(first) and texts[1] == json.dumps({"canonical_tag": "a"})


def test_searches(spark):
    cat = spark.createDataFrame([(1, "Alpha One"), (2, "Beta"), (3, "Gamma 100%")], "id long, name string")
    al = spark.createDataFrame([(10, 2, "the ALPHA two"), (11, 2, "x")], "id long, canonical_id long, name string")
    found = lambda q, most=100: [tuple(r) for r in matching.search_names(cat, al, q, most).collect()]
    assert found("alpha") == [(1, "Alpha One", 2), (2, "Beta", 2)] and found("alpha", 1) == [(1, "Alpha One", 2)]
    assert found("TWO beta") == [(2, "Beta", 1)] and found("#3") == [(3, "Gamma 100%", 1)] and found("# 3") == [] and found("  ") == [] and found("100%") == [(3, "Gamma 100%", 1)]


def test_strata_may_overlap_and_leave_empty_ones_out(spark):
    rows = spark.createDataFrame([(1, 1, 5), (2, None, 50), (3, 2, 50)], "query_id long, expected_rank long, n long")
    got = {r["stratum"]: (r["queries"], r["hits_1"]) for r in metrics.by_strata(rows, {"all": F.lit(True), "few": F.col("n") < 10, "none": F.col("n") > 99, "unknown": F.lit(None).cast("boolean")}).collect()}
    assert got == {"all": (3, 1), "few": (1, 1)}


def test_drawn_bootstrap(spark):
    rows = spark.createDataFrame([(i, i % 7, i % 2) for i in range(70)], "query_id long, g long, x int")
    a, b = (metrics.drawn_bootstrap(rows.repartition(k), "g", F.col("x"), 300).first() for k in (1, 5))
    assert a == b and a["low"] <= a["mean"] == 0.5 <= a["high"]
    one = metrics.drawn_bootstrap(rows, "g", F.lit(1), 50).first()
    assert tuple(one) == (1.0, 1.0, 1.0)
    assert tuple(metrics.drawn_bootstrap(rows.limit(0), "g", F.col("x"), 50).first()) == (None, None, None)


def test_changes_and_margins(spark):
    a = spark.createDataFrame([(i, 1 if i < 8 else None) for i in range(12)], "query_id long, expected_rank long")
    b = spark.createDataFrame([(i, 1 if i % 2 else None) for i in range(12)], "query_id long, expected_rank long")
    got = matching.changed_hits(a, b, "s", 1, 3).collect()
    assert {(r["change"], r["place"]) for r in got} == {("gain", 1), ("gain", 2), ("gain", 3), ("loss", 1), ("loss", 2)}
    ranked = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.7, 2), (2, 5, 0.4, 1)], "query_id long, canonical_id long, score double, rank long")
    assert {r["query_id"]: r["margin"] for r in matching.margin(ranked).collect()} == {1: pytest.approx(0.2), 2: None}
    names = spark.createDataFrame([(5, "five"), (6, "six")], "id long, name string")
    assert {r["query_id"]: r["names"] for r in matching.listed_names(ranked, names).collect()} == {1: ["five", "six"], 2: ["five"]}


def test_names_that_hash_badly_are_resolved(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "0"), ("x", "0"), ("x", "0")], "from_tag string, to_tag string")
    assert {tuple(r) for r in graph.resolve_names(edges).collect()} == {("a", "0", 2), ("b", "0", 1), ("x", "0", 1)}
    with pytest.raises(ValueError, match="cycle"):
        graph.resolve_names(spark.createDataFrame([("a", "b"), ("b", "a")], "from_tag string, to_tag string"))


def test_cosine_ranks_and_pools(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x[11] = x[10]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "canonical_id long, vector array<double>").repartition(4)
    q = df.filter("canonical_id < 8").withColumnRenamed("canonical_id", "query_id")
    expected = spark.createDataFrame([(i, 10 if i % 2 else 11) for i in range(8)] + [(3, 3)], "query_id long, canonical_id long")
    got = {r["query_id"]: (r["canonical_id"], r["expected_rank"]) for r in retrieval.cosine_ranks(q, df, expected).collect()}
    for i in range(8):
        t = 10 if i % 2 else 11
        better = sum(j not in (i, t) and (round(s[i, j], 12), -j) > (round(s[i, t], 12), -t) for j in range(50))
        assert got[i] == (t, better + 1)
    pooled = df.select((F.col("canonical_id") / 5).cast("long").alias("canonical_id"), F.col("canonical_id").alias("own_id"), "vector")
    top = {(r["query_id"], r["rank"]): r["canonical_id"] for r in matching.top_k(matching.max_pool(retrieval.cosine_scores(q, pooled, 3)), 3).collect()}
    for i in range(8):
        best = sorted(range(10), key=lambda c: (-max(s[i, j] for j in range(c * 5, c * 5 + 5) if j != i), c))[:3]  # noqa: B023
        assert [top[i, k] for k in (1, 2, 3)] == best
    assert retrieval.cosine_ranks(q.limit(0), df, expected).count() == 0


def test_small_things(spark):
    rows = spark.createDataFrame([(i,) for i in range(9)], "id long")
    order = [r["id"] for r in sampling.review_order(rows, "id", "s").orderBy("position").collect()]
    assert sorted(order) == list(range(9)) and order != list(range(9))
    assert profiles.slim(spark.createDataFrame([(1, [1], {"a": 1})], "profile long, works array<long>, m map<string,long>")).columns == ["profile", "m"]
    assert decisions.recount_violations(spark.createDataFrame([(1, 5, 3, 3, 1, 1, 1, 1, 0)], "part int, queries long, successes long, baseline_corrects long, rescues long, regressions long, selection_errors long, unnecessary_abstentions long, retrieval_misses long")).count() == 0


def test_review_page_with_forms(tmp_path):
    src.write_review_page(tmp_path / "r.html", "R", [{"id": 1, "name": "</script>x"}], [{"source_id": 4, "name": "<i>&"}])
    page = (tmp_path / "r.html").read_text()
    held = {i: json.loads(re.search(f'id="{i}">(.*?)</script>', page).group(1)) for i in "dc"}
    assert held["d"] == [{"id": 1, "name": "</script>x"}] and held["c"]["cases"] == [{"source_id": 4, "name": "<i>&"}] and tuple(held["c"]["fields"]) == src.REVIEW_FIELDS
    assert "<i>&" not in page and page.count("<script") == 3
