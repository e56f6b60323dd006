import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions import vectors as vx
from lexweave.operators import matching, metrics, retrieval


def test_normalisation():
    assert tx.normalize_text("  André/A & B | C (Fándom)  ", "safe_punctuation") == "andré/a & b | c (fándom)"
    assert tx.normalize_text("a‑b’c", "safe_punctuation") == "a-b'c"
    assert tx.normalize_text("a—b", "safe_punctuation") != tx.normalize_text("a-b", "safe_punctuation")
    assert tx.normalize_text("Straße", "casefold") == "strasse"


def test_pilot_keys(spark):
    names = ["C", "C++", "C#", ".NET", "NET", "  Foo___Bar — baz  ", "__init__"]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.separator_key("n")).collect()]
    assert len(set(found[:5])) == 5 and found[5:] == ["foo-bar-baz", "__init__"]


def test_similarities(spark):
    assert tx.extent_similarity("word", "two words", False) == pytest.approx(0.8)
    assert tx.extent_similarity("word", "two words", True) == pytest.approx(0.571429, abs=1e-6)
    df = spark.createDataFrame([("A/B", "A&B"), ("word", "two words"), ("", "")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(tx.similarity("a", "b")).collect()] == [1.0, 0.363636, 0.0]
    assert [round(r[0], 6) for r in df.select(tx.levenshtein_similarity("a", "b")).collect()] == [0.666667, 0.444444, 1.0]
    assert tx.wratio("same", "same") == 100 and tx.wratio("", "x") == 0
    assert tx.indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert tx.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    for name in tx.SCORERS:
        assert df.select(tx.SCORERS[name]("a", "b").alias("s")).filter("s IS NULL").count() == 0


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query_name string, canonical_id long")


def test_exact_matching_masks_the_own_alias(spark):
    cat = spark.createDataFrame([(10, "A/B"), (20, "A&B"), (30, "same NAME"), (40, "same name")], "id long, name string")
    al = spark.createDataFrame([(100, "incoming", 10), (101, "Incoming", 10), (102, "other alias", 10), (103, "distractor alias", 20)], "id long, name string, canonical_id long")
    q = _queries(spark, [(100, "incoming", 10), (10, "A/B", 10), (200, "SAME NAME", 30)])
    reps = matching.representations(cat, al)
    raw = {r["query_id"]: r for r in matching.exact_match(q, reps, lambda c: tx.normalize(c, "raw")).collect()}
    fold = {r["query_id"]: r for r in matching.exact_match(q, reps, lambda c: tx.normalize(c, "casefold")).collect()}
    assert raw[100]["status"] == "no_match" and fold[100]["targets"] == [10] and fold[200]["status"] == "ambiguous"
    assert matching.collisions(reps, lambda c: tx.normalize(c, "casefold")).count() == 1


def test_alias_pool_and_ranks(spark):
    cat = spark.createDataFrame([(10,), (20,), (30,), (40,)], "id long")
    scores = [(10, 0.1), (20, 0.5), (30, 0.2), (40, 0.0)]
    alias = [(100, 10, 1.0), (101, 10, 0.3), (102, 10, 0.4), (103, 20, 0.6)]
    rows = [(100, c, c, False, s) for c, s in scores] + [(100, c, r, True, s) for r, c, s in alias if r != 100]
    df = spark.createDataFrame(rows, "query_id long, canonical_id long, rep_id long, is_alias boolean, score double")
    expected = _queries(spark, [(100, "x", 10)])
    assert matching.full_rank(matching.max_pool(df.filter("NOT is_alias")), expected).first()["expected_rank"] == 3
    pooled = matching.max_pool(df)
    r = matching.full_rank(pooled, expected).first()
    assert (r["expected_rank"], r["expected_score"]) == (2, 0.4)
    assert [x["canonical_id"] for x in matching.top_k(pooled).orderBy("rank").collect()] == [20, 10, 30, 40]
    assert cat.count() == 4 and matching.order_violations(matching.top_k(pooled)).count() == 0


def test_ties_go_by_id(spark):
    rows = [(1, i, 0.9 if i == 119 else 0.3) for i in range(100, 120)]
    top = matching.top_k(spark.createDataFrame(rows, "query_id long, canonical_id long, score double")).orderBy("rank").collect()
    assert [r["canonical_id"] for r in top] == [119, *range(100, 109)]


def test_blocked_cosine_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype("float32")
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "canonical_id long, vector array<float>").repartition(5)
    q = df.filter("canonical_id < 6").withColumnRenamed("canonical_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["canonical_id"] for r in matching.top_k(retrieval.cosine_scores(q, df, 4), 4).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in range(6):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-(u[i] @ u[j]), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert df.select(vx.unit("v")).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vx.unit("v")).collect()
    bad = spark.createDataFrame([([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), (None,), ([1.0, 2.0],)], "v array<float>")
    assert [r[0] for r in bad.select(vx.is_valid("v", 2)).collect()] == [False, False, False, False, True]


def test_metrics(spark):
    r = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, None)], "query_id long, g long, expected_rank long")
    m = metrics.micro_macro(r, "g").first()
    assert (m["micro"], m["macro"]) == (0.75, 0.5)
    all_hits = metrics.group_bootstrap(r, "g", F.lit(1))
    assert (all_hits["mean"], all_hits["low"], all_hits["high"]) == (1.0, 1.0, 1.0)
    w = spark.createDataFrame([(200, 200), (0, 200), (0, 0)], "s long, n long").select(*metrics.wilson("s", "n")).collect()
    assert w[0][0] < 0.99 and w[1][1] > 0.01 and w[2][0] is None
    assert metrics.recall_at(r.limit(0)).first()["recall_1"] is None
