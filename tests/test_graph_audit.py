import pytest
from pyspark.sql import functions as F

from lexweave.operators import audit, graph, sampling

TAGS = "id long, type string, name string, canonical boolean, cached_count long, merger_id long"


def test_statuses_and_depths(spark):
    links = [0, 1, 2, 999, 0, 7, 6, 6, 1, 9, 0]
    nodes = spark.createDataFrame([(i, m, i in (1, 9, 11)) for i, m in enumerate(links, 1)], "id long, merger_id long, canonical boolean")
    found = {r["id"]: (r["status"], r["terminal"], r["hops"]) for r in graph.resolve_links(nodes).collect()}
    assert [found[i][1] for i in (1, 2, 3, 11)] == [1, 1, 1, 11]
    assert [found[i][0] for i in (4, 5, 6, 7, 8, 9, 10)] == ["MISSING", "UNMERGED", "CYCLE", "CYCLE", "CYCLE", "CONFLICT", "CONFLICT"]
    assert [found[i][2] for i in range(1, 6)] == [0, 1, 2, 1, 0]


def test_long_chain_and_duplicate_keys(spark):
    n = 300
    nodes = spark.createDataFrame([(i, i - 1, i == 1) for i in range(1, n + 1)], "id long, merger_id long, canonical boolean")
    far = graph.resolve_links(nodes).filter(f"id = {n}").first()
    assert (far["status"], far["terminal"], far["hops"]) == ("RESOLVED", 1, n - 1)
    with pytest.raises(ValueError):
        graph.resolve_links(nodes.union(nodes.limit(1)))


def test_names_resolve_and_cycles_fail(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "from_tag string, to_tag string")
    assert {(r[0], r[1], r[2]) for r in graph.resolve_names(e).collect()} == {("a", "c", 2), ("b", "c", 1), ("x", "c", 1)}
    with pytest.raises(ValueError):
        graph.resolve_names(spark.createDataFrame([("a", "b"), ("b", "a")], "from_tag string, to_tag string"))


def test_audit_of_a_small_dump(spark):
    rows = [
        (1, "Freeform", "Canonical", True, 9, None), (2, "Freeform", "alias", False, 5, 1), (3, "Freeform", "Redacted", False, 7, 1), (4, "Freeform", "unlabelled", False, 5, None),
        (5, "Freeform", "conflict", True, 5, 1), (6, "Freeform", "to conflict", False, 5, 5), (7, "Fandom", "Other", True, 5, None), (8, "Freeform", "wrong type", False, 5, 7),
        (9, "Freeform", " ", False, 5, 1), (10, "Freeform", "Redacted", True, 2, None), (11, "Freeform", "to hidden", False, 5, 10),
    ]
    tags = spark.createDataFrame(rows, TAGS)
    resolved = graph.resolve_links(tags)
    assert [r["id"] for r in audit.eligible_synonyms(tags, resolved).collect()] == [2]
    assert audit.catalogue(tags).count() == 2
    c = audit.integrity_counters(tags, resolved).first()
    assert (c["redacted_used"], c["visible_unmerged"], c["cross_type_positives"], c["reach_conflict"]) == (1, 1, 1, 1)


def test_capped_sample_is_order_free_and_strict(spark):
    rows = [(i, i // 5) for i in range(40)]
    a = sampling.capped_sample(spark.createDataFrame(rows, "id long, g long"), "id", "g", "s", 16, 2)
    b = sampling.capped_sample(spark.createDataFrame(rows[::-1], "id long, g long").repartition(3), "id", "g", "s", 16, 2)
    assert sorted(a.collect()) == sorted(b.collect()) and a.groupBy("g").count().agg(F.max("count")).first()[0] == 2
    with pytest.raises(ValueError):
        sampling.capped_sample(spark.createDataFrame(rows, "id long, g long"), "id", "g", "s", 17, 2)


def test_quota_fallback(spark):
    rows = spark.createDataFrame([(i, i) for i in range(30)], "id long, x long")
    out = sampling.quota_selection(rows, "id", "s", [("low", 5, F.lit(True), F.col("x")), ("none", 5, F.lit(False), F.lit(0))]).collect()
    assert sorted(r["id"] for r in out if r["selection_reason"] == "low") == [0, 1, 2, 3, 4]
    assert len([r for r in out if r["selection_reason"] == "none_fallback"]) == 5 and len({r["id"] for r in out}) == 10


def test_snapshot_rules(spark):
    from lexweave.operators import snapshot

    cat = spark.createDataFrame([(1, "A", "Freeform", "test"), (2, "B", "Freeform", "development")], "id long, name string, type string, split string")
    al = spark.createDataFrame([(10, "a", 1, "A", "test"), (11, "b", 2, "B", "test"), (12, "c", 3, "C", "test"), (2, "x", 1, "A", "test")], "id long, name string, canonical_id long, canonical_name string, split string")
    ex = spark.createDataFrame([(10, "a", 1, "synonym"), (10, "other", 1, "synonym"), (99, "z", 1, "synonym"), (1, "A", 1, "canonical_name")], "query_id long, query_name string, canonical_id long, kind string")
    got = {r["rule"]: r["rows"] for r in snapshot.violations(cat, al, ex).collect()}
    assert got == {"alias is canonical": 1, "alias without target": 1, "alias disagrees with its target": 1, "example without alias": 1, "example disagrees with its alias": 1}
    assert snapshot.violations(cat, al.filter("id = 10"), ex.filter("query_name IN ('a', 'A')")).count() == 0
    assert not snapshot.disjoint(cat, al, "id") and snapshot.disjoint(cat, al.filter("id > 9"), "id")
