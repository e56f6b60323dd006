import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import decisions, pages, profiles, review


def test_bands(spark):
    words = [None, 0, 4999, 5000, 19999, 20000, 99999, 100000]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w long").orderBy("i")
    assert [r[0] for r in df.select(profiles.length_band("w")).collect()] == [None, 0, 0, 1, 1, 2, 2, 3]


def test_bottom_k_is_order_free(spark):
    rows = [(1, 1, i, f"{i:016x}") for i in range(1, 51)]
    for r in (rows, rows[::-1]):
        s = profiles.sample_works(spark.createDataFrame(r, "profile long, target long, ordinal long, priority string"))
        assert sorted(x["ordinal"] for x in s.collect()) == list(range(1, 33))


def test_leakage_rules(spark):
    wt = [(1, 10), (1, 1), (1, 4), (2, 11), (2, 1), (2, 4), (3, 10), (3, 1), (3, 4), (3, 12), (4, 10), (4, 2), (4, 4), (5, 12), (5, 4)]
    buckets = {1: 0, 2: 0, 3: 6, 4: 8, 5: 0}
    wtags = spark.createDataFrame(wt, "ordinal long, tag_id long")
    works = spark.createDataFrame([(o, b, "p", 100, "en", True, False) for o, b in buckets.items()], "ordinal long, bucket int, priority string, word_count long, language string, complete boolean, restricted boolean")
    cat = spark.createDataFrame([(1, "Answer", "Freeform"), (2, "Other", "Freeform"), (4, "Fandom", "Fandom")], "id long, name string, type string")
    blocked = spark.createDataFrame([(10,)], "id long")
    support = profiles.without_blocked(works.filter("bucket < 6"), wtags, blocked)
    assert support.count() == 2
    members = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (11, 1, 1)], "tag_id long, profile long, target long")
    own = profiles.memberships(support, wtags, members)
    assert [(r["profile"], r["n"]) for r in profiles.accumulate(own).collect()] == [(1, 1)]
    assert own.first()["ordinal"] == 2
    qm = spark.createDataFrame([(10, 10, 1)], "tag_id long, profile long, target long")
    dev = profiles.memberships(works.filter("bucket IN (6, 7)"), wtags, qm)
    sample = profiles.sample_works(dev)
    assert [r["ordinal"] for r in sample.collect()] == [3]
    one = profiles.one_work(sample, profiles.visible_context(wtags, cat)).collect()
    assert {(r["type"], r["tag_id"]) for r in one} == {("Fandom", 4)}


def test_rendered_percent_rounds_halves_to_even(spark):
    assert [r[0] for r in spark.createDataFrame([(1, 8), (3, 8)], "a long, b long").select(profiles.percent("a", "b")).collect()] == ["12%", "38%"]


def _cases(spark):
    rows = [(1, 1, 2, 2), (2, 2, 2, 2), (3, 3, None, 3), (4, 100, None, 1)]
    return spark.createDataFrame([(q, a, list(range(1, 11)), s, f) for q, a, s, f in rows], "query_id long, answer long, top_ids array<long>, selected_id long, forced_id long")


def test_outcomes_and_denominators(spark):
    o = decisions.outcomes(_cases(spark))
    s = decisions.summarize(o).first()
    assert (s["successes"], s["overall_success"], s["shortlist_decision_accuracy"]) == (1, 0.25, 0.5)
    assert s["conditional_success"] == pytest.approx(1 / 3)
    assert [s[k + "s"] for k in ("rescue", "regression", "selection_error", "unnecessary_abstention")] == [1, 1, 1, 1] and s["retrieval_misses"] == 1
    assert [s["forced_" + k] for k in ("successes", "rescues", "regressions", "difference")] == [2, 2, 1, 0.25]
    assert decisions.recount_violations(decisions.summarize(o)).count() == 0
    assert decisions.summarize(o.limit(0)).first()["precision"] is None
    with pytest.raises(Exception, match="outside its shortlist"):
        decisions.outcomes(_cases(spark).withColumn("selected_id", F.lit(99).cast("long"))).collect()


def _answer(p, choice, kind="choice", model="m-1"):
    return json.dumps({"model": model, "answers": {"canonical": {"type": kind, "choice": choice, "probabilities": p}}})


def test_answers_are_parsed_strictly(spark):
    none = decisions.NONE
    rows = [
        _answer({"tag_2": 0.5, "tag_3": 0.3, none: 0.2}, "tag_3"), _answer({"tag_2": 0.2, "tag_3": 0.2, none: 0.6}, none), _answer({"tag_2": -1, "tag_3": 1, none: 1}, "tag_2"),
        _answer({"tag_2": True, "tag_3": 0, none: 0}, "tag_2"), _answer({"tag_2": 2, "tag_3": 0, none: 0}, "tag_2"), _answer({"tag_2": 0.2, "tag_3": 0.2, none: 0.2}, "tag_2"),
        _answer({"tag_2": 1}, "tag_2"), _answer({"tag_2": 0.5, "tag_3": 0.3, none: 0.2}, "tag_3", model="other"), '{"error": "x"}', "not json",
        _answer({"tag_2": "NaN", "tag_3": 0.5, none: 0.5}, "tag_3"), _answer({"tag_2": 0.5, "tag_3": 0.3, none: 0.2}, "tag_3", kind="noul"),
    ]
    df = spark.createDataFrame([(i, r, ["tag_2", "tag_3", none]) for i, r in enumerate(rows)], "i int, response string, options array<string>")
    got = decisions.parse_choice(df, "m").orderBy("i").collect()
    assert (got[0]["problem"], got[0]["selected_id"], got[0]["forced_id"], got[0]["choice_disagrees_with_argmax"]) == (None, 3, 2, True)
    assert (got[1]["problem"], got[1]["selected_id"], got[1]["forced_id"], got[1]["none_probability"]) == (None, None, 2, 0.6)
    assert all(g["problem"] is not None and g["selected_id"] is None for g in got[2:])


def test_prompts_do_not_depend_on_labels(spark):
    df = spark.createDataFrame([(7, 'in "quotes"', [2, 1], {1: '{"name":"a"}', 2: '{"name":"b"}'}, 1), (7, 'in "quotes"', [2, 1], {1: '{"name":"a"}', 2: '{"name":"b"}'}, 2)], "source_id long, incoming_tag string, top_ids array<long>, d map<long,string>, canonical_id long")
    p = [r[0] for r in df.select(decisions.payload("m", "choose", F.col("top_ids"), "d", "none fits")).collect()]
    assert p[0] == p[1]
    q = json.loads(p[0])
    assert list(q["questions"]["canonical"]["criteria"]) == ["tag_2", "tag_1", decisions.NONE] and q["state"]["incoming_tag"] == 'in "quotes"'


def test_review_metrics(spark):
    cases = spark.createDataFrame([(i,) for i in range(1, 6)], "source_id long")
    refs = spark.createDataFrame([(1, "synonym", 10), (2, "synonym", 20), (3, "new_canonical", None), (4, "unresolved", None)], "source_id long, judgment string, canonical_id long")
    props = spark.createDataFrame([(i, "synonym", 10) for i in range(1, 6)], "source_id long, action string, canonical_id long")
    m = review.measure_actions(cases, refs, props).first()
    assert m["resolved_synonym_precision"] == pytest.approx(1 / 3) and m["resolved_false_merge_fraction"] == pytest.approx(2 / 3)
    assert (m["false_merge_rate_on_new_concepts"], m["merges_on_unresolved"], m["merges_without_reference"]) == (1.0, 1, 1)
    assert review.measure_actions(cases, refs, props.limit(0)).first()["resolved_synonym_precision"] is None


def test_judgments_need_evidence(spark):
    f = "source_id string, reviewer string, judgment string, canonical_id string, proposed_name string, confidence string, catalogue_checked string, rationale string"
    rows = [("1", "r", "synonym", "10", "", "high", "", "x"), ("2", "r", "synonym", "99", "", "high", "", "x"), ("3", "r", "new_canonical", "", "n", "low", "no", "x"), ("4", "", "unresolved", "", "", "low", "", "x"), ("5", "", "", "", "", "", "", "")]
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "source_id long")
    cat = spark.createDataFrame([(10,)], "id long")
    got = {r["source_id"]: r["problem"] for r in review.validate_references(spark.createDataFrame(rows, f), cases, cat).collect()}
    assert got["1"] is None and got["5"] is None and got["6"] == "missing source" and all(got[k] for k in "234")


def test_work_page():
    html = """<html><body><h2 class="title heading"> A <i>title</i></h2><dl class="work meta group"><dd class="freeform tags"><a class="tag" href="/t/1">A &amp; B</a></dd>
    <dd class="language">English</dd><dd class="stats"><dl class="stats"><dd class="words">65,871</dd><dd class="comments">103</dd></dl></dd><a href="/works/12">x</a></dl>
    <script>not text</script><div class="chapter" id="chapter-1"><a href="/works/12/chapters/3">c</a></p></div></body></html>"""
    w = pages.work_page(html)
    assert (w["work_id"], w["title"], w["language"], w["stats"]["words"], w["stats"]["kudos"]) == (12, "A title", "English", 65871, None)
    assert w["tags"] == {"Freeform": [{"name": "A & B", "href": "/t/1"}]} and w["saved_chapter_containers"] == ["chapter-1"]
    assert "not text" not in pages.folded(pages.read_page(html).listeners[0])
    with pytest.raises(ValueError):
        pages.work_page("<html>log in</html>")
    with pytest.raises(ValueError):
        pages.work_page(html.replace("chapters/3", "chapters/3").replace('href="/works/12/', 'href="/works/13/'))
    assert pages.read_page("<div>" * 5000 + "x<h1>y").first == {"h1": "y"}


def test_page_metadata_equals_its_sql_where_references_are_cut(spark, tmp_path):
    from types import SimpleNamespace

    import duckdb

    from lexweave.plans import evidence, queries

    texts = ["a&amp;&amp;&amp", "b &lt", "c&ampd", "d &copy;&copy e", "&amp;lt; f &quo", "g & h &&amp;", "i&ampj;", "k&#"]
    rows = [(k, f'<html><title>{t}</title><body><h1 id="x">{t}</h1><p>{t} x</p><a href="/?a=1&copy=2">{t}</a>&middot;</body></html>') for k, t in enumerate(texts)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(path)
    got = queries.page_metadata(SimpleNamespace(spark=spark, sf_dir=str(tmp_path)))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    expected = db.execute(evidence.SQL["page_metadata"] + " ORDER BY page_id").fetchall()
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == expected
    assert [r[1] for r in expected[:3]] == ["a&&&amp", "b &lt", "c&ampd"]
    read = pages.page_metadata(spark.createDataFrame(rows[:3], "page_id long, html string")).orderBy("page_id").collect()
    assert [r["title"] for r in read] == ["a&&&", "b <", "c&d"]  # the operator itself reads pages as HTML parsers do
