import base64
import struct

import pytest
from pyspark.sql import functions as F

from lexweave.sources import providers
from lexweave.sources import tables as src
from lexweave.streaming import replay


def test_tag_csv(spark, tmp_path):
    p = tmp_path / "tags.csv"
    p.write_text('id,type,name,canonical,cached_count,merger_id\n1,Freeform,"a ""quoted"", name",true,3,\n2,Freeform,"back\\",false,0,1\n', encoding="utf-8-sig")
    rows = src.read_tags(spark, str(p)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "Freeform", 'a "quoted", name', True, 3, None), (2, "Freeform", "back\\", False, 0, 1)]
    p.write_text("id,type,name,canonical,cached_count,merger_id\n1,Freeform,a,maybe,3,\n")
    with pytest.raises(Exception, match="malformed tag row"):
        src.read_tags(spark, str(p)).collect()
    p.write_text("id,kind\n")
    with pytest.raises(ValueError):
        src.read_tags(spark, str(p))


def test_works_csv(spark, tmp_path):
    p = tmp_path / "works.csv"
    p.write_text("creation date,language,restricted,complete,word_count,tags,\n2021-02-26,en,false,true,,1+2+999,\n2021-02-25,en,true,false,20,3,\n")
    rows = src.read_works(spark, str(p)).collect()
    assert [(r["ordinal"], r["word_count"], r["tags"], r["restricted"]) for r in rows] == [(1, None, [1, 2, 999], False), (2, 20, [3], True)]


def test_xml_and_pages(spark, tmp_path):
    (tmp_path / "Tags.xml").write_text('<tags><row Id="1" TagName="a" Count="5"/><row Id="2" TagName="b" Count="6" WikiPostId="9"/></tags>')
    assert [tuple(r) for r in src.read_xml_tags(spark, str(tmp_path / "Tags.xml")).orderBy("id").collect()] == [(1, "a", 5), (2, "b", 6)]
    d = tmp_path / "pages"
    d.mkdir()
    (d / "1.json").write_text('{"items": [{"name": "x"}], "has_more": true}')
    with pytest.raises(ValueError):
        src.read_pages(spark, str(d), "name: STRING")
    (d / "2.json").write_text('{"items": [{"name": "y"}], "has_more": false}')
    assert sorted(map(tuple, src.read_pages(spark, str(d), "name: STRING").collect())) == [("x", 1, 0), ("y", 2, 0)]
    (d / "4.json").write_text('{"items": [], "has_more": true}')
    with pytest.raises(ValueError, match="out of order"):
        src.read_pages(spark, str(d), "name: STRING")
    (d / "4.json").unlink()
    for k, quota in ((1, 5), (2, 6)):
        (d / f"{k}.json").write_text('{"items": [{"name": "x"}], "has_more": %s, "quota_remaining": %d}' % ("true" if k == 1 else "false", quota))
    with pytest.raises(ValueError, match="quota"):
        src.read_pages(spark, str(d), "name: STRING")


def test_counted_sinks_and_rankings(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'a "{i}"\nb', i % 2 == 0) for i in range(50)], "i long, s string, t boolean").repartition(3)
    found = src.write_counted(rows, f"file://{tmp_path}/c")
    assert found["rows"] == 50 and found["files"] == 3 and found["bytes"] == sum(f.stat().st_size for f in (tmp_path / "c").glob("part-*")) and len(found["sha256"]) == 64
    src.write_rankings(rows, f"file://{tmp_path}/r", {"method": "x"})
    back, about = src.read_rankings(spark, f"file://{tmp_path}/r", "i long, s string, t boolean")
    assert about == {"method": "x"} and sorted(back.collect()) == sorted(rows.collect())
    back.limit(10).write.mode("overwrite").json(f"file://{tmp_path}/other")
    src.write_rankings(rows.limit(0), f"file://{tmp_path}/e", {})
    assert src.read_rankings(spark, f"file://{tmp_path}/e", "i long")[0].count() == 0


def test_answers_by_index(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "index int, text string")
    answers = spark.createDataFrame([(1, 2.0), (0, 1.0)], "index int, value double")
    assert sorted(map(tuple, src.by_index(answers, asked, 2).collect())) == [(0, "a", 1.0), (1, "b", 2.0)]
    with pytest.raises(ValueError):
        src.by_index(answers.union(answers), asked, 2)


def test_vectors(spark):
    ok = base64.b64encode(struct.pack("<2f", 3, 4)).decode()
    assert src.decode_base64_vectors(spark.createDataFrame([(ok,)], "embedding string"), dimensions=2).first()[0] == [3.0, 4.0]
    for bad in (struct.pack("<2f", 0, 0), struct.pack("<2f", float("nan"), 1), struct.pack("<f", 1)):
        with pytest.raises(Exception, match="invalid vector"):
            src.decode_base64_vectors(spark.createDataFrame([(base64.b64encode(bad).decode(),)], "embedding string"), dimensions=2).collect()
    idx = spark.createDataFrame([(1,), (0,), (1,)], "index int")
    src.check_indices(idx.distinct(), 2)
    with pytest.raises(ValueError):
        src.check_indices(idx, 3)


def test_batches(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50 + 1)) for i in range(2000)], "i long, t string")
    b = src.plan_batches(df, "i", "t", 100, 2000).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()
    assert all(r["n"] <= 100 and r["b"] <= 2000 and r["hi"] - r["lo"] + 1 == r["n"] for r in b) and sum(r["n"] for r in b) == 2000
    with pytest.raises(Exception, match="larger than a batch"):
        src.plan_batches(df, "i", "t", 100, 10).collect()


def test_files(tmp_path, spark):
    p = tmp_path / "c.json"
    store = src.VerifiedStore(p)
    store.put({"a": 1}, [1, 2])
    assert store.get({"a": 1}) == [1, 2]
    with pytest.raises(ValueError):
        store.get({"a": 2})
    p.write_text(p.read_text().replace("2\n", "3\n"))
    with pytest.raises(ValueError):
        store.get({"a": 1})
    frozen = src.VerifiedStore(tmp_path / "f.json")
    frozen.put_once({"x": 1})
    frozen.put_once({"x": 1})
    with pytest.raises(ValueError):
        frozen.put_once({"x": 2})
    assert src.fingerprint({"a": 1, "b": 2}) == src.fingerprint({"b": 2, "a": 1}) and src.ordered_fingerprint({"a": 1, "b": 2}) != src.ordered_fingerprint({"b": 2, "a": 1})
    assert src.editable_csv(tmp_path / "r.csv", ["source_id", "x"], ["1", "2"]) and not src.editable_csv(tmp_path / "r.csv", ["source_id", "x"], ["2", "1"])
    with pytest.raises(ValueError):
        src.editable_csv(tmp_path / "r.csv", ["source_id", "x"], ["3"])
    src.write_review_page(tmp_path / "r.html", "Review", [{"id": 1, "name": "</script><b>"}])
    assert "</script><b>" not in (tmp_path / "r.html").read_text()
    made = []
    table = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert src.checked_table(spark, f"file://{tmp_path}/t", {"v": 1}, table).count() == 3
    assert len(made) == 1
    src.write_table(spark.createDataFrame([(True, 'a"b')], "t boolean, s string"), f"file://{tmp_path}/csv", "csv")
    assert any("true" in r["value"] for r in spark.read.text(f"file://{tmp_path}/csv").collect())


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    assert {r["text"]: r["embedding"] for r in providers.embed(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()} == {"a": [1.0, 1.0], "bb": [2.0, 1.0]}
    calls = []
    assert providers.with_retries(lambda x: calls.append(x) or (1 / (len(calls) - 1)), first_wait=0)(1) == 1.0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 100, True, False), (1, None, False, True), (2, 7000, True, True)], "profile long, word_count long, complete boolean, restricted boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = replay.running_profiles(stream).writeStream.outputMode("complete").format("memory").queryName("profiles_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("profiles_stream").collect()) == sorted(replay.running_profiles(rows).collect())
