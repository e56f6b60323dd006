"""Ledgers under races and repeats, archives by bytes, bounded language samples, real tokenizer versions."""

import gzip

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexweave.llm import language_id, token_counts, warc
from lexweave.llm import queries as q

SCHEMA = "kind string, source string, lang string, version string, tokens long, old_tokens long"


def inserts(spark, *tokens):
    return spark.createDataFrame([("insert", "s", "en", "v", t, None) for t in tokens], SCHEMA)


def test_a_batch_that_comes_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.commit("1", inserts(spark, 2))
    ledger.commit("2", inserts(spark, 3))
    real = token_counts.Ledger._sum

    def late(self, names, folder):
        out = real(self, names, folder)
        monkeypatch.setattr(token_counts.Ledger, "_sum", real)
        ledger.commit("3", inserts(spark, 100))
        return out

    monkeypatch.setattr(token_counts.Ledger, "_sum", late)
    ledger.compact()
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v", 3, 105)]
    ledger.compact()
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v", 3, 105)] and ledger.batches() == []


def test_other_changes_under_a_known_id_are_refused(spark, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.commit("1", inserts(spark, 5, 6)) and ledger.commit("1", inserts(spark, 6, 5).repartition(2))
    with pytest.raises(ValueError, match="other changes"):
        ledger.commit("1", inserts(spark, 9))
    ledger.compact()
    assert not ledger.commit("1", inserts(spark, 5, 6))
    with pytest.raises(ValueError, match="other changes"):
        ledger.commit("1", inserts(spark, 9))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v", 2, 11)]


def test_texts_counted_again_by_another_version(spark, tmp_path):
    from tokenizers import Tokenizer

    files = {"byte-50k": public_tokenizers.path("byte_bpe_50k.json"), "word-49k": public_tokenizers.path("word_bpe_49k.json")}
    texts = ["Some text, with words.", "", None, "naïve 日本 \n\n x", "<|endoftext|> a"]
    docs = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], "doc_id long, text string, source string, counts string")
    rows = {r["doc_id"]: r["counts"] for r in token_counts.library_counts(docs, files).collect()}
    for version, path in files.items():
        tok = Tokenizer.from_file(path)
        assert {i: r[version] for i, r in rows.items()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    counted = token_counts.library_counts(docs, files)
    one = lambda kind, new, old: counted.select(F.lit(kind).alias("kind"), "source", F.lit("en").alias("lang"), F.lit("v").alias("version"), F.col("counts")[new].alias("tokens"), (F.col("counts")[old] if old else F.lit(None).cast("bigint")).alias("old_tokens"))
    ledger.commit("old", one("insert", "byte-50k", None))
    ledger.commit("new", one("revise", "word-49k", "byte-50k"))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v", len(texts), sum(r["word-49k"] for r in rows.values()))]
    assert token_counts.library_counts(docs.limit(0), files).count() == 0


def test_copies_that_share_an_id_or_have_none(spark, tmp_path):
    rows = [(1, "a", "en", "x y", 3), (1, "b", "en", "x y", 3), (None, "a", None, "x y", None), (2, "a", "en", "other text", 9), (None, None, None, None, None), (None, None, None, None, None), (3, "a", "en", "x y", 3)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {tuple(r) for r in q.op6_token_counts(spark, f"file://{tmp_path}").filter("version = 'space-1'").collect()}
    assert got == {("a", "en", "space-1", 2, 4), (None, None, "space-1", 2, 0)}


def test_archives_are_rolled_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    monkeypatch.setattr(warc, "BUNDLES", 4)
    import random

    rng = random.Random(0)
    text = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"http://h{i % 5}.example/{i}", text(rng.randrange(0, 2000))) for i in range(150)] + [(500, "http://big.example/", text(40_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = warc.capture_histories(pages, f"file://{tmp_path}/w").collect()
    assert {(r["key"], r["payload_bytes"]) for r in got} == {(k, len(h)) for k, _, h in rows} and len(got) == len(rows)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("*.warc.gz")]
    assert len(sizes) > 5 and sum(s > 4 * 3000 for s in sizes) <= 1
    for f in (tmp_path / "w").glob("*.warc.gz"):
        data = f.read_bytes()
        for r in got:
            if r["archive"] == f.name:
                assert warc.parse(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]))[0]["WARC-Record-ID"] == warc.record_id(r["key"])


def test_the_language_sample_is_bounded(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    alike = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"), F.lit("fr").alias("lang"))
    few = spark.createDataFrame([(1, "short", "de"), (2, "kurz", "de"), (2, "kurz", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    got = language_id.training_sample(same.unionByName(alike).unionByName(few).repartition(4), "text", "lang", "doc_id", 300).groupBy("l").count().collect()
    counts = {r["l"]: r["count"] for r in got}
    assert counts["de"] == 2 and counts.get("en", 0) <= 1 and 200 < counts["fr"] <= 300
