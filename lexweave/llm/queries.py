"""The thin queries over the operators of this package, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, language_id, lattice_dedup, lm, ngram_join, quality, sql, token_counts, token_files, warc
from .common import materialize, remainder, scratch_path
from .components import spread_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality score; learnt from the rows whose crc32 remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality.document_statistics(docs), "op1-statistics")
    model = quality.fit(stats.filter(remainder("key", 4) != 2), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(stats, model).select(
        F.col("key").alias("doc_id"), (remainder("key", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of equal-label vectors at a cosine of 0.98 or more, and their components."""
    found = lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("key").alias("vec_id"), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal 5-gram sets, its links at a similarity of 0.8 or more, and its group."""
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("key", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as it stands in the merged index of the archives written."""
    merged = warc.capture_histories(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return merged.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability; learnt from the rows whose crc32 remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm.score_documents(docs, remainder("doc_id", 7) != 2)
    return found.select(
        F.col("key").alias("doc_id"), (remainder("key", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after the life of a corpus.

    All documents come in with counts (for one version guessed from their
    length and revised later), then exact copies are deleted; a commit is repeated on the way.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    counts = F.map_from_arrays(F.array(*map(F.lit, token_counts.TOKENIZERS)), F.array(*[token_counts.count_tokens("text", v) for v in token_counts.TOKENIZERS]))
    counted = materialize(
        docs.select(
            "doc_id", "source", "lang", F.coalesce(F.expr("n_chars div 6"), F.lit(0)).alias("guess"),
            F.sha2(F.col("text").cast("binary"), 256).alias("digest"), counts.alias("counts")
        ),
        "op6-counts"
    )
    # one row of each text stays: that with the smallest id, nulls last; of rows with equal ids, sources and languages any
    named = counted.filter("digest IS NOT NULL").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang"))
    alike = materialize(named.groupBy("digest", "place").agg(F.count("*").alias("n"), F.first("counts").alias("counts")), "op6-alike")
    firsts = alike.groupBy("digest").agg(F.min("place").alias("first"), F.sum("n").alias("rows")).filter("rows > 1").select("digest", "first")
    gone = spread_join(alike, firsts, "digest", alike.count()).withColumn("n", F.col("n") - (F.col("place") == F.col("first")).cast("int")).filter("n > 0")
    copies = gone.select("place.source", "place.lang", "counts", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    each = F.explode("counts").alias("version", "exact")
    guessed = F.when(F.col("version") == "space-1", F.col("guess")).otherwise(F.col("exact"))
    ledger = token_counts.Ledger(spark, scratch_path(spark, "op6-ledger"))
    base = counted.select("source", "lang", "guess", each)
    ledger.commit(
        "1-load",
        base.select(F.lit("insert").alias("kind"), "source", "lang", "version", guessed.alias("tokens"), F.lit(None).cast("bigint").alias("old_tokens"))
    )
    revised = base.filter("version = 'space-1'").select(
        F.lit("revise").alias("kind"), "source", "lang", "version", F.col("exact").alias("tokens"), F.col("guess").alias("old_tokens")
    )
    ledger.commit("2-revise", revised)
    ledger.compact()
    ledger.commit("2-revise", revised)  # a repeat changes nothing
    ledger.commit(
        "3-copies",
        copies.select("source", "lang", each).select(
            F.lit("delete").alias("kind"), "source", "lang", "version", F.col("exact").alias("tokens"),
            F.lit(None).cast("bigint").alias("old_tokens")
        )
    )
    return ledger.totals()


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as they come back from the token files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("key", "doc_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document, by the positional index."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decontaminate.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    found = found.select(F.col("key").alias("doc_id"), "n_words", decontaminate.hit_words().alias("n_hit"), decontaminate.hit_items().alias("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids by the rank file, and what they decode to."""
    v = byte_bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), v)
    counted = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), byte_bpe.ids_digest().alias("ids_sha256"), "ids")
    return byte_bpe.decode(counted, v).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language; learnt from the rows whose crc32 remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.train(docs.filter(remainder("doc_id", 3) != 1))
    return language_id.predict(docs, net, columns=["doc_id"]).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_embedding_dedup, op3_ngram_join, op4_warc, op5_lm_scoring, op6_token_counts, op7_token_files, op8_decontaminate, op9_byte_bpe, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": sql.OP2, "op3_ngram_join": sql.OP3, "op4_warc": sql.OP4, "op6_token_counts": sql.OP6, "op8_decontaminate": sql.OP8}
