"""The corpus pipeline: stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import byte_bpe, decontaminate, language_id, ngram_join, quality
from lexweave.llm.common import materialize

#: A document stays if some language is this many times as likely as by chance (0.3 with four languages): a higher bound would take clean, short texts.
LANGUAGE_TIMES = 1.2
#: A document stays if its quality score is at least this.
QUALITY_SCORE = 0.7


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a language (null, or no letter) or with none that stands out go."""
    net = language_id.train(docs)
    least = min(1.0, LANGUAGE_TIMES / max(1, len(net.languages)))
    found = language_id.predict(docs, net, lang_col="_lw_lang", score_col="_lw_score")
    return found.filter((F.col("_lw_lang") != language_id.UNDETERMINED) & (F.col("_lw_score") >= least)).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: texts that score below the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.document_statistics(docs), labels)
    return quality.score_documents(docs, model, score_col="_lw_score").filter(F.col("_lw_score") >= QUALITY_SCORE).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies, the document with the smallest id stays.

    A document with a null id, or without words, is its own group and stays.
    Rows of one id are told apart by their texts; of repeated rows (same id and
    text) one stays.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    own = docs.withColumn("_lw_key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", digest.alias("digest"))))
    groups = ngram_join.jaccard_groups(own.select("_lw_key", "text"), key="_lw_key")
    gone = groups.filter("group_id <> key").select(F.col("key").alias("_lw_key")).distinct()
    left = own.join(gone, "_lw_key", "left_anti")
    repeated = own.filter("_lw_key IS NOT NULL").groupBy("_lw_key").count().filter("count > 1").select("_lw_key")
    once = left.join(repeated, "_lw_key", "left_semi").dropDuplicates(["_lw_key"])
    return left.join(repeated, "_lw_key", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: texts that hold a window of ten words of a benchmark item go.

    Whether one does depends on its text alone, so texts are told apart by a
    digest and rows with null or repeated ids are treated like all others.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    index = decontaminate.build_index(docs.select("text", digest.alias("digest")), key="digest")
    found = decontaminate.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    gone = found.filter(F.size("runs") > 0).select("key").distinct()
    return docs.join(gone, digest == F.col("key"), "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of each text that stayed, and whether they decode to its bytes."""
    v = byte_bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    source = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    encoded = byte_bpe.encode(source, v)
    counted = encoded.select(
        "doc_id", "lang", "source", "text_sha256", F.size("ids").cast("bigint").alias("n_tokens"),
        byte_bpe.ids_digest().alias("ids_sha256"), F.col("ids").alias("input_ids"), "ids"
    )
    decoded = byte_bpe.decode(counted, v)
    return decoded.select(
        "doc_id", "lang", "source", "n_tokens", "input_ids", "ids_sha256",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip")
    )


STAGES = [
    ("language_id", keep_language), ("quality", keep_quality), ("ngram_join", keep_one_of_each), ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize)
]

#: No SQL: learned models and byte-pair merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
