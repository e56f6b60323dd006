"""Works as a stream: the batch accumulators over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profiles import length_band


def running_profiles(member_works: DataFrame) -> DataFrame:
    """Profile sums of a stream of (profile, word_count, complete, restricted); run in complete or update mode."""
    band = length_band("word_count")
    return member_works.groupBy("profile").agg(
        F.count("*").alias("n"), F.count("word_count").alias("words_n"), *[F.count_if(band == b).alias(f"band_{b}") for b in range(4)],
        F.count_if("complete").alias("complete"), F.count_if("restricted").alias("restricted")
    )
