"""Providers of embeddings and decisions: any callable on batches, with retries; live ones are the user's."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_retries(call: Callable, attempts: int = 4, first_wait: float = 1.0) -> Callable:
    """Calls again after growing waits; the last failure is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(first_wait * 2**k)

    return run


def embed(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 512, longest: int = 8192) -> DataFrame:
    """Distinct texts with their vectors, asked for in batches on the executors; texts beyond ``longest`` bytes are an error."""
    source = texts.select(text).distinct().withColumn(
        text, F.when(F.octet_length(text) > longest, F.raise_error(F.lit("a text is too long")).cast("string")).otherwise(F.col(text))
    )
    ask = with_retries(provider)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f[text].iloc[a : a + batch].tolist()
                found = ask(part)
                if len(found) != len(part):
                    raise ValueError("the provider left texts out")
                yield pd.DataFrame({text: part, "embedding": found})

    return source.mapInPandas(run, f"{text} string, embedding array<float>")


def decide(cases: DataFrame, provider: Callable[[str], str], payload: str = "payload") -> DataFrame:
    """Cases with ``response``, the provider's raw answer; parse it after it is stored."""
    ask = with_retries(provider)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(ask)

    return cases.withColumn("response", run(payload))
