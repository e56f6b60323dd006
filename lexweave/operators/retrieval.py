"""Exhaustive cosine search: candidate partitions against blocks of queries, by matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import Bests

#: Queries whose vectors go to all executors at once; more take further passes.
QUERY_BLOCK = 4_000
#: Cosines of one pair of vectors may differ by so much, as sums are taken in another order.
NOISE = 1e-12


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    n = np.sqrt(np.square(x).sum(1))
    if not np.isfinite(n).all() or (n == 0).any():
        raise ValueError("vectors must be finite and not zero")
    return x / n[:, None]


def _query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = part.select(*columns).toArrow().combine_chunks()  # at most about QUERY_BLOCK vectors
        if table.num_rows:
            yield table


def _products(batches: Iterator[pa.RecordBatch], ids: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidates' own ids, canonical ids, cosines of candidates with queries) of batches, canonical ids ascending; a query's own vector has none."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.take(pa.array(np.argsort(batch.column("canonical_id").to_numpy(), kind="stable")))
        own = batch.column("own_id").to_numpy()
        s = _matrix(batch.column("vector"), batch.num_rows) @ unit.T
        yield own, batch.column("canonical_id").to_numpy(), np.where(own[:, None] == ids, -np.inf, s)


class _Pooled:
    """A block of exact scores, by canonical."""

    def __init__(self, canonical: np.ndarray, scores: np.ndarray):
        first = np.flatnonzero(np.diff(canonical, prepend=canonical[0] - 1))
        self.canonical = canonical[first]
        self._pooled = scores if len(first) == len(canonical) else np.maximum.reduceat(scores, first, axis=0)

    def pooled(self) -> np.ndarray:
        return self._pooled

    def settle(self, least: np.ndarray) -> None:
        pass


def _candidates(candidates: DataFrame) -> DataFrame:
    own = F.col("own_id") if "own_id" in candidates.columns else F.col("canonical_id")
    return candidates.select(F.col("canonical_id").cast("long"), own.cast("long").alias("own_id"), "vector")


def cosine_scores(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, canonical_id, score): each task's best ``k`` canonicals of every query, by its best vector.

    queries: (query_id, vector); candidates: (canonical_id, vector) and, where a
    canonical has several vectors, own_id.  A query's own id is no candidate.
    Partial lists of ``k`` are merged by maximum and rank.
    """
    spark, out = queries.sparkSession, None
    for table in _query_blocks(queries, ["query_id", "vector"]):
        ids = table.column("query_id").to_numpy()
        sent = spark.sparkContext.broadcast((ids, _matrix(table.column("vector").combine_chunks(), len(ids))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, unit = sent.value
            bests = Bests(len(ids), k)
            for _, canonical, scores in _products(batches, ids, unit):
                bests.add(_Pooled(canonical, scores))
            q, canonical, score = bests.rows
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(canonical), pa.array(score)], ["query_id", "canonical_id", "score"])

        found = _candidates(candidates).mapInArrow(run, "query_id bigint, canonical_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, canonical_id bigint, score double")


def cosine_ranks(queries: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, canonical_id, expected_score, expected_rank) of each query's expected candidate, by counting the candidates that beat it.

    Each candidate has one vector, so tasks count apart; scores that differ by
    no more than the noise of sums count as equal and go to the smaller id.
    """
    spark, out = queries.sparkSession, None
    target = candidates.select(F.col("canonical_id").cast("long"), F.col("vector").alias("target"))
    own = queries.join(expected.select("query_id", "canonical_id"), "query_id").filter("query_id <> canonical_id").join(target, "canonical_id")
    for table in _query_blocks(own, ["query_id", "canonical_id", "vector", "target"]):
        ids, n = table.column("query_id").to_numpy(), table.num_rows
        unit = _matrix(table.column("vector").combine_chunks(), n)
        score = (unit * _matrix(table.column("target").combine_chunks(), n)).sum(1)
        sent = spark.sparkContext.broadcast((ids, unit, table.column("canonical_id").to_numpy(), score))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, unit, target, score = sent.value
            count = np.zeros(len(ids), np.int64)
            for _, canonical, scores in _products(batches, ids, unit):
                above = scores - score
                better = (above > NOISE) | ((above >= -NOISE) & (canonical[:, None] < target))
                count += (better & (canonical[:, None] != target)).sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(target), pa.array(score), pa.array(count)], ["query_id", "canonical_id", "expected_score", "n"]
            )

        found = _candidates(candidates).mapInArrow(run, "query_id bigint, canonical_id bigint, expected_score double, n bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, canonical_id bigint, expected_score double, expected_rank bigint")
    return out.groupBy("query_id", "canonical_id", "expected_score").agg((F.sum("n") + 1).alias("expected_rank"))
