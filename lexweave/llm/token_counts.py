"""Token counts as delta-maintained rollups.

A ledger holds, for each committed batch, the batch's signed sums by source,
language and tokenizer version: documents and tokens added, taken away or
revised.  Totals are additive, so they are the sum over batches; no document is
read again to maintain them.

Commits are idempotent: a batch is a folder named by its id, written by one
overwriting job under Spark's commit protocol, beside a digest of its sums.
Committing an id again changes nothing; other sums under the same id are refused.
A failed commit leaves no ``_SUCCESS`` mark, counts for nothing and may be
repeated.  :func:`compact` folds the batches that stand when it begins into one
folder and remembers their ids and digests, so that a late repeat is still
recognised; a batch committed meanwhile is neither in that folder nor lost.

A change row says what happened to one document under one tokenizer version:

* ``insert``: its tokens are added;
* ``delete``: its tokens, as counted when it was inserted, are taken away;
* ``revise``: ``tokens`` replace ``old_tokens``.

Defined cases: a null source, language or version is a group of its own; null
counts are 0; an unknown kind of change is an error; repeated rows count as
often as they stand there, repeated commits of a batch once; a group whose
documents and tokens are both 0 again is left out of the totals; empty batches
are committed like others; an empty ledger gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, text_slices
from .token_files import PieceEncoder, describe

GROUP = ("source", "lang", "version")
SUMS = ("documents", "tokens")
SCHEMA = "source string, lang string, version string, documents bigint, tokens bigint"

#: Versions that need no file, as patterns of their tokens: runs of non-space; of ASCII letters, digits and characters from 80 on; of letters, of digits and of other marks.
TOKENIZERS = {"letters-1": r"\p{L}+|\p{N}+|[^\x09-\x0D\x20\p{L}\p{N}]+", "space-1": r"[^\x20\x09-\x0D]+", "word-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"}


def count_tokens(text: str | Column, version: str) -> Column:
    """Tokens of a whole text; none in a null one."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(TOKENIZERS[version])), F.lit(0)).cast("bigint")


def library_counts(docs: DataFrame, files: dict[str, str], text: str = "text", into: str = "counts") -> DataFrame:
    """``docs`` with a map of version to tokens of the whole text, by files of the tokenizers library; a null text has none.

    A new version's counts revise an old one's without reading anything but the texts.
    """
    texts = {v: Path(f).read_text(encoding="utf-8") for v, f in files.items()}
    sent = docs.sparkSession.sparkContext.broadcast({v: (d, describe(d)) for v, d in texts.items()})  # tokenizers' size
    kept = [c for c in docs.columns if c != into]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(into, T.MapType(T.StringType(), T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {v: PieceEncoder(*d) for v, d in sent.value.items()}
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, text):
                each = [np.diff(e.encode(data, offsets, 0)[1]) - 1 for e in encoders.values()]  # less the end id
                values = pa.array(np.stack(each, 1).ravel() if each else [], pa.int64())
                keys = pa.array(list(encoders) * (b - a), pa.string())
                bounds = pa.array(np.arange(b - a + 1) * len(encoders), pa.int32())
                counts = pa.MapArray.from_arrays(bounds, keys, values)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + [counts], [*kept, into])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in kept]), run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes (kind, source, lang, version, tokens, old_tokens)."""
    new, old = F.coalesce("tokens", F.lit(0)).cast("bigint"), F.coalesce("old_tokens", F.lit(0)).cast("bigint")
    kind = F.col("kind")
    fail = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("bigint")
    documents = F.when(kind == "insert", F.lit(1)).when(kind == "delete", F.lit(-1)).when(kind == "revise", F.lit(0)).otherwise(fail).cast("bigint")
    tokens = F.when(kind == "insert", new).when(kind == "delete", -new).when(kind == "revise", new - old).otherwise(fail)
    return changes.select(*GROUP, documents.alias("documents"), tokens.alias("tokens"))


class Ledger:
    """The committed batches under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def batches(self) -> list[str]:
        """Ids of the committed batch folders."""
        fs, where = self._fs(f"{self.path}/batches")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(n for n in names if self._done(f"{self.path}/batches/{n}"))

    def _done(self, path: str) -> bool:
        fs, where = self._fs(f"{path}/_SUCCESS")
        return fs.exists(where)

    def compacted(self) -> tuple[str | None, dict[str, str]]:
        """(the newest compacted folder, digests of the batches in it by id)."""
        fs, where = self._fs(f"{self.path}/compact")
        names = sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True) if fs.exists(where) else []
        for n in names:
            if self._done(f"{self.path}/compact/{n}/ids") and self._done(f"{self.path}/compact/{n}/sums"):
                rows = self.spark.read.schema("id string, digest string").parquet(f"{self.path}/compact/{n}/ids").collect()  # one row per batch
                return f"{self.path}/compact/{n}/sums", {r["id"]: r["digest"] for r in rows}
        return None, {}

    def _digest(self, batch: str) -> str | None:
        path = f"{self.path}/digests/{batch}"
        return self.spark.read.text(path).first()[0] if self._done(path) else None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if a compaction already holds it."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError("a batch id names a folder")
        sums = signed(changes).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        staged = materialize(sums, "ledger-batch")
        # order is no matter: a sum of row hashes, and the number of rows
        found = staged.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*GROUP, *SUMS).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        digest = f"{found['n']}-{found['h']}"
        _, held = self.compacted()
        standing = self._done(f"{self.path}/batches/{batch}")
        known = held.get(batch) or (self._digest(batch) if standing else None)
        if known is not None and known != digest:
            raise ValueError(f"batch {batch} was committed with other changes")
        if batch in held:
            return False
        if not standing:
            self.spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/digests/{batch}")
            staged.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _sum(self, names: list[str], folder: str | None) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in names] + ([folder] if folder else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over all committed batches."""
        folder, ids = self.compacted()
        return self._sum([b for b in self.batches() if b not in ids], folder)

    def compact(self) -> None:
        """Fold the batches committed so far into one folder of totals; one compaction runs at a time."""
        folder, ids = self.compacted()
        names = [b for b in self.batches() if b not in ids]  # taken once: sums, ids and what is deleted agree
        digests = ids | {b: self._digest(b) or "" for b in names}
        fs, where = self._fs(f"{self.path}/compact")
        last = max((int(s.getPath().getName()) for s in fs.listStatus(where)), default=-1) if fs.exists(where) else -1
        target = f"{self.path}/compact/{last + 1:08d}"
        self._sum(names, folder).write.mode("overwrite").parquet(f"{target}/sums")
        self.spark.createDataFrame(sorted(digests.items()), "id string, digest string").write.mode("overwrite").parquet(f"{target}/ids")
        for n in names:  # the ids file stands, so these count no more
            for kind in ("batches", "digests"):
                fs, where = self._fs(f"{self.path}/{kind}/{n}")
                fs.delete(where, True)
