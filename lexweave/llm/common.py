"""Scratch tables, Arrow text buffers and vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import shared_folder

#: Bytes of text that one vectorised step works on; a longer text is one step by itself.
SLICE_BYTES = 2 << 20
#: Bytes of rows that go to a Python worker at once; a larger row goes by itself.
BATCH_BYTES = 4 << 20


# ---------------------------------------------------------------- scratch --
def scratch_dir(spark: SparkSession) -> str:
    """The shared folder (:func:`~lexweave.functions.scratch.shared_folder`)."""
    return shared_folder(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    return materialize_at(df, name, compression)[0]


def materialize_at(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """The same, and the folder, for :func:`drop_scratch`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate rows that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _give_back() -> None:
    """Memory that this worker's allocators hold goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` on batches bounded by bytes; workers, which live on, keep nothing after a partition.

    The bound is a setting of the session and is left alone where one is set.
    """
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll and name not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(name, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def remainder(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ------------------------------------------------------------------- text --
def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column, without copying texts; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, first = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    ends = np.frombuffer(offsets, np.int64 if large else np.int32, n + 1, first * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    return raw[ends[0] : ends[-1]], ends - ends[0], valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together (one longer text is a run)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of a batch's texts."""
    data, offsets, _ = text_bytes(batch.column(column))
    for a, b in slices(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of at most ``limit`` bytes of text, or one longer text, across batches."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets, _ = text_bytes(rows.column(column))
        return rows, data, offsets

    for batch in batches:
        for a, b, data, _ in text_slices(batch, column, limit):
            if held and size + len(data) > limit:
                yield joined()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += len(data)
    if held:
        yield joined()


# ------------------------------------------------------------------ words --
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum_table() -> np.ndarray:
    """After lower-casing A-Z: words are runs outside 00-2F, 3A-60 and 7B-7F (all bytes from 80 on are in words)."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def nonspace_table() -> np.ndarray:
    """Words are runs of anything but 20 and 09-0D."""
    table = np.ones(256, bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """Words of many texts at once, as 64-bit hashes (XXH3 of the word's bytes).

    Distinct words are found by their bytes, so each is hashed once.  XXH3 mixes
    and has no known structured collisions, but it is no cryptographic hash: of
    a thousand million distinct words some two meet with a chance of a few per
    cent, and words made to collide can.  Where a single false match matters,
    compare the words themselves.
    """

    def __init__(self, is_word: np.ndarray, lower: bool = True):
        self.is_word, self.lower = is_word, lower_table() if lower else None

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, words before each document and in all)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        inside = self.is_word[data] if self.lower is None else self.is_word[self.lower][data]
        edge = np.empty_like(inside)
        edge[0] = inside[0]
        np.greater(inside[1:], inside[:-1], out=edge[1:])
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        edge[cuts] = inside[cuts]  # a text begins here
        starts = np.flatnonzero(edge)
        edge[-1] = inside[-1]
        np.greater(inside[:-1], inside[1:], out=edge[:-1])
        last = cuts[cuts > 0] - 1
        edge[last] = inside[last]
        return starts, np.flatnonzero(edge) + 1, np.searchsorted(starts, offsets)

    def distinct(self, data: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words, each word's place among them, words before each document and in all); ``spans``: those of the same texts, if they are known."""
        starts, ends, counts = spans or self.spans(data, offsets)
        if not len(starts):
            return pa.array([], pa.binary()), np.zeros(0, np.int32), counts
        if self.lower is not None:
            data = self.lower[data]
        bounds = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=bounds[1:])
        packed = np.ascontiguousarray(data[self.is_word[data]])
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(), counts

    @staticmethod
    def hashes(words: pa.Array) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))

    def __call__(self, data: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, words before each document and in all); ``spans``: those of the same texts, if they are known."""
        words, place, counts = self.distinct(data, offsets, spans)
        return self.hashes(words)[place], counts


def word_hash(hasher: WordHasher, words: list[str]) -> np.ndarray:
    """Hashes of given single words (each must be a word by the hasher's rule)."""
    raw = [w.encode() for w in words]
    return hasher(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, sum(map(len, raw)) + max(0, len(raw) - 1)]))[0]


# ----------------------------------------------------------------- groups --
def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; the rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            codes = np.asarray(batch.column(k).dictionary_encode().indices.fill_null(-1))
            change[1:] |= codes[1:] != codes[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal keys and the groups' bounds; the rows come sorted by the keys."""
    held: list[pa.Table] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            held.append(pa.Table.from_batches([batch]))
        if not held:
            continue
        table = pa.concat_tables(held).combine_chunks()
        change = np.ones(table.num_rows, bool)
        change[1:] = False
        for k in keys:
            codes = np.asarray(table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1))
            change[1:] |= codes[1:] != codes[:-1]
        bounds = np.append(np.flatnonzero(change), table.num_rows)
        if batch is None:
            yield table, bounds
        else:  # the last group may go on in the next batch
            held = [table.slice(bounds[-2])]
            if len(bounds) > 2:
                yield table.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]

