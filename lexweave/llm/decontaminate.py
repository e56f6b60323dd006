"""Benchmark decontamination on a distributed positional inverted index.

:func:`build_index` cuts the training texts into segments of whole documents.
A segment holds, for each of its terms, the sorted list of the positions (word
numbers within the segment) at which it stands, delta-coded.  The segments are a
stored table: they can be searched again for other items without the texts.

:func:`search` looks for phrases.  Every segment takes the windows of the test
items, orders each window's terms by their number of postings there, starts
from the postings of the rarest and intersects, term by term, with the lists of
the others, each moved by the term's offset in the window.  What is left are the
exact occurrences; they are merged to runs.  :func:`near` finds proximity
matches: all words of a term set within a span of words, in any order.

Items go to the segments in blocks of at most ``BLOCK_BYTES`` of text: that is
what is ever sent to one task, and more items mean more passes, not more memory.

Terms are 64-bit hashes of words (see :class:`~lexweave.llm.common.WordHasher`).
Words: A-Z lower-cased, runs of ASCII letters, digits and all non-ASCII characters.

Defined cases: null texts have no words; null or wordless items match nothing
and items with a null id are left out; an item of fewer words than a window is
one window; repeated documents are searched each by itself, repeated items give
their runs once; empty tables give no rows or no runs.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, alnum_table, map_arrow, materialize, text_slices, word_hash

#: Text of a segment of the index.
SEGMENT_BYTES = 8 << 20
#: Text of the items that go to the segments at once.
BLOCK_BYTES = 16 << 20
#: Candidate positions that are intersected at once.
CANDIDATES = 1 << 20


class Segment:
    """Postings of one run of documents."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, starts: np.ndarray, deltas: np.ndarray):
        self.bounds, self.terms, self.starts, self.deltas = bounds, terms, starts, deltas

    @classmethod
    def of(cls, hashes: np.ndarray, before: np.ndarray) -> Segment:
        order = np.argsort(hashes, kind="stable")
        terms, starts = np.unique(hashes[order], return_index=True)
        deltas = order.astype(np.int64)
        deltas[1:] = np.diff(order)
        deltas[starts] = order[starts]
        return cls(before.astype(np.int64), terms, np.append(starts, len(order)).astype(np.int64), deltas.astype(np.uint32))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each term here, number of its postings)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.starts[at + 1] - self.starts[at], 0)

    def postings(self, ranks: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the given terms, one list after the other, and where each list begins)."""
        begin = np.concatenate([[0], np.cumsum(count)])
        flat = np.repeat(self.starts[ranks] - begin[:-1], count) + np.arange(begin[-1])
        total = np.cumsum(self.deltas[flat], dtype=np.int64)
        base = np.concatenate([[0], total])[begin[:-1]]
        return total - np.repeat(base, count), begin


class Phrases:
    """Windows of test items: consecutive words, each item's with a number of their own."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        hasher = WordHasher(alnum_table())
        raw = [t.encode() for _, t in items]
        words, before = hasher(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))
        n = np.diff(before)
        per = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        self.ids = [i for i, _ in items]
        self.item = np.repeat(np.arange(len(items)), per)
        first = np.cumsum(per) - per
        self.begin = before[:-1][self.item] + np.arange(len(self.item)) - first[self.item]
        self.length = np.minimum(window, n[self.item])
        self.vocabulary, self.words = np.unique(words, return_inverse=True)
        self.window = window

    def occurrences(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence in the segment."""
        rank, count = segment.find(self.vocabulary)
        grid = np.minimum(self.begin[:, None] + np.arange(self.window), max(len(self.words) - 1, 0))
        real = np.arange(self.window) < self.length[:, None]
        if not len(grid):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        df = np.where(real, count[self.words[grid]], np.iinfo(np.int64).max)
        alive = np.flatnonzero(df.min(1) > 0)
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = np.unique(self.words[grid[alive]][real[alive]])  # terms whose lists are read
        positions, begin = segment.postings(rank[used], count[used])
        slot = np.zeros(len(self.vocabulary), np.int64)
        slot[used] = np.arange(len(used))
        keys = np.repeat(np.arange(len(used)), count[used]) << 34 | positions  # sorted by term, then position
        order = np.argsort(df[alive], axis=1, kind="stable")
        rarest = slot[self.words[grid[alive, order[:, 0]]]]
        size = np.diff(begin)[rarest]
        found_w, found_p = [], []
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), CANDIDATES), "left"), len(alive)))
        for a, b in zip(np.append(0, cuts)[:-1], np.append(0, cuts)[1:], strict=True):
            if a == b:
                continue
            w = np.repeat(np.arange(a, b), size[a:b])
            inner = np.arange(len(w)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
            p = positions[begin[rarest[w]] + inner] - order[w, 0]
            keep = p >= 0
            w, p = w[keep], p[keep]
            for k in range(1, self.window):
                if not len(w):
                    break
                offset = order[w, k]
                want = slot[self.words[grid[alive[w], offset]]] << 34 | (p + offset)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                keep = (keys[at] == want) | ~real[alive[w], offset]
                w, p = w[keep], p[keep]
            doc = np.searchsorted(segment.bounds, p, "right") - 1
            keep = p + self.length[alive[w]] <= segment.bounds[doc + 1]
            found_w.append(alive[w[keep]])
            found_p.append(p[keep])
        return np.concatenate(found_w), np.concatenate(found_p)

    def runs(self, segment: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first word, word after the last) of merged occurrences, by document."""
        w, p = self.occurrences(segment)
        doc, item, end = np.searchsorted(segment.bounds, p, "right") - 1, self.item[w], p + self.length[w]
        order = np.lexsort((p, item, doc))
        doc, item, p, end = doc[order], item[order], p[order], end[order]
        new = np.ones(len(p), bool)  # windows of one item have one length, so ends ascend with starts
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (p[1:] > end[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(p))[: len(at)] - 1
        shift = segment.bounds[doc[at]] if len(at) else np.zeros(0, np.int64)
        return doc[at], item[at], p[at] - shift, end[last] - shift


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index: (segment, keys, bounds, terms, starts, deltas), one row per segment."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType
    names = ["bounds", "terms", "starts", "deltas"]
    schema = T.StructType(
        [T.StructField("segment", T.StringType()), T.StructField("keys", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, hasher = TaskContext.get().partitionId(), 0, WordHasher(alnum_table())
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text", segment_bytes):
                s = Segment.of(*hasher(data, offsets))
                keys = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("key").slice(a, b - a))
                k += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{k}"]), keys] + [pa.array([x.tobytes()], pa.binary()) for x in (s.bounds, s.terms, s.starts, s.deltas)],
                    ["segment", "keys", *names]
                )

    return materialize(map_arrow(source, run, schema), "positional-index")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Segment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            blob = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
            yield batch, i, Segment(blob("bounds", np.int64), blob("terms", np.uint64), blob("starts", np.int64), blob("deltas", np.uint32))


def _item_blocks(items: DataFrame, text: str, key: str) -> Iterator[list[tuple[object, str]]]:
    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield sorted(((r["k"], r["t"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))


def search(index: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", window: int = 10) -> DataFrame:
    """(key, n_words, runs) of every indexed document; runs: item_id, first word, word after the last."""
    run_type = T.ArrayType(
        T.StructType([T.StructField("item_id", items.schema[key].dataType), T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])
    )
    key_type = index.schema["keys"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("key", key_type),
            T.StructField("n_words", T.LongType()), T.StructField("runs", run_type)
        ]
    )
    spark = index.sparkSession
    passes = []
    for block in _item_blocks(items, text, key):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value, window)
            for batch, i, s in _segments(batches):
                doc, item, first, after = phrases.runs(s)
                n = len(s.bounds) - 1
                ids = pa.array([phrases.ids[k] for k in item], _arrow(run_type.elementType["item_id"].dataType))
                runs = pa.StructArray.from_arrays([ids, pa.array(first, pa.int64()), pa.array(after, pa.int64())], ["item_id", "first", "after"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("segment")[i].as_py()] * n, pa.string()), pa.array(np.arange(n)),
                        batch.column("keys")[i].values, pa.array(np.diff(s.bounds)), lists
                    ],
                    ["segment", "ordinal", "key", "n_words", "runs"]
                )

        passes.append(map_arrow(index, run, schema))
    if len(passes) == 1:
        return passes[0].select("key", "n_words", "runs")
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.groupBy("segment", "ordinal").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs")
    ).select("key", "n_words", "runs")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def near(index: DataFrame, words: list[str], within: int) -> DataFrame:
    """(key, first, after) of the shortest spans of at most ``within`` words that hold all given words, one for each place of the rarest."""
    terms = np.unique(word_hash(WordHasher(alnum_table()), words))
    schema = T.StructType(
        [T.StructField("key", index.schema["keys"].dataType.elementType), T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, s in _segments(batches):
            rank, count = s.find(terms)
            if not len(terms) or not count.min():
                continue
            positions, begin = s.postings(rank, count)
            lists = sorted((positions[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)), key=len)
            best = np.full((len(lists[0]), 2), -1)
            for k, p in enumerate(lists[0]):
                doc = np.searchsorted(s.bounds, p, "right") - 1
                lo, hi = max(s.bounds[doc], p - within + 1), min(s.bounds[doc + 1], p + within)
                spots = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists[1:]]
                if all(len(x) for x in spots):
                    for a in np.unique(np.concatenate([[p], *(x[x <= p] for x in spots)])):
                        nexts = [x[np.searchsorted(x, a)] if np.searchsorted(x, a) < len(x) else -1 for x in spots]
                        if min([p, *nexts]) >= 0:
                            e = max([p, *nexts]) + 1
                            if e - a <= within and (best[k, 0] < 0 or e - a < best[k, 1] - best[k, 0]):
                                best[k] = a, e
            best = best[best[:, 0] >= 0]
            doc = np.searchsorted(s.bounds, best[:, 0], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("keys")[i].values.take(pa.array(doc)), pa.array(best[:, 0] - s.bounds[doc]), pa.array(best[:, 1] - s.bounds[doc])],
                ["key", "first", "after"]
            )

    return map_arrow(index, run, schema)


def hit_words(runs: str = "runs"):
    """Words covered by a document's runs, each counted once."""
    return F.expr(
        f"aggregate(array_sort(transform({runs}, r -> struct(r.first AS f, r.after AS a))), struct(0L AS last, 0L AS n), (s, r) -> struct(greatest(s.last, r.a) AS last, s.n + greatest(0L, r.a - greatest(r.f, s.last)) AS n), s -> s.n)"
    )


def hit_items(runs: str = "runs"):
    """Ids, as sorted strings, of the items with runs in a document."""
    return F.expr(f"array_sort(array_distinct(transform({runs}, r -> cast(r.item_id AS string))))")
