"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

A text's words (A-Z lower-cased, runs of ASCII letters, digits and all other
non-ASCII characters) give overlapping n-grams; a text of fewer words, but not
none, is one n-gram.  Texts with equal n-gram sets form a class, which the
set's digest stands for from there on; keys come back at the end.

Steps, each over all rows:

1. one pass over the texts makes MinHash signatures, hashed into bands; the
   number of bands and of rows in a band follow from the threshold and the
   target recall (:func:`plan_bands`);
2. band hashes are shuffled; each band bucket with several classes adds one edge
   from each member to its smallest, and connected components of those edges
   collect what can possibly be linked (a star, never all pairs);
3. only texts in such components are read again; their n-gram sets go to blocks
   of the component.  A component of many classes is cut into chunks, by number
   and bytes, and each pair of chunks is a block of its own, so no task holds more
   than two chunks and every pair still meets exactly once; a component that is a
   long chain of chance meetings is dealt by its band buckets instead
   (:func:`_by_buckets`);
4. a block verifies the pairs that share a band on their full sets and returns,
   for each class, its number of linked documents and the edges that join the
   block's linked classes, again a star;
5. connected components of those edges are the join's groups.

Defined cases: null texts and texts without words link with nothing; repeated
rows (equal keys and n-gram sets) count as one document for links and each get a
result row; rows of one key with different sets are documents of their own; an
empty table gives an empty result; a null key is a document of its own that
links with nothing.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, alnum_table, grouped, map_arrow, materialize, mix64, partitions, text_slices
from .components import connected_components, spread_join

#: Classes in a chunk of a large component, and bytes of their sets, about; a block holds two chunks.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: A component with more chunks may be compared bucket by bucket instead.
MOST_CHUNKS = 16
#: What a set sent to a bucket costs, against one sent to a pair of chunks.
BUCKET_COST = 1.0
#: Shingle columns of one dense product.
COLUMNS = 4096


def plan_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective plan of at most ``most`` hashes that finds a pair at the threshold with the target recall."""
    best = (most, 1)
    for rows in range(1, 13):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, n-grams before each document and in all), repeats included."""
    words, before = hasher(data, offsets)
    counts = np.diff(before)
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    total = np.concatenate([[0], np.cumsum(per)])
    if not total[-1]:
        return np.zeros(0, np.uint64), total
    multipliers = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    width = max(0, len(words) - n + 1)
    full = np.zeros(width, np.uint64)
    for k in range(n):
        full += words[k : k + width] * multipliers[k]
    out = np.empty(total[-1], np.uint64)
    doc = np.repeat(np.arange(len(counts)), per)
    at = before[:-1][doc] + np.arange(len(doc)) - total[:-1][doc]
    long = counts[doc] >= n
    out[long] = full[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        weighted = words[before[i] : before[i + 1]] * multipliers[: counts[i]]
        out[total[i]] = np.append(weighted, multipliers[-1:] * np.array([counts[i]], np.uint64)).sum()
    return mix64(out), total


class MinHasher:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Band codes (documents with an n-gram, bands), 64 bits each; the band's number is part of the code."""
        begin = total[:-1][np.diff(total) > 0]
        codes = np.empty((len(begin), self.bands), np.uint64)
        for band in range(self.bands):
            code = np.full(len(begin), mix64(np.array([band + 1], np.uint64))[0])
            for k in range(band * self.rows, (band + 1) * self.rows):
                code = mix64(code ^ np.minimum.reduceat(hashes * self.a[k] + self.b[k], begin))
            codes[:, band] = code
        return codes


def sets_of(hashes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of each document, and their offsets."""
    doc = np.repeat(np.arange(len(total) - 1), np.diff(total))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, d = hashes[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[first], np.searchsorted(d[first], np.arange(len(total)))


def digests(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A digest of each n-gram set; None for an empty one."""
    has = np.diff(bounds) > 0
    sums = [np.zeros(len(has), np.uint64) for _ in range(2)]
    for s, salt in zip(sums, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
        mixed = mix64(sets ^ np.uint64(salt))
        s[has] = np.add.reduceat(mixed, bounds[:-1][has]) if has.any() else 0
    return [sums[0][i].tobytes() + sums[1][i].tobytes() + int(bounds[i + 1] - bounds[i]).to_bytes(4, "little") if has[i] else None for i in range(len(has))]


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(key, digest of the n-gram set, bands): a null digest stands for no n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minhash = WordHasher(alnum_table()), MinHasher(bands, rows)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                hashes, total = shingles(hasher, data, offsets, n)
                codes = minhash(hashes, total)
                has = np.diff(total) > 0
                sets, bounds = sets_of(hashes, total)
                digest = digests(sets, bounds)
                blobs, k = [None] * (b - a), 0
                for i in np.flatnonzero(has):
                    blobs[i], k = codes[k].tobytes(), k + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), pa.array(digest, pa.binary()), pa.array(blobs, pa.binary())],
                    ["key", "digest", "codes"]
                )

    return map_arrow(docs, run, f"key {docs.schema['key'].dataType.simpleString()}, digest binary, codes binary")


def _entries(classes: DataFrame, bands: int, name: str) -> DataFrame:
    """(key, code, and the other columns) of every class and band."""
    kept = [c for c in classes.columns if c != "codes"]
    schema = T.StructType([classes.schema[c] for c in kept] + [T.StructField("code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(x.as_py() for x in batch.column("codes")), np.int64)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in kept], pa.array(codes)], [*kept, "code"])

    return materialize(map_arrow(classes, run, schema), name)


def _stars(classes: DataFrame, bands: int) -> DataFrame:
    """(a, b): each member of a band bucket and the bucket's smallest class."""
    entries = _entries(classes.select("key", "codes"), bands, "ngram-bands")
    heads = entries.groupBy("code").agg(F.min("key").alias("head"), F.count("*").alias("n")).filter("n > 1").select("code", "head")
    return entries.join(heads, "code").filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()


def _deal(blocks: DataFrame) -> DataFrame:
    """Rows once for each pair of chunks that theirs is in."""
    pair = F.explode(F.expr("transform(sequence(0, cast(chunks AS int) - 1), c -> struct(least(c, chunk) AS low, greatest(c, chunk) AS high))"))
    return blocks.withColumn("p", pair).select(
        "key", "component", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "chunk", "copies", "codes", "grams", "own"
    )


def _by_buckets(blocks: DataFrame, bands: int) -> tuple[DataFrame, DataFrame | None]:
    """(what is to be compared within components, what within band buckets or None).

    A component is a group of near copies, or a chain of chance meetings.  Of a
    group every pair of chunks must meet; of a long chain few do, and its sets
    are sent less often if only the members of a bucket meet.  Where a component
    has many chunks, the way that sends fewer sets is taken; both find the same
    pairs.
    """
    large = blocks.filter(F.col("chunks") > MOST_CHUNKS)
    if large.isEmpty():
        return blocks, None
    own = large.select("key", "codes", F.octet_length("grams").cast("bigint").alias("bytes")).dropDuplicates(["key"])
    entries = _entries(own, bands, "ngram-large-bands")
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("size") / CHUNK_BYTES)).alias("parts")
    buckets = materialize(
        entries.groupBy("code").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).filter("n > 1").select("code", parts),
        "ngram-buckets"
    )
    meets = materialize(spread_join(entries.select("key", "code"), buckets, "code", entries.count()), "ngram-meets")
    sent = large.select("key", "component", "chunks").dropDuplicates(["key"]).join(meets.groupBy("key").agg(F.sum("parts").alias("sent")), "key", "left")
    chains = materialize(
        sent.groupBy("component").agg(
            F.sum("sent").alias("sent"), F.sum("chunks").alias("direct")
        ).filter(F.col("sent") * BUCKET_COST < F.col("direct")).select("component"),
        "ngram-chains"
    )
    scattered = large.join(chains, "component", "left_semi").drop("own", "chunks", "chunk", "component").join(meets, "key")
    scattered = scattered.select(
        "key", F.unhex(F.hex("code")).alias("component"), F.col("parts").alias("chunks"),
        F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("chunk"), "copies", "codes", "grams", F.col("code").alias("own")
    )
    return blocks.join(chains, "component", "left_anti"), scattered


def verify_block(sets: list[np.ndarray], codes: np.ndarray, half: np.ndarray, threshold: float, own: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, that share a band and whose sets have a Jaccard similarity of at least the threshold.

    ``half``: the chunk of each member; if there are two, only pairs across them
    count.  ``own``: the code that all share, in the block of a bucket; pairs that
    share a smaller one are left to that one's.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    two = len(np.unique(half)) > 1
    left = np.flatnonzero(half == half.min()) if two else np.arange(n)
    right = np.flatnonzero(half == half.max()) if two else np.arange(n)
    shared = np.zeros((len(left), len(right)), bool)
    for k in range(codes.shape[1]):
        equal = codes[left, k][:, None] == codes[right, k][None]
        shared |= equal if own is None else equal & (codes[left, k] < own)[:, None]
    if own is not None:
        shared = ~shared
    small, large = np.minimum(size[left][:, None], size[right][None]), np.maximum(size[left][:, None], size[right][None])
    shared &= small >= threshold * large - 1e-9
    if not two:
        shared &= left[:, None] < right[None]
    i, j = np.nonzero(shared)
    if not len(i):
        return i, j
    i, j = left[i], right[j]
    # either every pair by itself, or all at once by products of 0/1 matrices: whichever is less work
    flat = np.concatenate(sets)
    if len(i) * (40_000 + 60 * float(size.mean())) < 0.05 * len(left) * len(right) * min(len(flat), 5 * size.max() + n) + 2_000_000:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        owner = np.repeat(np.arange(n), size)
        values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        several = count > 1
        column = np.cumsum(several) - 1
        use = several[inverse]
        owner, inverse = owner[use], column[inverse[use]]
        order = np.argsort(inverse, kind="stable")
        owner, inverse = owner[order], inverse[order]
        total = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(several.sum()), COLUMNS):
            a, b = np.searchsorted(inverse, [lo, lo + COLUMNS])
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[a:b], inverse[a:b] - lo] = 1
            total += m[left] @ m[right].T
        row, col = np.zeros(n, np.int64), np.zeros(n, np.int64)
        row[left], col[right] = np.arange(len(left)), np.arange(len(right))
        common = total[row[i], col[j]].astype(np.int64)
    linked = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[linked], j[linked]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member linked, directly or not, with each of ``n``."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(key, class_id, n_links, group_id) of every row.

    class_id: the smallest key with an equal n-gram set; n_links: other
    documents whose similarity is at least the threshold, copies included;
    group_id: the smallest key reachable by links.
    """
    spark = docs.sparkSession
    bands, rows = plan_bands(threshold, recall)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    signed = materialize(_signatures(source, n, bands, rows), "ngram-signatures")
    worded = signed.filter("key IS NOT NULL AND digest IS NOT NULL")
    classes = materialize(
        worded.groupBy("digest").agg(F.min("key").alias("first"), F.count_distinct("key").alias("copies"), F.min_by("codes", "key").alias("codes")),
        "ngram-classes"
    )
    maybe = connected_components(_stars(classes.withColumnRenamed("digest", "key"), bands), name="ngram-maybe")
    size = F.hex(F.substring("node", 17, 4))  # a digest ends with its set's size, the lowest byte first
    grams = F.conv(F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    sizes = maybe.groupBy("component").agg(F.count("*").alias("members"), F.sum(grams).alias("grams"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("grams") * 8 / CHUNK_BYTES))
    # a component's members spread evenly over its chunks by a hash of their digest
    numbered = spread_join(maybe, sizes, "component", maybe.count()).withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    members = materialize(
        numbered.join(classes, F.col("node") == F.col("digest")).select(
            F.col("first").alias("key"), "digest", "component", "chunks", "chunk", "copies", "codes"
        ),
        "ngram-members"
    )
    blocks = materialize(_with_sets(source.join(members, "key"), n), "ngram-sets", "lz4")
    within, scattered = _by_buckets(blocks.withColumn("own", F.lit(None).cast("bigint")), bands)
    dealt = _deal(within)
    if scattered is not None:
        dealt = dealt.unionByName(_deal(scattered))
    keys = ["component", "low", "high"]
    sorted_ = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "key")
    found = materialize(_verified(sorted_, keys, threshold), "ngram-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = connected_components(found.filter("root <> key").select(F.col("key").alias("a"), F.col("root").alias("b")), name="ngram-groups")
    by_class = classes.select(F.col("digest").alias("key"), "first", "copies").join(links, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    smallest = by_class.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("group"))
    by_class = by_class.join(smallest, "component", "left")
    by_class = by_class.select(
        F.col("key").alias("digest"), F.col("first").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group", "first").alias("group_id")
    )
    out = signed.join(by_class, "digest", "left")
    own = F.col("key").isNull()
    return out.select(
        "key",
        *[
            F.when(own, empty).otherwise(F.coalesce(c, empty)).alias(c) for c,
            empty in (("class_id", F.col("key")), ("n_links", F.lit(0).cast("bigint")), ("group_id", F.col("key")))
        ]
    )


def _with_sets(docs: DataFrame, n: int) -> DataFrame:
    """Sorted distinct n-gram hashes in place of the text, for the rows whose set is the class's; the digest becomes the key."""
    kept = ["digest", "component", "chunks", "chunk", "copies", "codes"]
    names = ["key", *kept[1:], "grams"]
    schema = docs.select(F.col("digest").alias("key"), *kept[1:]).schema.add("grams", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(alnum_table())
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                sets, bounds = sets_of(*shingles(hasher, data, offsets, n))
                wanted = batch.column("digest").slice(a, b - a).to_pylist()
                own = [i for i, d in enumerate(digests(sets, bounds)) if d == wanted[i]]
                blobs = [sets[bounds[i] : bounds[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a).take(pa.array(own, pa.int64())) for c in kept] + [pa.array(blobs, pa.binary())], names
                )

    return map_arrow(docs, run, schema)


def _verified(dealt: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(key, linked documents, root) for the classes of each block that have a link."""
    kind = dealt.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, keys):
            ids = block.column("key").combine_chunks()
            first = np.ones(len(ids), bool)  # repeated rows of a key count once
            codes_of = np.asarray(ids.dictionary_encode().indices)
            first[1:] = codes_of[1:] != codes_of[:-1]
            block = block.filter(pa.array(first))
            ids = block.column("key").combine_chunks()
            half = block.column("chunk").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("grams")]
            codes = np.frombuffer(b"".join(x.as_py() for x in block.column("codes")), np.uint64).reshape(len(sets), -1)
            if block.column("low")[0].as_py() != block.column("high")[0].as_py() and len(np.unique(half)) < 2:
                continue
            own = block.column("own")[0].as_py()
            i, j = verify_block(sets, codes, half, threshold, None if own is None else np.int64(own).view(np.uint64))
            copies = block.column("copies").to_numpy()
            links = np.zeros(len(sets), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            at = np.flatnonzero(links)
            root = roots(len(sets), i, j)[at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(links[at]), ids.take(pa.array(root))], ["key", "links", "root"])

    return map_arrow(dealt, run, f"key {kind}, links bigint, root {kind}")
