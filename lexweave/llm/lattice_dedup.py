"""Near-duplicate embeddings by lattice hashing.

Vectors of one label are compared by cosine.  In each of several tables, a
random projection takes the unit vector to blocks of eight dimensions, each of
which is decoded to the nearest point of the E8 lattice; the points of all
blocks together are the vector's cell.  A vector also enters the cells that come
next in distance, one lattice step away in one block.  Vectors that meet in a
cell are compared in double precision.

Blocks, tables and probes are the same for tables of any size (:func:`plan`), so
whether a pair is found depends on its two vectors alone.  A pair at a cosine of
exactly 0.98 is missed in one table with a chance of 0.13 and in all eight with
one of 1e-7; nearer pairs are missed less.

Equal vectors (bit by bit) with equal labels are one class from the start.  A
cell is worked on in blocks of two chunks of at most ``CHUNK`` classes, so a hot
cell spreads over many tasks and every pair still meets.  A pair that meets in
several cells counts in the smallest one only: each entry carries the list of
the vector's shared cells before its own.  A block returns sums and stars, never its pairs.

Defined cases: null labels and vectors that are null, empty, zero or hold null
or non-finite components link with nothing; vectors of different lengths do not
link; a null id is a vector of its own that links with nothing; rows with equal
ids count as one vector if their vectors are equal, and each gets a result row;
an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, mix64, partitions, whole_groups
from .components import FEW_ROWS, connected_components, spread_join
from .ngram_join import roots

#: Classes in a chunk of a large cell; a block holds two chunks.
CHUNK = 1024


def decode_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    error = y[odd] - near[odd]
    worst = np.abs(error).argmax(1)
    step = np.where(error[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    near[odd, worst] += step
    return near


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: all integers or all halves, with an even sum."""
    whole, half = decode_d8(y), decode_d8(y - 0.5) + 0.5
    closer = np.square(y - whole).sum(1) <= np.square(y - half).sum(1)
    return np.where(closer[:, None], whole, half)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if bin(bits).count("1") % 2 == 0:
            out.append(v)
    return np.array(out)


#: Fixed for tables of any size: blocks of a cell, tables, and neighbouring cells that a vector enters too.
BLOCKS, TABLES, PROBES = 2, 8, 4
#: Cosines of blocks this close to the threshold are worked out again by :func:`cosines`.
CLOSE = 1e-9


def plan(vectors: int | None = None) -> tuple[int, int, int]:
    """(blocks, tables, probes), the same for any number of vectors.

    Two random vectors meet with a chance of about 8e-5, so among 50,000 of a
    label a vector is compared with four others by chance, and with more in
    proportion.  More blocks for large labels alone would save these meetings,
    but find other pairs there than in small ones.
    """
    return BLOCKS, TABLES, PROBES


def default_scale(threshold: float) -> float:
    """Cells grow with the distance of two unit vectors at the threshold."""
    return 1.5 * float(np.sqrt(max(2 - 2 * threshold, 1e-6)) / 0.2)


class LatticeHash:
    """Cells of unit vectors: for each table, the cell of the vector and its ``probes`` next ones."""

    def __init__(self, dimensions: int, tables: int, probes: int, scale: float, blocks: int = 1, seed: int = 5):
        rng = np.random.default_rng(seed + dimensions)
        self.tables, self.probes, self.blocks = tables, probes, blocks
        self.project = rng.normal(0, 1 / scale, (tables, blocks, dimensions, 8))
        self.short = shortest_vectors()
        self.weights = mix64(np.arange(1, 8 * blocks + 1, dtype=np.uint64)).reshape(blocks, 8) | np.uint64(1)
        self.moves = np.stack([self._sum(self.short, w) for w in self.weights])  # what a step adds to a cell's sum

    @staticmethod
    def _sum(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (np.rint(points * 2).astype(np.int64).view(np.uint64) * weights).sum(-1)

    def __call__(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(vectors, tables * (1 + probes)) codes; the salt (of the label) is part of them."""
        out = []
        for t in range(self.tables):
            total, gains = np.zeros(len(unit), np.uint64), []
            for project, weights in zip(self.project[t], self.weights, strict=True):
                y = unit @ project
                cell = decode_e8(y)
                total += self._sum(cell, weights)
                gains.append((y - cell) @ self.short.T)
            sums = [total]
            if self.probes:
                gain = np.concatenate(gains, 1)
                best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
                sums += list(total + self.moves.ravel()[best].T)
            out += [mix64(mix64(x + np.uint64(t)) ^ salt) for x in sums]
        return np.stack(out, 1)


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, rows they belong to) of the usable vectors of a list column, which have one length."""
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.arange(len(column))
    ok = np.asarray(column.is_valid()) & (np.diff(bounds) > 0)
    d = int(np.diff(bounds)[ok][0]) if ok.any() else 0
    rows = rows[ok]
    x = flat[bounds[:-1][ok][:, None] + np.arange(d)] if len(rows) else np.zeros((0, d))
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, keepdims=True) if len(rows) else x  # so that squares neither overflow nor vanish
        norm = np.sqrt(np.square(x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], rows[good]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, added up component by component as SQL does: the same whatever rows are compared together."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) for v in (x, y))  # powers of two change no digit
    xy, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for k in range(x.shape[1]):
        xy += x[:, k] * y[:, k]
        xx += x[:, k] * x[:, k]
        yy += y[:, k] * y[:, k]
    return xy / (np.sqrt(xx) * np.sqrt(yy))


def met_before(cells: np.ndarray, i: np.ndarray, j: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether members i and j share a cell below ``code``; ``cells``: each one's cells, ascending (unused places hold the largest number)."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 8192):
        at = np.arange(a, min(a + 8192, len(i)))  # undecided; near pairs share many cells, so most are decided by the first few
        for k in range(cells.shape[1]):
            one = cells[i[at], k]
            below = one < code[at]
            at, one = at[below], one[below]
            if not len(at):
                break
            met = (cells[j[at]] == one[:, None]).any(1)
            out[at[met]] = True
            at = at[~met]
    return out


def link_pairs(
    unit: np.ndarray, raw: np.ndarray, cells: np.ndarray, bounds: np.ndarray, code: np.ndarray, half: np.ndarray, across: np.ndarray,
    threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j), i < j, of blocks of rows; a pair that meets in a smaller cell too is left to that one.

    ``across``: of blocks with two chunks, where only pairs across them count.
    Blocks of one size are compared at once.  The last digits of such a product
    depend on the block's size, so pairs at the threshold are decided by
    :func:`cosines` of the vectors as they came (``raw``).
    """
    size, found = np.diff(bounds), []
    for m in np.unique(size[size > 1]):
        own = np.flatnonzero(size == m)
        step = max(1, (1 << 21) // (m * max(m, unit.shape[1])))
        for a in range(0, len(own), step):
            rows = bounds[own[a : a + step]][:, None] + np.arange(m)
            u = unit[rows]
            cosine = u @ u.transpose(0, 2, 1)
            g, i, j = np.nonzero(np.triu(cosine >= threshold - CLOSE, 1))
            close = np.flatnonzero(cosine[g, i, j] < threshold + CLOSE)
            i, j = rows[g, i], rows[g, j]
            cut = across[own[a + g]]
            keep = ~cut | (half[i] != half[j])
            keep[close] &= cosines(raw[i[close]], raw[j[close]]) >= threshold
            found.append((i[keep], j[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = ~met_before(cells, i, j, code[i])
    return i[keep], j[keep]


def near_duplicates(
    vectors: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id", threshold: float = 0.98,
    scale: float | None = None
) -> DataFrame:
    """(key, n_links, component_id) of every row.

    n_links: other vectors with the same label and a cosine of at least the
    threshold that met in a cell; component_id: the smallest key reachable by links.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    usable = source.filter(
        "key IS NOT NULL AND label IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(vector, x -> x <> 0)"
    )
    kind = source.schema["key"].dataType.simpleString()
    # the label's length in front keeps (label, vector) apart from any other pair of the same characters
    named = F.concat(
        F.length(F.col("label").cast("string")).cast("string"), F.lit(":"), F.col("label").cast("string"),
        F.array_join(F.col("vector").cast("array<string>"), ",")
    )
    digest = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))
    member = materialize(usable.select("key", digest.alias("class"), F.xxhash64(F.col("label")).alias("salt"), "vector"), "lattice-members")
    classes = member.groupBy("class").agg(
        F.min("key").alias("key"), F.count_distinct("key").alias("copies"), F.min_by("salt", "key").alias("salt"),
        F.min_by("vector", "key").alias("vector")
    )
    classes = materialize(classes, "lattice-classes").withColumn("d", F.size("vector"))
    blocks, tables, probes = plan()
    scale = scale or default_scale(threshold)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, LatticeHash] = {}
        for table, bounds in whole_groups(batches, ["d"]):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for lo in range(a, b, 4096):
                    part = table.slice(lo, min(4096, b - lo)).combine_chunks()
                    unit, rows = unit_vectors(part.column("vector").combine_chunks())
                    if len(rows):
                        h = hashes.setdefault(unit.shape[1], LatticeHash(unit.shape[1], tables, probes, scale, blocks))
                        salt = part.column("salt").to_numpy()[rows].view(np.uint64) + np.uint64(unit.shape[1])
                        cells = h(unit, salt)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cells.ravel().view(np.int64)), part.column("class").combine_chunks().take(pa.array(np.repeat(rows, cells.shape[1])))],
                            ["code", "class"]
                        )

    # only numbers of cells and classes are shuffled to find the cells with company
    cells = materialize(
        map_arrow(classes.select("class", "salt", "vector", "d").sortWithinPartitions("d"), enter, "code bigint, class binary"),
        "lattice-cells"
    )
    shared = materialize(cells.groupBy("code").agg(F.count("*").alias("members")).filter("members > 1"), "lattice-shared")
    most = max(FEW_ROWS, cells.count() // (4 * partitions(spark)))
    lists = spread_join(
        cells, shared, "code", 0, hot=shared.filter(F.col("members") > most).select("code")
    ).groupBy("class").agg(F.array_sort(F.collect_set(F.struct("code", "members"))).alias("entries"))
    chunks = F.ceil(F.col("e.members") / CHUNK).cast("int")
    dealt = classes.select("class", "key", "copies", "vector").join(lists, "class").select(
        "key", "copies", "vector", F.transform("entries", lambda e: e["code"]).alias("all"), F.posexplode("entries").alias("before", "e")
    )
    dealt = dealt.select(
        "key", "copies", "vector", F.slice("all", F.lit(1), F.col("before")).alias("cells"), F.col("e.code").alias("code"), chunks.alias("chunks"),
        F.pmod(F.xxhash64("key", "copies"), chunks).cast("int").alias("chunk")
    )
    pair = F.explode(F.expr("transform(sequence(0, chunks - 1), c -> struct(least(c, chunk) AS low, greatest(c, chunk) AS high))"))
    dealt = dealt.withColumn("p", pair).select("code", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "chunk", "key", "copies", "vector", "cells")
    keys = ["code", "low", "high"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            col = {c: table.column(c).combine_chunks() for c in table.column_names}
            lists = np.full((table.num_rows, tables * (1 + probes)), np.iinfo(np.int64).max)
            n = np.diff(col["cells"].offsets.to_numpy())
            lists[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = col["cells"].flatten().to_numpy()
            d = np.diff(col["vector"].offsets.to_numpy())
            links, roots_ = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
            copies, code, half = (col[c].to_numpy() for c in ("copies", "code", "chunk"))
            for k in np.unique(d):  # a block's vectors have one length
                blocks = np.flatnonzero(d[bounds[:-1]] == k)
                rows = np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in blocks])
                own = np.concatenate([[0], np.cumsum(np.diff(bounds)[blocks])])
                own_vectors = col["vector"].take(pa.array(rows))
                unit, _ = unit_vectors(own_vectors)
                raw = own_vectors.flatten().to_numpy().astype(np.float64).reshape(-1, k)
                across = (col["low"].to_numpy() != col["high"].to_numpy())[bounds[blocks]]
                i, j = link_pairs(unit, raw, lists[rows], own, code[rows], half[rows], across, threshold)
                i, j = rows[i], rows[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                roots_ = np.minimum(roots_, roots(table.num_rows, i, j))
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [col["key"].take(pa.array(at)), pa.array(links[at]), col["key"].take(pa.array(roots_[at]))], ["key", "links", "root"]
            )

    found = materialize(
        map_arrow(dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "key"), link, f"key {kind}, links bigint, root {kind}"),
        "lattice-links"
    )
    # vectors that differ may share an id: links are counted by class key, one class for each
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = connected_components(
        found.filter("root <> key").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct(), name="lattice-components"
    ).withColumnRenamed("node", "key")
    by_class = classes.select("class", "key", "copies").join(links, "key", "left").join(joined, "key", "left")
    by_class = by_class.select(
        "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "key").alias("component_id")
    )
    good = member.select("key", "class").distinct().join(by_class, "class").groupBy("key").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    out = source.select("key").join(good, "key", "left")
    return out.select("key", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
