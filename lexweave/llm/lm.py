"""Language-model scoring with a log-bilinear neural model.

Tokens are words (A-Z lower-cased, runs of non-space) and one end per text.  The
model predicts a token from the two before it: position-wise scaled context
vectors add up to a prediction, whose products with the token vectors, plus a
bias, are the scores.  Training is by noise-contrastive estimation in numpy;
scoring normalises by products of whole context batches with all token vectors.
The model's output classes are the most frequent words, the end, and ``GROUPS``
groups of all other words by their last two bytes.  Every word of a group that
was trained on, down to those met once, has counts of its own: of the states of
the network (its prediction, quantised) it was met in, which give its share of
the group in each state, and of the clusters of classes met one and two places
after it, which weigh the network's classes where it is the context
(:class:`OwnWords`).  Unseen words have a place in every group, so the
probabilities of all possible tokens add up to 1.

The corpus is never gathered anywhere:

1. texts become stored blocks of word numbers with the block's distinct words;
2. the distinct words of all blocks, cut by hash range, meet for counting, and
   each block gets the corpus counts of its own words back;
3. every partition trains on all training texts of its blocks, from the same
   start, and the models are averaged, weighted by tokens, in two levels; that
   is one round of training over the whole corpus, repeated ``rounds`` times;
4. the other words' own counts are added up by hash range in the same way, and
   each block gets those of its own words back, so no task holds the vocabulary;
5. each block is scored with the model and its words' counts.

Only the model, the list of frequent words and a few sums reach the driver.
Partitions train apart, so the model, and with it ``score`` (not the counts and
``base_score``), depends in its last digits on how the texts fall into files and
partitions, and on rounding; a context on the border of two states can fall to
either.  The same files and settings give the same scores.

Defined cases: a null or empty text is an end alone; without training texts all
counts are 0 and the model is uniform over its classes; repeated rows get equal
scores; an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, gathered, grouped, map_arrow, materialize, mix64, nonspace_table, partitions

#: Text of a block.
BLOCK_BYTES = 8 << 20
#: Words with an output class of their own.
SHORTLIST = 510
#: Groups of the other words; a word's group is the last six bits of its hash.
GROUPS = 64
#: States of the network, and clusters of its classes, that the other words are counted by.
STATES = 10
#: Trained words whose own counts a task adds up.
SHARD_WORDS = 200_000
#: Words of blocks, each block's distinct ones, that a task of the first count adds up.
SHARD_ENTRIES = 2_000_000
#: Weights of the group's shares against a word's own counts: as target, one and two places before it.
PRIOR, PRIOR_NEAR, PRIOR_FAR = 4.0, 8.0, 32.0


def _single(rows: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """The rows and one more column in single precision."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = rows, last
    return out


def row_sums(number: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, columns) sums in double precision of the rows of each number."""
    wide = rows.shape[1]
    cells = np.arange(size * wide).reshape(size, wide).take(number, 0)
    return np.bincount(cells.ravel(), weights=rows.ravel(), minlength=size * wide).reshape(size, wide)


@dataclass
class LogBilinear:
    """Classes 0..k-1 are the shortlist, the next GROUPS the groups of other words, then comes the end; one more number stands before a text."""

    k: int
    vectors: np.ndarray  # (classes + 1, d): of context tokens
    scale: np.ndarray  # (2, d): of the context's places
    targets: np.ndarray  # (classes, d)
    bias: np.ndarray  # (classes,)
    noise: np.ndarray  # (classes,): shares of the classes in the training tokens

    @classmethod
    def start(cls, counts: np.ndarray, d: int = 16, seed: int = 3) -> LogBilinear:
        """From the training counts of the classes: the bias alone gives their shares."""
        rng = np.random.default_rng(seed)
        noise = (counts + 1.0) / (counts.sum() + len(counts))
        n = len(counts)
        return cls(n - GROUPS - 1, rng.normal(0, 0.3, (n + 1, d)), np.ones((2, d)) * [[1.0], [0.5]], np.zeros((n, d)), np.log(noise), noise)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.scale, self.targets, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def with_flat(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for p in self.parameters():
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return LogBilinear(self.k, *out, self.noise)

    def prediction(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.vectors[near] * self.scale[0] + self.vectors[far] * self.scale[1]

    def train(
        self, far: np.ndarray, near: np.ndarray, word: np.ndarray, weight: np.ndarray, state: list[np.ndarray], rng: np.random.Generator,
        noises: int = 48, batch: int = 2048, rate: float = 0.08
    ) -> None:
        """One pass of noise-contrastive estimation over weighted (far, near, word) triples, with Adagrad steps."""
        cumulative = np.cumsum(self.noise)
        order, chance = rng.permutation(len(word)), np.log(noises * self.noise)
        rows = np.column_stack([far, near, word, weight])  # side by side, as they are read in random order
        for a in range(0, len(order), batch):
            part = rows.take(order[a : a + batch], 0).T
            f, n, w, c = *part[:3].astype(np.int64), (part[3] / part[3].sum()).astype(np.float32)
            sample = np.minimum(np.searchsorted(cumulative, rng.random(noises) * cumulative[-1]), len(cumulative) - 1)
            v = _single(self.vectors * self.scale[0], 1).take(n, 0)  # the last column multiplies the bias
            v += _single(self.vectors * self.scale[1], 0).take(f, 0)
            targets = _single(self.targets, self.bias - chance)
            to, away = targets.take(w, 0), -targets[sample]
            dt = c / (1 + np.exp(np.clip(np.einsum("ij,ij->i", v, to), -30, 30)))
            df = v @ away.T
            np.minimum(df, 30, out=df)
            np.exp(df, out=df)
            df += 1
            np.reciprocal(df, out=df)
            to *= dt[:, None]
            to += (df @ away) * c[:, None]
            at_near, at_far = row_sums(n, to, len(self.vectors))[:, :-1], row_sums(f, to, len(self.vectors))[:, :-1]
            at_word = row_sums(w, v * dt[:, None], len(targets))
            at_word -= row_sums(sample, df.T @ (v * c[:, None]), len(targets))
            scale = np.stack([np.einsum("ij,ij->j", x, self.vectors) for x in (at_near, at_far)])
            g = [at_near * self.scale[0] + at_far * self.scale[1], scale, at_word[:, :-1], at_word[:, -1]]
            for p, s, x in zip(self.parameters(), state, g, strict=True):  # in double precision
                s += x * x
                p += rate * x / np.sqrt(s + 1e-8)

    def log_probabilities(self, far: np.ndarray, near: np.ndarray, word: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Natural logarithms of the normalised probabilities; every distinct context is normalised once."""
        context, inverse = self.contexts(far, near)
        return self.of_contexts(context, word, inverse, self.normalised(context, None, batch)[0])

    def contexts(self, far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts, and each token's place among them."""
        wide = len(self.vectors)
        numbers = far * wide + near
        if wide > 2048:
            return np.unique(numbers, return_inverse=True)
        present = np.bincount(numbers, minlength=wide * wide) > 0
        return np.flatnonzero(present), (np.cumsum(present) - 1)[numbers]

    def normalised(self, context: np.ndarray, member: np.ndarray | None, batch: int = 512) -> tuple[np.ndarray, np.ndarray | None]:
        """Of distinct contexts: the normaliser's logarithm and, with ``member`` (classes, clusters), the clusters' probabilities."""
        wide = len(self.vectors)
        norm, shares = np.empty(len(context)), None if member is None else np.empty((len(context), member.shape[1]), np.float32)
        targets = _single(self.targets, self.bias).T
        for a in range(0, len(context), batch):
            c = context[a : a + batch]
            e = _single(self.prediction(c // wide, c % wide), 1) @ targets
            top = e.max(1, keepdims=True)
            e -= top
            np.exp(e, out=e)
            mass = None if member is None else e @ member
            total = e.sum(1, dtype=np.float64) if mass is None else mass.sum(1, dtype=np.float64)
            norm[a : a + batch] = top[:, 0] + np.log(total)
            if mass is not None:
                shares[a : a + batch] = mass / total[:, None]
        return norm, shares

    def of_contexts(self, context: np.ndarray, word: np.ndarray, inverse: np.ndarray, norm: np.ndarray) -> np.ndarray:
        wide, targets = len(self.vectors), _single(self.targets, self.bias)
        v, out = _single(self.prediction(context // wide, context % wide), 1), np.empty(len(word))
        for a in range(0, len(word), 1 << 14):
            b = slice(a, a + (1 << 14))
            out[b] = np.einsum("ij,ij->i", v.take(inverse[b], 0), targets.take(word[b], 0)) - norm[inverse[b]]
        return out


# ----------------------------------------------------------------- blocks --
_BLOBS = {"words": np.uint32, "local": np.uint32, "uniq": np.uint64, "own": np.int64}


def squeezed(numbers: np.ndarray) -> bytes:
    """Word numbers of a block, byte plane by byte plane, compressed: their high bytes are nearly all zero."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return np.uint64(len(planes)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def stretched(data: pa.Buffer) -> np.ndarray:
    raw = pa.decompress(memoryview(data)[8:], int(np.frombuffer(data, np.uint64, 1)[0]), "zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def numbered_words(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes, sorted, whose last bits are the word's group; each word's place among them; words before each text)."""
    words, place, before = hasher.distinct(data, offsets)
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), before
    _, bounds, raw = words.buffers()
    raw, bounds = np.frombuffer(raw, np.uint8), np.frombuffer(bounds, np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    starts, ends = bounds[:-1], bounds[1:]
    last = raw[ends - 1].astype(np.uint64)
    last |= np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)].astype(np.uint64) << np.uint64(8), np.uint64(0))
    hashes = hasher.hashes(words)
    uniq, number = np.unique(hashes - hashes % np.uint64(GROUPS) + mix64(last) % np.uint64(GROUPS), return_inverse=True)
    return uniq, number[place], before


def blocks_of(docs: DataFrame, text: str, key: str, train: Column) -> DataFrame:
    """Stored blocks: keys, train flags, words per text, word numbers, distinct word hashes and their training counts here."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()), T.StructField("keys", T.ArrayType(source.schema["key"].dataType)),
            T.StructField("train", T.ArrayType(T.BooleanType()))
        ] + [T.StructField(c, T.BinaryType()) for c in _BLOBS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, hasher = TaskContext.get().partitionId(), 0, WordHasher(nonspace_table())
        for rows, data, offsets in gathered(batches, "text", BLOCK_BYTES):
            uniq, local, before = numbered_words(hasher, data, offsets)
            flags = rows.column("train")
            learn = np.repeat(flags.to_numpy(zero_copy_only=False), np.diff(before))
            own = np.bincount(local[learn], minlength=len(uniq))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            blobs = {"words": np.diff(before), "local": local, "uniq": uniq, "own": own}
            k += 1
            binary = [pa.array([squeezed(blobs[c]) if c == "local" else blobs[c].astype(t).tobytes()], pa.binary()) for c, t in _BLOBS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), one(rows.column("key")), one(flags), *binary], schema.names)

    return materialize(map_arrow(source, run, schema), "lm-blocks")


def _blob(batch: pa.RecordBatch | pa.Table, column: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)


def count_words(blocks: DataFrame, shortlist: int) -> DataFrame:
    """Stored rows: a block's share of a hash range with the corpus counts of its words; and each range's sums and most frequent words."""
    entries = blocks.agg(F.sum(F.octet_length("uniq"))).first()[0] or 0  # eight bytes for each distinct word of each block
    shards = max(partitions(blocks.sparkSession), entries // 8 // SHARD_ENTRIES + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                uniq, own = _blob(batch, "uniq", i, np.uint64), _blob(batch, "own", i, np.int64)
                at = np.append(np.searchsorted(uniq, edges), len(uniq))
                full = np.flatnonzero(np.diff(at))
                name = batch.column("block")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(full)), pa.array(full, pa.int32()),
                        pa.array([uniq[at[s] : at[s + 1]].tobytes() for s in full], pa.binary()),
                        pa.array([own[at[s] : at[s + 1]].tobytes() for s in full], pa.binary())
                    ],
                    ["block", "shard", "uniq", "own"]
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "shard", "counts", "distinct", "total", "top", "top_counts"]
        kinds = [pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 4]
        for part in grouped(batches, ["shard"]):
            sizes = [len(x.as_buffer()) // 8 for x in part.column("uniq")]
            words = np.concatenate([_blob(part, "uniq", i, np.uint64) for i in range(part.num_rows)])
            own = np.concatenate([_blob(part, "own", i, np.int64) for i in range(part.num_rows)])
            uniq, inverse = np.unique(words, return_inverse=True)
            counts = np.bincount(inverse, weights=own, minlength=len(uniq)).astype(np.int64)
            back, shard = counts[inverse], part.column("shard")[0].as_py()
            ends = np.cumsum(sizes)
            top = np.lexsort((uniq, -counts))[:shortlist]
            top = top[counts[top] > 0]
            group = (uniq % np.uint64(GROUPS)).astype(np.int64)
            rows = [
                (part.column("block")[i].as_py(), shard, back[e - n : e].tobytes(), None, None, None, None) for i,
                (n, e) in enumerate(zip(sizes, ends, strict=True))
            ]
            rows.append(
                (
                    None, shard, None, np.bincount(group, weights=counts > 0, minlength=GROUPS).astype(np.int64).tolist(),
                    np.bincount(group, weights=counts, minlength=GROUPS).astype(np.int64).tolist(), uniq[top].view(np.int64).tolist(),
                    counts[top].tolist()
                )
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = map_arrow(blocks.select("block", "uniq", "own"), cut, "block string, shard int, uniq binary, own binary")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return materialize(
        map_arrow(
            rows, add,
            "block string, shard int, counts binary, distinct array<bigint>, total array<bigint>, top array<bigint>, top_counts array<bigint>"
        ),
        "lm-counts"
    )


# --------------------------------------------------------------- training --
def classes_of(batch: pa.RecordBatch, i: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(far context, near context, class, text) of every token of a block, ends included; ``frequent``: sorted hashes."""
    k = len(frequent)
    words, uniq = (_blob(batch, c, i, _BLOBS[c]) for c in ("words", "uniq"))
    local = stretched(batch.column("local")[i].as_buffer())
    at = np.minimum(np.searchsorted(frequent, uniq), max(k - 1, 0))
    other = k + (uniq % np.uint64(GROUPS)).astype(np.int64)
    number = np.where(frequent[at] == uniq, at, other) if k else other
    n = words.astype(np.int64) + 1
    ends = np.cumsum(n)
    end = k + GROUPS
    word = np.full(ends[-1] if len(ends) else 0, end)
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    word[inner] = number[local]
    near, far = np.empty_like(word), np.empty_like(word)
    near[1:], far[2:] = word[:-1], word[:-2]
    starts = ends - n
    near[starts] = far[starts] = end + 1
    second = starts[n > 1] + 1
    far[second] = end + 1
    return far, near, word, np.repeat(np.arange(len(n)), n)


def train_round(blocks: DataFrame, model: LogBilinear, frequent: np.ndarray, seed: int) -> LogBilinear:
    """One pass over all training texts: partitions train apart, their models are averaged by tokens."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, total = model.with_flat(model.flat()), 0
        state, rng = [np.zeros_like(p) for p in own.parameters()], np.random.default_rng([seed, part])
        for batch in batches:
            for i in range(batch.num_rows):
                far, near, word, text = classes_of(batch, i, frequent)
                use = batch.column("train")[i].values.to_numpy(zero_copy_only=False)[text]
                wide = len(own.vectors)
                triples, count = np.unique((far[use] * wide + near[use]) * wide + word[use], return_counts=True)
                if len(triples):
                    own.train(triples // wide // wide, triples // wide % wide, triples % wide, count.astype(float), state, rng)
                    total += int(use.sum())
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([float(total)]), pa.array([(own.flat() * total).tobytes()], pa.binary())],
                ["part", "weight", "model"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                weight += batch.column("weight")[i].as_py()
                total = total + _blob(batch, "model", i, np.float64)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "model"])

    parts = materialize(map_arrow(blocks.select("train", "words", "local", "uniq"), learn, "part int, weight double, model binary"), "lm-models")
    rows = map_arrow(parts.repartition(16, "part"), add, "weight double, model binary").collect()  # at most 16 models
    weight = sum(r["weight"] for r in rows)
    return model.with_flat(sum(np.frombuffer(r["model"]) for r in rows) / weight) if weight else model


# ------------------------------------------------------------ other words --
def _centres(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means from a spread start."""
    out, gap = x[[int(np.argmax(weight))]], np.full(len(x), np.inf)
    for _ in range(min(k, len(x)) - 1):
        gap = np.minimum(gap, ((x - out[-1]) ** 2).sum(1))
        out = np.vstack([out, x[[int(np.argmax(gap * weight))]]])
    for _ in range(rounds):
        own = nearest(x, out)
        mass = np.bincount(own, weights=weight, minlength=len(out))
        for d in range(x.shape[1]):
            total = np.bincount(own, weights=weight * x[:, d], minlength=len(out))
            out[:, d] = np.where(mass > 0, total / np.maximum(mass, 1e-300), out[:, d])
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def places_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token of a block, ends included: the block's numbers of its word and of the words one and two before, or -1."""
    words, local = _blob(batch, "words", i, np.uint32), stretched(batch.column("local")[i].as_buffer())
    n = words.astype(np.int64) + 1
    ends = np.cumsum(n)
    own = np.full(ends[-1] if len(ends) else 0, -1)
    inner = np.ones(len(own), bool)
    inner[ends - 1] = False
    own[inner] = local
    near, far = np.full_like(own, -1), np.full_like(own, -1)
    near[1:], far[2:] = own[:-1], own[:-2]  # the end before a text is -1 already
    far[(ends - n)[n > 1] + 1] = -1
    far[ends - n] = -1
    return own, near, far


@dataclass
class OwnWords:
    """What the words of the groups add to the model; a word's row has its counts by state, and by cluster one and two places later."""

    model: LogBilinear
    centres: np.ndarray  # (states, d): of predictions
    cluster: np.ndarray  # (classes,)
    shares: np.ndarray | None = None  # (groups, states): of the groups' training tokens
    places: np.ndarray | None = None  # (groups, states): sums of the words' weights, with one for unseen words
    after: np.ndarray | None = None  # (2, groups, clusters): shares one and two places after a group's words

    @classmethod
    def start(cls, model: LogBilinear) -> OwnWords:
        weight = model.noise
        cluster = nearest(model.targets, _centres(model.targets, weight, STATES))
        near = np.append(np.arange(len(weight)), len(weight))
        mean = weight @ model.vectors[: len(weight)] * model.scale[1]
        x = model.vectors[near] * model.scale[0] + mean
        return cls(model, _centres(x, np.append(weight, weight[-1]), STATES), cluster)

    @property
    def member(self) -> np.ndarray:
        return np.eye(STATES, dtype=np.float32)[self.cluster]

    def states(self, context: np.ndarray) -> np.ndarray:
        wide = len(self.model.vectors)
        return nearest(self.model.prediction(context // wide, context % wide), self.centres)

    def rare(self, number: np.ndarray) -> np.ndarray:
        return (number >= self.model.k) & (number < self.model.k + GROUPS)

    def count(self, far: np.ndarray, near: np.ndarray, word: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> np.ndarray:
        """(size, 3 * STATES) counts of the words of the groups over these tokens."""
        context, inverse = self.model.contexts(far, near)
        state, cluster = self.states(context)[inverse], self.cluster[word]
        out = np.empty((size, 3 * STATES), np.uint32)
        for q, (p, c, x) in enumerate(zip(places, (state, cluster, cluster), (word, near, far), strict=True)):
            at = np.flatnonzero(self.rare(x))
            out[:, q * STATES : (q + 1) * STATES] = np.bincount(p[at] * STATES + c[at], minlength=size * STATES).reshape(size, STATES)
        return out

    @staticmethod
    def sums(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """(GROUPS, 4 * STATES + 1) of trained words: their counts, their discounted counts by state, their weights for the group's shares."""
        c = counts[:, :STATES].sum(1)
        counts, group, c = counts[c > 0], group[c > 0], c[c > 0]
        rate = (c + 1) / (c + PRIOR)
        parts = np.hstack([counts, counts[:, :STATES] * rate[:, None], (PRIOR * rate)[:, None]])
        return np.stack([np.bincount(group, weights=p, minlength=GROUPS) for p in parts.T], 1)

    def with_sums(self, sums: np.ndarray) -> OwnWords:
        share = lambda x: (x + 1 / STATES) / (x.sum(1, keepdims=True) + 1)
        n, near, far, a = (sums[:, q * STATES : (q + 1) * STATES] for q in range(4))
        shares = share(n)
        return OwnWords(self.model, self.centres, self.cluster, shares, a + shares * (sums[:, -1:] + 1), np.stack([share(near), share(far)]))

    def log_probabilities(
        self, far: np.ndarray, near: np.ndarray, word: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray], counts: np.ndarray
    ) -> np.ndarray:
        """Natural logarithms; ``counts``: rows of the words that ``places`` number."""
        context, inverse = self.model.contexts(far, near)
        norm, mass = self.model.normalised(context, self.member)
        state = self.states(context)
        out = self.model.of_contexts(context, word, inverse, norm)
        group = np.full(len(counts) + 1, -1)  # of the words; the last stands for -1, which is no word
        for x, place in zip((word, near, far), places, strict=True):
            group[place] = x - self.model.k
        weights, heads = self.weights(counts, group[:-1])
        flat, shares, sums = counts.ravel(), (PRIOR * self.shares).ravel(), self.places.ravel()
        for a in range(0, len(word), 1 << 14):
            b = slice(a, a + (1 << 14))
            ratio = weights[0].take(places[1][b], 0)
            ratio *= weights[1].take(places[2][b], 0)
            known = np.einsum("ij,ij->i", ratio, mass.take(inverse[b], 0))
            own = ratio.ravel()[np.arange(len(ratio)) * STATES + self.cluster[word[b]]] / known.astype(np.float64)
            at = np.flatnonzero(self.rare(word[b]))
            w, z = places[0][b][at], state[inverse[b][at]]
            cell = (word[b][at] - self.model.k) * STATES + z
            own[at] *= heads[w] * (flat[w * (3 * STATES) + z] + shares[cell]) / sums[cell]
            out[b] += np.log(own)
        return out

    def weights(self, counts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words, and -1 as the last: what they weigh the clusters by one and two places later; and their discounts as targets."""
        out, at = np.ones((2, len(counts) + 1, STATES), np.float32), np.flatnonzero((group >= 0) & (group < GROUPS))
        for a in range(0, len(at), 1 << 14):
            b = at[a : a + (1 << 14)]
            for q, prior in enumerate((PRIOR_NEAR, PRIOR_FAR)):
                after, row = self.after[q].astype(np.float32).take(group[b], 0), counts[b, (q + 1) * STATES : (q + 2) * STATES]
                out[q, b] = (row + prior * after) / ((row.sum(1, keepdims=True) + prior) * after)
        trained = counts[:, :STATES].sum(1, dtype=np.float64)
        return out, (trained + 1) / (trained + PRIOR)


def packed(counts: np.ndarray) -> bytes:
    """Counts, nearly all small, as compressed bytes; those from 255 on follow apart."""
    flat = counts.ravel()
    large = np.flatnonzero(flat >= 255)
    raw = np.uint64(len(large)).tobytes() + large.astype(np.uint64).tobytes() + flat[large].astype(np.uint64).tobytes() + np.minimum(flat, 255).astype(np.uint8).tobytes()
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(memoryview(data)[8:], int(np.frombuffer(data, np.uint64, 1)[0]), "zstd")
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    at, value = np.frombuffer(raw, np.uint64, 2 * n, 8).reshape(2, n)
    out = np.frombuffer(raw, np.uint8, offset=8 + 16 * n).astype(np.uint32)
    out[at.astype(np.int64)] = value
    return out.reshape(-1, 3 * STATES)


def count_own(blocks: DataFrame, own: OwnWords, frequent: np.ndarray, shards: int) -> DataFrame:
    """Stored rows: a block's share of a hash range with the corpus counts of its words of the groups; and each range's sums."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                far, near, word, text = classes_of(batch, i, frequent)
                use = batch.column("train")[i].values.to_numpy(zero_copy_only=False)[text]
                uniq = _blob(batch, "uniq", i, np.uint64)
                counts = own.count(far[use], near[use], word[use], tuple(p[use] for p in places_of(batch, i)), len(uniq))
                at = np.append(np.searchsorted(uniq, edges), len(uniq))
                for s in np.flatnonzero(np.diff(at)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("block")[i].as_py()]), pa.array([s], pa.int32()),
                            pa.array([uniq[at[s] : at[s + 1]].tobytes()], pa.binary()),
                            pa.array([packed(counts[at[s] : at[s + 1]])], pa.binary())
                        ],
                        ["block", "shard", "uniq", "own"]
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "shard", "own", "sums"]
        for part in grouped(batches, ["shard"]):
            words = [_blob(part, "uniq", i, np.uint64) for i in range(part.num_rows)]
            uniq, inverse = np.unique(np.concatenate(words), return_inverse=True)
            ends = np.cumsum([len(w) for w in words])
            counts = np.zeros((len(uniq), 3 * STATES), np.uint32)
            for i, e in enumerate(ends):
                counts[inverse[e - len(words[i]) : e]] += unpacked(part.column("own")[i].as_py())
            shard = part.column("shard")[0].as_py()
            for i, e in enumerate(ends):
                back = packed(counts[inverse[e - len(words[i]) : e]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("block")[i].as_py()]), pa.array([shard], pa.int32()), pa.array([back], pa.binary()), pa.array([None], pa.binary())],
                    names
                )
            sums = own.sums(counts, (uniq % np.uint64(GROUPS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.string()), pa.array([shard], pa.int32()), pa.array([None], pa.binary()), pa.array([sums.tobytes()], pa.binary())],
                names
            )

    rows = map_arrow(blocks.select("block", "train", "words", "local", "uniq"), cut, "block string, shard int, uniq binary, own binary")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return materialize(map_arrow(rows, add, "block string, shard int, own binary, sums binary"), "lm-own")


def own_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The block's words' own counts, put together from the hash ranges in their order."""
    parts, out, at = batch.column("others")[i], np.empty((len(_blob(batch, "uniq", i, np.uint64)), 3 * STATES), np.float32), 0
    for part in parts.values if parts.is_valid else ():
        counts = unpacked(part.as_buffer())
        out[at : at + len(counts)] = counts
        at += len(counts)
    if at != len(out):
        raise ValueError(f"counts of {at} of {len(out)} words")
    return out


# ---------------------------------------------------------------- scoring --
def score_documents(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", shortlist: int = SHORTLIST, rounds: int = 2) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    base_score: by add-one smoothed training counts with one place for unseen words.
    """
    blocks = blocks_of(docs, text, key, train)
    counts = count_words(blocks, shortlist)
    by_group = counts.filter("block IS NULL").select(
        F.posexplode(F.arrays_zip("distinct", "total")).alias("g", "x")
    ).groupBy("g").agg(F.sum("x.distinct").alias("v"), F.sum("x.total").alias("n")).collect()
    kinds, tokens = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in by_group:
        kinds[r["g"]], tokens[r["g"]] = r["v"], r["n"]
    ends = blocks.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    top = counts.filter("block IS NULL").select(F.explode(F.arrays_zip("top", "top_counts")).alias("x")).select("x.top", "x.top_counts").orderBy(F.desc("top_counts"), "top").limit(shortlist).collect()
    frequent = np.array([r["top"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, own = frequent[order], np.array([r["top_counts"] for r in top], np.float64)[order]
    n, v = int(tokens.sum()) + ends, int(kinds.sum()) + (ends > 0)
    rest = tokens - np.bincount((frequent % np.uint64(GROUPS)).astype(np.int64), weights=own, minlength=GROUPS).astype(np.int64)
    model = LogBilinear.start(np.concatenate([own, rest, [ends]]))
    for r in range(rounds if n else 0):
        model = train_round(blocks, model, frequent, r)
    others = OwnWords.start(model)
    tables = count_own(blocks, others, frequent, max(partitions(blocks.sparkSession), v // SHARD_WORDS + 1))
    sums = np.zeros((GROUPS, 4 * STATES + 1))
    for r in tables.filter("block IS NULL").select("sums").collect():  # one small row a hash range
        sums += np.frombuffer(r["sums"]).reshape(sums.shape)
    others = others.with_sums(sums)

    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("key", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                far, near, word, owner = classes_of(batch, i, frequent)
                docs_here = len(batch.column("keys")[i].values)
                parts, places = batch.column("counts")[i], places_of(batch, i)
                c = np.concatenate([np.frombuffer(x, np.int64) for x in [*(parts.as_py() if parts.is_valid else ()), np.int64(ends).tobytes()]])
                base, known = np.log10((c + 1) / (n + (v + 1))), c > 0  # of the block's words, and the end as the last
                log = others.log_probabilities(far, near, word, places, own_of(batch, i)) / np.log(10)
                total = lambda x: np.bincount(owner, weights=x, minlength=docs_here)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[i].values, pa.array(np.bincount(owner, minlength=docs_here), pa.int64()),
                        pa.array(total(known[places[0]]).astype(np.int64)), pa.array(np.full(docs_here, n), pa.int64()), pa.array(total(base[places[0]])),
                        pa.array(total(log))
                    ],
                    schema.names
                )

    back = counts.filter("block IS NOT NULL").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("shard", "counts"))).alias("c")
    ).select("block", F.transform("c", lambda x: x["counts"]).alias("counts"))
    own_back = tables.filter("block IS NOT NULL").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("shard", "own"))).alias("c")
    ).select("block", F.transform("c", lambda x: x["own"]).alias("others"))
    return map_arrow(
        blocks.select("block", "keys", "words", "local", "uniq").join(back, "block", "left").join(own_back, "block", "left").drop("block"),
        score, schema
    )
