"""Language identification with a byte convolutional network.

Fixed-length windows tile each whole text.  Filters of several widths slide
over a window's bytes, the largest answer of each filter is kept and a softmax
layer turns them into language probabilities.  A text's prediction is the
mean over all its windows, weighted by their bytes.

Training runs in numpy on the driver, on a sample whose bound is a parameter
(``texts_per_language``, ``windows_per_text``).  For applying the network, each
filter is unrolled into tables by byte pair, so that a convolution is a few
table reads and adds per byte; that is the same sum in another order.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
repeated rows get equal answers; an empty table gives an empty result; without
a labelled row every text is ``und``; one learned language is predicted with score 1.
Existing columns named like the output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, slices, text_bytes

UNDETERMINED = "und"


@dataclass
class ByteConvNet:
    languages: list[str]
    window: int = 128
    embed: int = 8
    filters: int = 16
    widths: tuple[int, ...] = (2, 3, 4)
    params: dict[str, np.ndarray] = field(default_factory=dict)
    _tables: list | None = None

    # ------------------------------------------------------------ training --
    def init(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.params = {"E": rng.normal(0, 0.3, (256, self.embed)).astype(np.float32)}
        for w in self.widths:
            self.params[f"W{w}"] = rng.normal(0, (w * self.embed) ** -0.5, (w * self.embed, self.filters)).astype(np.float32)
            self.params[f"b{w}"] = np.zeros(self.filters, np.float32)
        k = self.filters * len(self.widths)
        self.params["V"] = rng.normal(0, k**-0.5, (k, len(self.languages))).astype(np.float32)
        self.params["c"] = np.zeros(len(self.languages), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.params, len(x)
        e = p["E"][x]
        pooled, where, cols = [], [], []
        for w in self.widths:
            m = self.window - w + 1
            col = np.concatenate([e[:, k : k + m] for k in range(w)], axis=2)
            out = col @ p[f"W{w}"]
            at = out.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + p[f"b{w}"], 0))
            where.append(at)
            cols.append(col)
        h = np.concatenate(pooled, 1)
        z = h @ p["V"] + p["c"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), y] + 1e-12).mean())
        dz = q
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"V": h.T @ dz, "c": dz.sum(0), "E": np.zeros_like(p["E"])}
        dh = (dz @ p["V"].T) * (h > 0)
        for i, w in enumerate(self.widths):
            d = dh[:, i * self.filters : (i + 1) * self.filters]
            at = where[i]
            picked = cols[i][np.arange(n)[:, None], at]  # (n, filters, w*embed)
            g[f"W{w}"] = np.einsum("nfk,nf->kf", picked, d, optimize=True)
            g[f"b{w}"] = d.sum(0)
            de = d[:, :, None] * p[f"W{w}"].T[None]  # (n, filters, w*embed)
            for k in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], at + k], de[:, :, k * self.embed : (k + 1) * self.embed])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam over shuffled mini-batches; deterministic for given rows."""
        self.init()
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                _, g = self.gradients(x[i], y[i])
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.params[k] = (self.params[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        self._tables = None
        return self

    # ------------------------------------------------------------ applying --
    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables by byte pair (65536 x filters) and, for an odd width, a last one by byte."""
        if self._tables is None:
            e, out = self.params["E"], []
            for w in self.widths:
                by_byte = [e @ self.params[f"W{w}"][k * self.embed : (k + 1) * self.embed] for k in range(w)]
                parts = [(by_byte[k][:, None] + by_byte[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
                out.append([np.ascontiguousarray(t, np.float32) for t in parts + ([by_byte[-1]] if w % 2 else [])])
            self._tables = out
        return self._tables

    def log_probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        """Of each language, for windows of bytes (n, window)."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        tables = self.tables()
        for a in range(0, len(x), batch):
            rows = np.ascontiguousarray(x[a : a + batch].T).astype(np.int32)  # position first: the pooling then runs over long rows
            pairs, n = (rows[:-1] << 8) | rows[1:], rows.shape[1]
            pooled = []
            for w, parts in zip(self.widths, tables, strict=True):
                m = self.window - w + 1
                total = None
                for k, table in enumerate(parts):
                    index = rows[w - 1 : w - 1 + m] if len(table) == 256 else pairs[2 * k : 2 * k + m]
                    got = table.take(index.ravel(), axis=0, mode="clip")
                    total = got if total is None else np.add(total, got, out=total)
                best = total.reshape(m, n * self.filters).max(0).reshape(n, self.filters)
                pooled.append(np.maximum(best + self.params[f"b{w}"], 0))
            z = np.concatenate(pooled, 1) @ self.params["V"] + self.params["c"]
            z -= z.max(1, keepdims=True)
            out[a : a + batch] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, their document, their bytes): fixed-length windows that tile every text, zero-padded at its end."""
    lengths = np.diff(offsets)
    per = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), per)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * size
    n = np.minimum(size, offsets[1:][doc] - begin)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, size)[begin] if len(begin) else np.zeros((0, size), np.uint8)
    short = np.flatnonzero(n < size)
    if len(short):
        x[short] = np.where(np.arange(size) < n[short, None], x[short], 0)
    return x, doc, n


#: Languages whose shares are broadcast at most.
FEW_LANGUAGES = 10_000


def training_sample(docs: DataFrame, text: str, lang: str, key: str, texts_per_language: int) -> DataFrame:
    """At most ``texts_per_language`` whole texts of each language, the lowest by a hash of key and text among a share of about as many.

    Repeated rows count once, so the bound holds whatever repeats.
    """
    labelled = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")
    ).filter("t IS NOT NULL AND l IS NOT NULL AND t <> ''")
    shares = materialize(labelled.groupBy("l").agg((F.lit(float(texts_per_language)) / F.count("*")).alias("share")), "language-shares")
    if shares.count() <= FEW_LANGUAGES:
        shares = F.broadcast(shares)  # its size is checked; a longer table is joined by a shuffle
    chosen = labelled.withColumn("h", F.xxhash64("k", "t")).join(shares, "l").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    w = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 20)), "h")  # over the share, about the bound's size
    return chosen.dropDuplicates(["l", "h"]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= texts_per_language).select("k", "t", "l")


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts_per_language: int = 600, windows_per_text: int = 6,
    size: int = 128, **options
) -> ByteConvNet:
    """Fit a network on at most ``windows_per_text`` windows, spread evenly over the whole text, of the sampled texts."""
    sample = training_sample(docs, text, lang, key, texts_per_language)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = text_bytes(batch.column("t"))
            x, doc, _ = windows(data, offsets, size)
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            per = np.diff(np.append(first, len(doc)))
            rank = np.arange(len(doc)) - first[doc]
            chosen = (rank * windows_per_text) // np.maximum(per[doc], windows_per_text) != ((rank - 1) * windows_per_text) // np.maximum(per[doc], windows_per_text)
            keep = np.flatnonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("l").take(pa.array(doc[keep])), batch.column("k").take(pa.array(doc[keep])),
                    pa.array(rank[keep], pa.int64()), pa.array([x[i].tobytes() for i in keep], pa.binary())
                ],
                ["l", "k", "r", "w"]
            )

    rows = sorted((r["l"], r["k"], r["r"], bytes(r["w"])) for r in map_arrow(sample, cut, "l string, k string, r bigint, w binary").collect())
    languages = sorted({r[0] for r in rows})
    net = ByteConvNet(languages, window=size, **options)
    if len(languages) < 2:
        net.init()
        return net
    y = np.array([languages.index(r[0]) for r in rows])
    return net.fit(np.stack([np.frombuffer(r[3], np.uint8) for r in rows]), y)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = np.zeros(len(offsets) - 1, bool)
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data[offsets[a] : offsets[b]]], dtype=np.int64)])
        found[a:b] = total[own[1:]] > total[own[:-1]]
    for i in np.flatnonzero(~found):
        piece = data[offsets[i] : offsets[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in piece.decode("utf-8", "replace"))
    return found


def predict(
    docs: DataFrame, net: ByteConvNet, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score",
    columns: list[str] | None = None
) -> DataFrame:
    """``docs`` (or the given columns of it) with the predicted language and its mean probability over the whole text."""
    kept = [c for c in (columns or docs.columns) if c not in (lang_col, score_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = label_texts(batch.column(text), net)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lang, score], [*kept, lang_col, score_col])

    return map_arrow(source, run, schema)


def label_texts(column: pa.Array, net: ByteConvNet, chunk: int = 2 << 20) -> tuple[pa.Array, pa.Array]:
    """Predicted languages and scores of a string array."""
    n, k = len(column), len(net.languages)
    data, offsets, _ = text_bytes(column)
    letters = has_letter(data, offsets) if k else np.zeros(n, bool)
    logs, probs, weight = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
    if k > 1:
        step = chunk // net.window * net.window
        for a, b in slices(offsets, step):
            for lo in range(int(offsets[a]), int(offsets[b]), step):  # more than one round only for a single long text
                hi = min(int(offsets[b]), lo + step)
                x, doc, size = windows(data[lo:hi], np.clip(offsets[a : b + 1], lo, hi) - lo, net.window)
                p = net.log_probabilities(x)
                np.add.at(logs, a + doc, p * size[:, None])
                np.add.at(probs, a + doc, np.exp(p) * size[:, None])
                np.add.at(weight, a + doc, size)
        best = logs.argmax(1)
        score = probs[np.arange(n), best] / np.maximum(weight, 1)
    else:
        best, score = np.zeros(n, np.int64), np.ones(n)
    langs = np.array([*net.languages, UNDETERMINED], object)
    names = langs[np.where(letters, best, k)]
    return pa.array(names, pa.string()), pa.array(np.where(letters, np.clip(score, 0, 1), 0.0), pa.float64())
