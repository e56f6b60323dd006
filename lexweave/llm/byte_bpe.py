"""Byte-level BPE encoding and decoding in linear time.

A text is cut by the tokenizer's pattern; each match is encoded by itself, as the
merges would.  Bytes map to Latin-1 characters, so that one Aho-Corasick automaton
finds the longest vocabulary token at every byte of a match.  The encoder takes
longest tokens and backtracks to shorter ones where two neighbours could not
stand side by side after the merges; whether they can is decided by undoing
their merges one by one, and remembered by pair.  Every position is left for
good at most once, so the work is linear in the bytes.

Pieces of text recur, so texts are first cut where the pattern certainly has a
border (:mod:`lexweave.llm.pieces`), and each distinct piece is encoded once; a
memory bounded by bytes holds on to ids of pieces.  With another pattern each
text is cut by it as a whole.  An encoder lives as long as a partition.

Defined cases: a null or empty text has no ids and decodes to no bytes; very
long texts and words without spaces are handled whole; repeated rows get equal
results; an empty table gives an empty result.  Columns are replaced if they
have an output's name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices, text_bytes, text_slices
from .pieces import PATTERN, Memory, encode_pieces, plain_words

#: Neighbour pairs that a worker remembers (about 100 bytes each).
REMEMBERED_PAIRS = 100_000
#: Ids that are decoded at once; a longer document is decoded by itself.
DECODE_IDS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(word: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Byte pair merging by definition: the pair of the lowest rank, leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """What the encoder knows of the merges: arrays by id, sent to the workers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ids = pattern, ranks
        n = max(ranks.values(), default=-1) + 1
        tokens = [b""] * n
        for token, i in ranks.items():
            tokens[i] = token
        self.flat, self.sizes = b"".join(tokens), np.array([len(t) for t in tokens], np.int32)
        self.halves = np.stack([np.arange(n, dtype=np.int32)] * 2, 1)  # the two tokens of a token's last merge
        self.shorter = np.full(n, -1, np.int32)  # the longest token that is a proper prefix
        for token, i in ranks.items():
            self.shorter[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            cuts = [(ranks[token[:k]], ranks[token[k:]]) for k in range(1, len(token)) if ranks.get(token[:k], i) < i and ranks.get(token[k:], i) < i]
            if len(cuts) > 1:
                parts = merge_by_rank(token, ranks, i)
                cuts = [tuple(ranks[p] for p in parts)] if len(parts) == 2 else []
            if cuts:
                self.halves[i] = cuts[0]

    def __getstate__(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if k != "ids"}  # the workers' automaton has them

    def tokens(self) -> Iterator[tuple[int, bytes]]:
        ends = np.cumsum(self.sizes)
        for i, (size, end) in enumerate(zip(self.sizes.tolist(), ends.tolist(), strict=True)):
            if size:
                yield i, self.flat[end - size : end]

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        return cls(read_ranks(path), pattern)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.cut = vocabulary.pattern == PATTERN
        self.find = regex.compile(vocabulary.pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.bytes_: list[int] = [-1] * 256
        for i, token in vocabulary.tokens():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), i)
            else:
                self.bytes_[token[0]] = i
        self.automaton.make_automaton()
        self.length, self.shorter = array("i", vocabulary.sizes.tobytes()), array("i", vocabulary.shorter.tobytes())
        left, right = vocabulary.halves[:, 0], vocabulary.halves[:, 1]
        self.left, self.right = array("i", left.tobytes()), array("i", right.tobytes())
        merges = np.flatnonzero(left != np.arange(len(left)))
        self.merged = dict(zip((left[merges].astype(np.int64) << 32 | right[merges]).tolist(), merges.tolist(), strict=True))
        self.pairs: dict[int, bool] = {}
        self.memory = Memory()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` as neighbours."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        merged = self.merged
        before = 1 << 62  # merges of a lower rank came first
        while True:
            if merged.get(a << 32 | b, before) < before:
                return False
            right, left = self.right[a], self.left[b]
            if right == a and left == b:
                return True
            # go back to before the later of the two tokens' last merges
            if left == b or (right != a and a > b):
                before, a = a, right
            else:
                before, b = b + 1, left  # of two merges of one rank the left comes first

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        n, text = len(word), word.decode("latin-1")
        whole = self.automaton.get(text, -1) if n > 1 and self.automaton.kind else self.bytes_[word[0]] if n == 1 else -1
        if whole >= 0:
            return [whole]
        length, shorter, pairs = self.length, self.shorter, self.pairs
        longest = [self.bytes_[b] for b in word]
        longest.append(-1)
        if n > 1 and self.automaton.kind:
            for end, i in self.automaton.iter(text):
                longest[end + 1 - length[i]] = i  # ends ascend, so the last is the longest
        out: list[int] = []
        open_ = bytearray(b"\x01" * (n + 1))  # borders not found to be dead ends
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if open_[at + length[token]]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, longest[at]
            elif out:
                open_[at] = 0
                out.pop()
                at -= length[last]
                token = shorter[last]
                last = out[-1] if out else -1
            else:
                raise ValueError("a byte has no token")
        return out

    def _learn(self, pieces: pa.BinaryArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets, _ = text_bytes(pieces)
        out, known = [], self.memory.known
        for piece, plain, often in zip(pieces.to_pylist(), plain_words(data, offsets).tolist(), (places > 1).tolist(), strict=True):
            ids = known.get(piece)
            if ids is None:
                found = self.encode_bytes(piece) if plain else [i for m in self.find(piece.decode()) for i in self.encode_bytes(m.encode())]
                ids = array("i", found).tobytes()
                if often:  # what recurs in a window may do so in the next
                    self.memory.put(piece, ids)
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of concatenated texts, where each text's begin, and the end)."""
        if self.cut:
            ids, begins = encode_pieces(data, offsets, self._learn)
            return ids.view("<i4"), begins
        out, begins = array("i"), [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for m in self.find(data[a:b].tobytes().decode()):
                out.extend(self.encode_bytes(m.encode()))
            begins.append(len(out))
        return np.array(out, "<i4"), np.array(begins)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_texts(raw, np.array([0, len(raw)]))[0]


class Decoder:
    """Tokens' bytes in one array; all that decoding needs."""

    def __init__(self, vocabulary: Vocabulary):
        self.sizes = vocabulary.sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(vocabulary.flat, np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where each document's begin, and the end); ``bounds``: the documents' first ids and the end."""
        ids = np.asarray(ids, np.int64)
        bounds = np.array([0, len(ids)]) if bounds is None else bounds
        size = self.sizes[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.starts[ids] - done[:-1], size) + np.arange(done[-1])], done[bounds]


def _replaced(df: DataFrame, name: str, kind: T.DataType, without: tuple[str, ...] = ()) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c != name and c not in without]
    return kept, T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind)])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """``docs`` with the ids of every whole text, without the text unless it is to be kept."""
    kept, schema = _replaced(docs, ids, T.ArrayType(T.IntegerType()), () if keep_text else (text,))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, text):  # small parts go out at once
                own, begins = enc.encode_texts(data, offsets)
                found = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in kept] + [found], [*kept, ids])

    return map_arrow(docs, run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in place of the ids."""
    kept, schema = _replaced(encoded, decoded, T.BinaryType(), (ids,))
    sent = encoded.sparkSession.sparkContext.broadcast(Decoder(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = sent.value
        for batch in batches:
            column = batch.column(ids)
            bounds = column.offsets.to_numpy().astype(np.int64)
            bounds, values = bounds - bounds[0], column.flatten().to_numpy(zero_copy_only=False)
            for lo, hi in slices(bounds, DECODE_IDS):
                own = bounds[lo : hi + 1] - bounds[lo]
                data, at = dec.decode(values[bounds[lo] : bounds[hi]], own)
                found = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in kept] + [found], [*kept, decoded])

    return map_arrow(encoded, run, schema)


def ids_digest(ids: str = "ids"):
    """SHA-256, in hex, of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256)
