"""Token-id files, compressed by Re-Pair grammars with random access.

Documents are encoded with a tokenizer of the tokenizers library, an end id is
added to each, and ids are written in ascending document order: files by key
range, shards of whole documents within a file.  A shard is compressed by
itself.  Re-Pair replaces frequent pairs of neighbouring ids by new symbols,
again and again, until no pair is left that a rule would pay for; here each round
replaces all pairs that are frequent, where they overlap the more frequent one.
After the first round only the places next to new symbols, and those that lost
against a neighbour, can hold a frequent pair, so only they are looked at.

A shard stores its alphabet, its rules, the length each symbol expands to, the
remaining symbols and the ids before every ``MARK``-th of them.  A range of ids
is found by these sums and expanded by walking down the rules; a symbol that
lies outside the range is not expanded.

File: frames one after the other, each ``FRAME`` mark, body length, body and a
line feed (Spark's text writer lays them down, see :mod:`lexweave.llm.warc`); a
file ends after ``FILE_SHARDS`` frames, so its size is bounded however large
the corpus is.  Body: lengths of its parts as unsigned 64-bit numbers, then the
parts: keys (an Arrow stream), first id of each document and the end, alphabet
(u32), rules (pairs), expansion lengths of the rules (u32), symbols, ids before
each mark (u64).  Numbers are little-endian; rules and symbols are u16 where all
fit, else u32.

Encoding.  With a byte-level pre-tokenizer, texts are cut where it certainly has
a border (:mod:`lexweave.llm.pieces`) and each distinct piece of a
group of shards is encoded once; other tokenizers, and texts that hold an added token's string,
encode whole texts.  Tests compare this with encoding whole texts.

Defined cases: null and empty texts have the end id alone; rows with equal keys
stand together, ordered by text; null keys come first; very long texts are
shards of their own; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, materialize, scratch_path, slices, text_bytes, text_slices
from .pieces import encode_pieces, in_signs, plain_words

FRAME = b"LWTOKENS"
#: Text that goes into one shard.
SHARD_BYTES = 4 << 20
#: Text whose distinct pieces are encoded together.
GROUP_BYTES = 24 << 20
#: Shards in a file at most, and the text that a file is planned for.
FILE_SHARDS, FILE_BYTES = 16, 32 << 20
#: A rule takes 8 bytes in a shard with narrow symbols and 12 with wide ones, and each place saves 2 or 4: from so many on it pays.
LEAST = 4
#: Symbols between two stored sums of ids.
MARK = 1024


# ---------------------------------------------------------------- grammar --
class Grammar:
    """A compressed sequence: symbols below ``len(alphabet)`` stand for ids, the next for the rules in order.

    ``expanded`` counts the symbols taken apart so far.
    """

    def __init__(self, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, marks: np.ndarray | None = None):
        self.alphabet, self.rules, self.symbols = alphabet, rules, symbols
        self.lengths = lengths
        self.sizes = np.concatenate([np.ones(len(alphabet), np.int64), lengths.astype(np.int64)])
        if marks is None:
            own = self.sizes[symbols]
            starts = np.arange(0, len(symbols), MARK)
            marks = np.concatenate([[0], np.cumsum(np.add.reduceat(own, starts))]) if len(symbols) else np.zeros(1, np.int64)
        self.marks = marks.astype(np.int64)
        self.expanded = 0

    @classmethod
    def compress(cls, ids: np.ndarray, least: int = LEAST) -> Grammar:
        if len(ids) and int(ids.max()) < 1 << 22:  # dense enough for a table
            present = np.bincount(ids) > 0
            alphabet, seq = np.flatnonzero(present).astype(ids.dtype), (np.cumsum(present) - 1)[ids]
        else:
            alphabet, seq = np.unique(ids, return_inverse=True)
        pairs = _Pairs(seq.astype(np.uint32), len(alphabet), least)
        rules = []
        while (new := pairs.round()) is not None:
            rules.append(new)
        seq, size = pairs.symbols(), pairs.size
        table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
        lengths = np.ones(size, np.int64)
        first = len(alphabet)
        for r in rules:  # a round's rules hold symbols of earlier rounds only
            lengths[first : first + len(r)] = lengths[r].sum(1)
            first += len(r)
        return cls(alphabet, table, lengths[len(alphabet) :], seq)

    def __len__(self) -> int:
        return int(self.marks[-1])

    def _all(self) -> np.ndarray:
        """All ids: every rule is expanded once, from the shortest paths up, and its expansion laid down at each place."""
        n, left, right = len(self.alphabet), self.rules[:, 0].astype(np.int64), self.rules[:, 1].astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        flat = np.empty(int(self.sizes.sum()), np.uint32)
        flat[:n] = self.alphabet
        ready = np.zeros(n + len(left), bool)
        ready[:n] = True
        rest = np.arange(len(left))
        while len(rest):
            now = ready[left[rest]] & ready[right[rest]]
            own, rest = rest[now], rest[~now]
            pair = np.stack([left[own], right[own]], 1).ravel()
            size = self.sizes[n + own]
            begin = first[n + own]
            done = np.cumsum(size)
            flat[np.repeat(begin - (done - size), size) + np.arange(done[-1])] = _laid_out(flat, first[pair], self.sizes[pair])
            ready[n + own] = True
        self.expanded += len(left)
        symbol = self.symbols.astype(np.int64)
        return _laid_out(flat, first[symbol], self.sizes[symbol])

    def decode(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a..b; only symbols that hold some of them are expanded."""
        b = len(self) if b is None else min(b, len(self))
        if a >= b:
            return np.zeros(0, np.uint32)
        if a == 0 and b == len(self) and self.lengths.sum(dtype=np.int64) <= 2 * b:
            return self._all()
        first, last = np.searchsorted(self.marks, a, "right") - 1, np.searchsorted(self.marks, b, "left")
        symbol = self.symbols[first * MARK : last * MARK].astype(np.int64)
        size = self.sizes[symbol]
        place = self.marks[first] + np.cumsum(size) - size
        out, n = np.empty(b - a, np.uint32), len(self.alphabet)
        while len(symbol):
            own = (place < b) & (place + self.sizes[symbol] > a)
            symbol, place = symbol[own], place[own]
            leaf = symbol < n
            out[place[leaf] - a] = self.alphabet[symbol[leaf]]
            inner = np.flatnonzero(~leaf)
            rule, place = symbol[inner] - n, place[inner]
            self.expanded += len(rule)
            left = self.rules[rule, 0].astype(np.int64)
            symbol = np.concatenate([left, self.rules[rule, 1]])
            place = np.concatenate([place, place + self.sizes[left]])
        return out


#: Marks a symbol at whose place the next round looks; symbols stay below it.
_MARKED = np.uint32(1 << 31)


def _laid_out(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges of ``flat`` one after the other."""
    done = np.cumsum(size)
    return flat[np.repeat(first - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]


class _Pairs:
    """Rounds of replacements on a sequence.

    While most places may begin a frequent pair all are looked at, then only
    those that may; once these are few, symbols are chained instead of moved
    together.
    """

    def __init__(self, seq: np.ndarray, size: int, least: int):
        self.seq, self.size, self.least = seq, size, least
        self.at: np.ndarray | None = None  # places where a frequent pair may begin, if not all
        self.after: np.ndarray | None = None
        self.before: np.ndarray | None = None

    def symbols(self) -> np.ndarray:
        return self.seq if self.after is None else self.seq[self.after >= 0]

    def round(self) -> np.ndarray | None:
        """The rules for all frequent pairs that begin at one of the places, which are replaced; None at the end."""
        seq, at = self.seq, self.at
        if len(seq) < 2 or (at is not None and not len(at)):
            return None
        kind, half, odd = (np.uint32, 16, 0x9E3779B1) if self.size <= 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15)
        odd = odd + 2 * self.size & (1 << 2 * half) - 1  # pairs in one bucket part in the next round
        right = None if at is None else at + 1 if self.after is None else self.after[at]
        pair = (seq[:-1] if at is None else seq[at]).astype(kind) << kind(half)
        pair |= (seq[1:] if at is None else seq[right]).astype(kind, copy=False)
        ordered = np.sort(pair)
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(begin, len(ordered)))
        begin, count = begin[count >= self.least], count[count >= self.least]
        if not len(begin):
            return None
        kinds = ordered[begin][np.argsort(count, kind="stable")]  # the more frequent, the higher its rank
        del ordered
        bits = min(20, max(8, len(kinds).bit_length() + 3))
        place_of = lambda p: (p * kind(odd)) >> kind(2 * half - bits)
        table = np.zeros(1 << bits, np.int32)
        table[place_of(kinds)] = np.arange(1, len(kinds) + 1)
        weight = table[place_of(pair)]
        maybe = weight > 0
        weight *= np.concatenate([kinds[:1], kinds])[weight] == pair  # others share a bucket with a more frequent pair and wait
        # a place wins over its neighbours; in runs of one pair every second place does
        touch = True if at is None else right[:-1] == at[1:]
        best = weight > 0
        best[1:] &= (weight[1:] >= weight[:-1]) if at is None else ~touch | (weight[1:] >= weight[:-1])
        best[:-1] &= (weight[:-1] >= weight[1:]) if at is None else ~touch | (weight[:-1] >= weight[1:])
        win = _spaced(np.flatnonzero(best), touch)
        which = weight[win]
        good = np.bincount(which, minlength=len(kinds) + 1) >= self.least
        good[0] = False
        win, which = win[good[which]], which[good[which]]
        if not len(win):
            # all lose somewhere: the pair with the most places that do not overlap goes on alone
            ascending = np.sort(kinds)
            which = np.minimum(np.searchsorted(ascending, pair), len(kinds) - 1)
            which[ascending[which] != pair] = len(kinds)
            apart = _spaced(np.argsort(which, kind="stable"), touch, which)
            most = np.bincount(which[apart], minlength=len(kinds) + 1)[:-1]
            if most.max() < self.least:
                return None
            win = apart[which[apart] == most.argmax()]
            which, kinds, good = np.ones(len(win), np.int64), ascending[[most.argmax()]], np.array([False, True])
        new = kinds[good[1:]].astype(np.int64)
        place = win if at is None else at[win]
        seq[place] = (self.size - 1 + np.cumsum(good))[which]
        self._join(maybe if at is None else at[maybe], place, place + 1 if at is None else right[win])
        self.size += len(new)
        return np.stack([new >> half, new & (1 << half) - 1], 1)

    def _join(self, left: np.ndarray, place: np.ndarray, gone: np.ndarray) -> None:
        """Take ``gone``, which follow ``place``, out; the next round looks at the places left, the new symbols and what stands before them."""
        if self.after is not None:
            beyond = self.after[gone]
            self.after[place], self.before[beyond] = beyond, place
            self.after[gone] = -1
            near = np.sort(np.concatenate([left, place, self.before[place]]))
            near = near[np.diff(near, prepend=-1) > 0]  # each once, and none before the first
            self.at = near[(self.after[near] >= 0) & (self.after[near] < len(self.seq))]
            return
        keep = np.ones(len(self.seq), bool)
        keep[gone] = False
        before = place - 1
        before -= ~keep[before] & (before >= 0)
        if self.at is None:
            self.seq[:-1] |= left.astype(np.uint32) << np.uint32(31)  # the highest bit marks a place to look at; symbols stay below it
        else:
            self.seq[left] |= _MARKED
        self.seq[place] |= _MARKED
        self.seq[before[before >= 0]] |= _MARKED
        self.seq = self.seq[keep]
        near = self.seq >= _MARKED
        near[-1] = False
        self.seq &= ~_MARKED
        n = int(np.count_nonzero(near))
        self.at = None if 2 * n > len(self.seq) else np.flatnonzero(near)
        if 8 * n < len(self.seq):
            self.after, self.before = np.arange(1, len(self.seq) + 1), np.arange(-1, len(self.seq))


def _spaced(own: np.ndarray, touch: np.ndarray | bool, which: np.ndarray | None = None) -> np.ndarray:
    """Of numbers of places, every second one of those (of one kind) that touch: their pairs overlap."""
    follows = np.zeros(len(own), bool)
    follows[1:] = np.diff(own) == 1
    if touch is not True:
        follows[1:][follows[1:]] = touch[own[:-1][follows[1:]]]
    if which is not None:
        follows[1:] &= which[own[1:]] == which[own[:-1]]
    if not follows.any():
        return own
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(own))))
    return own[(np.arange(len(own)) - start) % 2 == 0]


class Shard:
    """Documents' keys, the first id of each document and the end, and the ids' grammar."""

    def __init__(self, keys: pa.Array, starts: np.ndarray, grammar: Grammar):
        self.keys, self.starts, self.grammar = keys, starts, grammar

    def document(self, k: int) -> np.ndarray:
        return self.grammar.decode(int(self.starts[k]), int(self.starts[k + 1]))

    def to_bytes(self) -> bytes:
        sink = io.BytesIO()
        batch = pa.RecordBatch.from_arrays([self.keys], ["key"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        g = self.grammar
        kind = "<u2" if len(g.alphabet) + len(g.rules) <= 1 << 16 else "<u4"
        parts = [
            sink.getvalue(), self.starts.astype("<u8").tobytes(), g.alphabet.astype("<u4").tobytes(), g.rules.astype(kind).tobytes(),
            g.lengths.astype("<u4").tobytes(), g.symbols.astype(kind).tobytes(), g.marks.astype("<u8").tobytes()
        ]
        body = struct.pack("<8Q", int(kind[2]), *map(len, parts)) + b"".join(parts)
        return FRAME + struct.pack("<Q", len(body)) + body + b"\n"

    @classmethod
    def from_bytes(cls, body: memoryview) -> Shard:
        width, *sizes = struct.unpack("<8Q", body[:64])
        at, parts = 64, []
        for n in sizes:
            parts.append(body[at : at + n])
            at += n
        kind = f"<u{width}"
        keys = pa.ipc.open_stream(pa.py_buffer(parts[0])).read_all().column(0).combine_chunks()
        rules = np.frombuffer(parts[3], kind).reshape(-1, 2)
        return cls(
            keys, np.frombuffer(parts[1], "<u8").astype(np.int64),
            Grammar(np.frombuffer(parts[2], "<u4"), rules, np.frombuffer(parts[4], "<u4"), np.frombuffer(parts[5], kind), np.frombuffer(parts[6], "<u8"))
        )


def shards(data: memoryview) -> Iterator[Shard]:
    """The shards of a file."""
    at = 0
    while at < len(data):
        if bytes(data[at : at + 8]) != FRAME:
            raise ValueError(f"no frame at {at}")
        (size,) = struct.unpack("<Q", data[at + 8 : at + 16])
        if bytes(data[at + 16 + size : at + 17 + size]) != b"\n":
            raise ValueError(f"the frame at {at} is cut")
        yield Shard.from_bytes(data[at + 16 : at + 16 + size])
        at += 17 + size


# --------------------------------------------------------------- encoding --
def describe(definition: str) -> tuple[np.ndarray, list[bytes], bool]:
    """Of a tokenizer: bytes that each token stands for, strings of added tokens, and whether texts may be cut into pieces."""
    from tokenizers import Tokenizer

    tokenizer, parts = Tokenizer.from_str(definition), json.loads(definition)
    # a byte-level token has as many characters as it stands for bytes
    sizes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))], np.int64)
    before = parts.get("pre_tokenizer") or {}
    plain = not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding") and (parts.get("model") or {}).get("dropout") is None
    cut = bool(plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"))
    return sizes, [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()], cut


class PieceEncoder:
    """A tokenizer that encodes each distinct piece of some texts once; ``known``: what :func:`describe` says of it."""

    def __init__(self, definition: str, known: tuple[np.ndarray, list[bytes], bool] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(definition)
        self.bytes_of, self.added, self.cut = known or describe(definition)
        self.words = Tokenizer(self.tokenizer.model)  # the same merges for words that are cut already
        self.words.pre_tokenizer = WhitespaceSplit()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.BinaryArray, places: np.ndarray, step: int = 32_768) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces.  Words and numbers need no pattern: they go to the model in one string, and its ids are cut by their bytes."""
        data, offsets, _ = text_bytes(pieces)
        plain = plain_words(data, offsets)
        flat, size = [], np.zeros(len(pieces), np.int64)
        own, length = np.flatnonzero(plain), np.diff(offsets)
        words = data[np.repeat(plain, length)]
        bounds = np.concatenate([[0], np.cumsum(length[own])])
        for a in range(0, len(own), step):
            part = bounds[a : a + step + 1]
            ids = self.words.encode_batch_fast([in_signs(words[part[0] : part[-1]], part - part[0])], add_special_tokens=False)[0].ids
            ids, ends = np.array(ids, "<u4"), part[1:] - part[0]
            done = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(done, ends)
            if not len(done) or done[-1] != ends[-1] or (done[cut] != ends).any():
                raise ValueError("the tokenizer does not keep the borders of pieces")
            flat.append(ids)
            size[own[a : a + step]] = np.diff(cut, prepend=-1)
        rest = np.flatnonzero(~plain)
        for a in range(0, len(rest), step):
            found = self._whole([p.decode() for p in pieces.take(pa.array(rest[a : a + step])).to_pylist()])
            flat.append(np.frombuffer(b"".join(found), "<u4"))
            size[rest[a : a + step]] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.concatenate([*flat, np.zeros(0, "<u4")])
        if not len(rest):
            return ids, size
        order = np.concatenate([own, rest])
        first = np.empty(len(pieces), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(ids))], size

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of concatenated texts, each followed by the end id; where each begins, and the end)."""
        raw = data.tobytes()
        if self.cut and not any(t in raw for t in self.added):
            ids, begins = encode_pieces(data, offsets, self._learn)
        else:
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if self.cut and not any(t in raw[a:b] for t in self.added):
                    found.append(encode_pieces(data[a:b], np.array([0, b - a]), self._learn)[0])
                else:
                    found.append(np.frombuffer(self._whole([raw[a:b].decode()])[0], "<u4"))
            begins = np.cumsum([0, *map(len, found)])
            ids = np.concatenate([*found, np.zeros(0, "<u4")])
        return np.insert(ids, begins[1:], end), begins + np.arange(len(begins))


# ------------------------------------------------------------------ files --
def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, text: str = "text", key: str = "doc_id", end: int = 2) -> None:
    """Encode every whole text and write files of shards in ascending key order."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    sent = spark.sparkContext.broadcast((definition, describe(definition)))  # a tokenizer's size
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = source.repartitionByRange(max(1, -(-total // FILE_BYTES)), "key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(*sent.value)
        for keys, data, offsets in _gathered(batches, GROUP_BYTES):
            ids, starts = enc.encode(data, offsets, end)
            for a, b in slices(offsets, SHARD_BYTES):
                own = Grammar.compress(ids[starts[a] : starts[b]])
                frame = Shard(keys.slice(a, b - a), starts[a : b + 1] - starts[a], own).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([frame[:-1]], pa.binary())], ["value"])

    frames = map_arrow(dealt, run, "value binary").select(F.col("value").cast("string"))
    frames.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SHARDS).text(path)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, bytes of the texts, their offsets) of at most ``limit`` bytes, or one text, across batches."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        lengths = np.concatenate([np.diff(o) for _, _, o in held])
        return pa.concat_arrays([k for k, _, _ in held]), np.concatenate([d for _, d, _ in held]), np.concatenate([[0], np.cumsum(lengths)])

    for batch in batches:
        for a, b, data, offsets in text_slices(batch, "text", limit):
            if held and size + len(data) > limit:
                yield joined()
                held, size = [], 0
            held.append((batch.column("key").slice(a, b - a), data, offsets))
            size += len(data)
    if held:
        yield joined()


def read_token_files(spark: SparkSession, path: str, key_type: T.DataType, with_ids: bool = True) -> DataFrame:
    """(file, key, first, n_tokens, ids_crc32, ids) of every document, or all but the ids; ``first`` counts within the file. Files ascend with the keys by :func:`file_order`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = T.StructType(
        [
            T.StructField("file", T.StringType()), T.StructField("key", key_type), T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType()))
        ][: 6 if with_ids else 5]
    )
    arrow_key = to_arrow_type(key_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, before = p.as_py().rsplit("/", 1)[-1], 0
                for s in shards(memoryview(content.as_buffer())):
                    ids, n = s.grammar.decode().astype("<u4"), len(s.keys)
                    sums = [zlib.crc32(memoryview(ids[a:b]).cast("B") if b > a else b"") for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)]
                    rows = [
                        pa.array([name] * n, pa.string()), s.keys.cast(arrow_key), pa.array(before + s.starts[:-1]),
                        pa.array(np.diff(s.starts)), pa.array(sums, pa.int64())
                    ]
                    if with_ids:
                        rows.append(pa.ListArray.from_arrays(pa.array(s.starts, pa.int32()), pa.array(ids.view(np.int32))))
                    yield pa.RecordBatch.from_arrays(rows, schema.names)
                    before += int(s.starts[-1])

    return map_arrow(files, run, schema)


def file_order(name: str) -> tuple[int, int]:
    """A file's place: its partition's number, and its number among the partition's files."""
    partition, _, rest = name.removeprefix("part-").partition("-")
    number = re.search(r"-c(\d+)", rest)
    return int(partition), int(number.group(1)) if number else 0


def documents_in_files(spark: SparkSession, path: str, key_type: T.DataType) -> DataFrame:
    """(key, start, n_tokens, ids_crc32): ``start`` counts the ids of all documents before, in all files."""
    rows = materialize(read_token_files(spark, path, key_type, with_ids=False), "token-files")
    found = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()  # one row per file of some 64 MiB of text
    totals = sorted(((r["file"], r["n"]) for r in found), key=lambda x: file_order(x[0]))
    before, at = [], 0
    for name, n in totals:
        before.append((name, at))
        at += n
    offsets = spark.createDataFrame(before, "file string, before bigint")
    return rows.join(offsets, "file").select("key", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", end: int = 2) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_file, path, text, key, end)
    return documents_in_files(docs.sparkSession, path, docs.schema[key].dataType)
