"""Pieces of texts that a byte-level pre-tokenizer certainly keeps apart, and a memory of their ids.

The usual pattern of byte-level pre-tokenizers (contractions, an optional space
and letters, digits or marks, white space) holds white space at a match's front
only, gives the last space before a word to the word, and never looks back.  So
it has a border

* between letters (ASCII and U+00C0 to U+024F), ASCII digits and ASCII marks, but not after an apostrophe, which may
  begin a contraction;
* before ASCII white space that follows one of these;
* before a space that is followed by a character that is surely no white space;
* after a single tab or line end between two of them.

The matches of a text are those of its pieces, one after the other.  Pieces
recur, so they are made distinct by their bytes first, and only the distinct
ones are encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: the pattern that the borders hold for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text cut into pieces at once; a longer run without a border is one piece.
WINDOW_BYTES = 4 << 20
#: Bytes that remembered pieces may take, about, and the longest piece remembered.
MEMORY_BYTES, REMEMBERED_BYTES = 16 << 20, 64
#: What an entry takes besides its bytes: two objects and a place in a hash table.
_ENTRY_BYTES = 180

#: Byte classes: 0 unsure, 1 space, 2 other ASCII white space, 3 letter, 4 digit, 5 mark, 6 apostrophe, 7 first byte of a character that is surely no white space.
CLASS = np.zeros(256, np.uint8)
CLASS[32], CLASS[9:14] = 1, 2
CLASS[0x21:0x7F] = 5
CLASS[0x30:0x3A] = 4
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = 3
CLASS[0x27] = 6
CLASS[0xC3:0xE0] = CLASS[0xE4:0xF5] = 7
#: Whether a byte of one class (row) and the next of another (column) always have a border between them.
_BORDER = np.zeros((8, 8), bool)
_BORDER[3:7, 1:3] = True
_BORDER[3, 4:7] = _BORDER[4, [3, 5, 6]] = _BORDER[5, 3:5] = True
_BORDER[6, 4] = True


def byte_signs() -> list[str]:
    """The characters that byte-level models use for bytes: printable Latin-1 ones for themselves, then U+0100 on for the rest."""
    out, extra = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if shown else extra))
        extra += not shown
    return out


#: What a byte's class and the next one's say: 1 a border between them; 2 one before the first, if it is a space; 4 one between them after a single tab or line end, if 8 holds one place before.
_SAYS = _BORDER.astype(np.uint8)
_SAYS[1, 3:] |= 2
_SAYS[2, 3:7] |= 4
_SAYS[3:7, 2] |= 8


def classes(data: np.ndarray) -> np.ndarray:
    kind = CLASS[data]
    lead = np.flatnonzero(kind == 7)
    lead = lead[data[lead] <= 0xC9]
    if len(lead):
        lead = lead[lead + 1 < len(data)]
        second = data[lead + 1]
        lead = lead[(data[lead] != 0xC3) | ((second != 0x97) & (second != 0xB7))]  # the signs of multiplication and division
        kind[lead] = kind[lead + 1] = 3
    return kind


def borders(data: np.ndarray) -> np.ndarray:
    """Flags of the places in texts' bytes that certainly begin a piece (the first byte's is not set)."""
    kind = classes(data)
    code = kind[:-1] << 3
    code |= kind[1:]
    says = _SAYS.ravel()[code]
    out = np.zeros(len(data), bool)
    np.bitwise_and(says, 1, out=out[1:].view(np.uint8))
    out[:-1] |= says & 2 > 0
    after = np.flatnonzero(says & 4)
    after = after[after > 0]
    out[after[says[after - 1] & 8 > 0] + 1] = True
    out[:1] = False
    return out


def windows(data: np.ndarray, offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(where a window of the texts begins, its pieces' starts in it and its end); texts begin pieces too."""
    limit, pos, n = limit or WINDOW_BYTES, 0, len(data)
    while pos < n:
        size = limit
        while True:
            hi = min(n, pos + size)
            flags = borders(data[pos : min(n, hi + 1)])[: hi - pos]
            flags[offsets[np.searchsorted(offsets, pos, "right") : np.searchsorted(offsets, hi)] - pos] = True
            flags[0] = False
            cuts = np.flatnonzero(flags)
            if hi == n or len(cuts):
                break
            size *= 2
        starts = np.concatenate([[0], cuts, [n - pos] if hi == n else []]).astype(np.int32)
        yield pos, starts
        pos += int(starts[-1])


class Memory:
    """Ids, as little-endian bytes, of pieces seen lately; forgets all when full."""

    def __init__(self, limit: int = 0):
        self.known: dict[bytes, bytes] = {}
        self.held, self.limit = 0, limit or MEMORY_BYTES

    def put(self, piece: bytes, ids: bytes) -> None:
        if len(piece) > REMEMBERED_BYTES:
            return
        self.held += len(piece) + len(ids) + _ENTRY_BYTES
        if self.held > self.limit:
            self.known.clear()
            self.held = len(piece) + len(ids) + _ENTRY_BYTES
        self.known[piece] = ids


#: Of distinct pieces and the places of each: (ids of all pieces, how many each has).
Learn = Callable[[pa.BinaryArray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def encode_pieces(data: np.ndarray, offsets: np.ndarray, learn: Learn) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin, and the end); a piece that stands in several texts is encoded once."""
    begins, data = np.zeros(len(offsets), np.int64), np.ascontiguousarray(data)
    cuts = list(windows(data, offsets))
    if not cuts:
        return np.zeros(0, "<u4"), begins
    pieces = pa.chunked_array(
        [pa.Array.from_buffers(pa.binary(), len(s) - 1, [None, pa.py_buffer(s), pa.py_buffer(data[pos : pos + int(s[-1])])]) for pos, s in cuts]
    ).dictionary_encode()
    distinct, places = pieces.chunk(0).dictionary, [c.indices.to_numpy() for c in pieces.chunks]
    del pieces
    flat, size = learn(distinct, sum(np.bincount(at, minlength=len(distinct)) for at in places))
    first = np.cumsum(size) - size
    found, total = [], 0
    for (pos, starts), at in zip(cuts, places, strict=True):
        own = size[at]
        done = np.zeros(len(at) + 1, np.int64)
        np.cumsum(own, out=done[1:])
        found.append(flat[np.repeat(first[at] - done[:-1], own) + np.arange(done[-1])])
        inside = slice(np.searchsorted(offsets, pos), np.searchsorted(offsets, pos + int(starts[-1])))
        begins[inside] = total + done[np.searchsorted(starts, offsets[inside] - pos)]
        total += int(done[-1])
    begins[np.searchsorted(offsets, len(data)) :] = total
    return (found[0] if len(found) == 1 else np.concatenate(found)), begins


def plain_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of pieces, none of them empty, that are one match of the pattern: letters, or digits, after a space or not."""
    first = offsets[:-1]
    if not len(first):
        return np.zeros(0, bool)
    kind = classes(data)
    spaced = (kind[first] == 1) & (np.diff(offsets) > 1)
    kind[first[spaced]] = kind[first[spaced] + 1]
    low = np.minimum.reduceat(kind, first)
    return (low == np.maximum.reduceat(kind, first)) & ((low == 3) | (low == 4))


_SIGNS = [c.encode() for c in byte_signs()]
_WIDTH = np.array([len(c) for c in _SIGNS], np.int64)
_FIRST, _SECOND = np.array([c[0] for c in _SIGNS], np.uint8), np.array([c[-1] for c in _SIGNS], np.uint8)


def in_signs(data: np.ndarray, offsets: np.ndarray) -> str:
    """The pieces in the characters that byte-level models use, each before a line end."""
    width = _WIDTH[data]
    at = np.cumsum(width) - width + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full(int(width.sum()) + len(offsets) - 1, 10, np.uint8)
    out[at] = _FIRST[data]
    two = np.flatnonzero(width == 2)
    out[at[two] + 1] = _SECOND[data[two]]
    return out.tobytes().decode()
