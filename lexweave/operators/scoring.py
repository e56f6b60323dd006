"""Blocks of names against a block of queries: exact lexical scores by arrays, best lists inside each task.

A scorer gets the queries once and then blocks of names.  For a block it gives,
for every pair, a score from below and one from above; where they differ, the
pair's exact score is worked out only if the one from above can still change the
result (enter a list of bests, or beat a given score).  Nothing is skipped that
could matter, so results equal those of scoring every pair.

A task keeps each query's best ``k`` canonicals.  A canonical that is among the
best of all is so in the task that holds its best name, hence partial lists can be
merged by maximum and rank, wherever a canonical's names lie: no task needs all
names of a canonical, and only queries x k rows a task are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Pairs that a block of names makes with the queries, about.
BLOCK_PAIRS = 1 << 20
#: Queries whose names go to all executors at once; more take further passes.
QUERY_BLOCK = 5_000
#: Names of one canonical that are kept in one task where canonicals are counted.
HOT_NAMES = 50_000

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


# -------------------------------------------------------------- characters --
class Alphabet:
    """Numbers for the characters of some texts; 0 is any other character."""

    def __init__(self, texts: list[str]):
        self.points = np.unique(np.array([ord(c) for c in set().union(*map(set, texts))] if texts else [], np.int64))
        self.size = len(self.points) + 1

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, longest) numbers, padded with 0, and the lengths."""
        size = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), int(size.max(initial=0))), np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(points) and len(self.points):
            at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
            out[np.arange(out.shape[1]) < size[:, None]] = np.where(self.points[at] == points, at + 1, 0)
        return out, size


class Patterns:
    """Queries as bit vectors: in groups of queries that need the same number of 64-bit words."""

    def __init__(self, texts: list[str]):
        self.alphabet = Alphabet(texts)
        self.codes, self.size = self.alphabet.matrix(texts)
        words = np.maximum(1, -(-self.size // 64))
        self.groups: list[tuple[np.ndarray, int, np.ndarray]] = []
        for w in np.unique(words):
            own = np.flatnonzero(words == w)
            masks = np.zeros((w, len(own), self.alphabet.size), np.uint64)
            for i in range(int(self.size[own].max(initial=0))):
                has = np.flatnonzero(self.size[own] > i)
                masks[i // 64, has, self.codes[own[has], i]] |= _ONE << np.uint64(i % 64)
            masks[:, :, 0] = 0
            self.groups.append((own, int(w), masks))

    def blocks(self, names: list[str], pairs: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, names by falling length, masks, the names' numbers, names that are longer than each place)."""
        codes, size = self.alphabet.matrix(names)
        order = np.argsort(-size, kind="stable")
        codes, size = codes[order], size[order]
        wide = max(1, min(len(names), 256))
        for own, _, masks in self.groups:
            tall = max(1, pairs // wide)
            for a in range(0, len(own), tall):
                for lo in range(0, len(names), wide):
                    part = size[lo : lo + wide]
                    longer = np.searchsorted(-part, -np.arange(int(part.max(initial=0))), "left")
                    yield own[a : a + tall], order[lo : lo + wide], masks[:, a : a + tall], codes[lo : lo + wide], longer


def edit_distances(patterns: Patterns, names: list[str]) -> np.ndarray:
    """(names, queries) Levenshtein distances, bit-parallel: a column of the distance matrix is a pair of bit vectors."""
    out = np.zeros((len(names), len(patterns.size)), np.int32)
    lengths = np.array([len(t) for t in names], np.int64)
    for own, columns, masks, codes, longer in patterns.blocks(names):
        shape = (len(masks), len(own), len(columns))
        up, down = np.full(shape, _ALL), np.zeros(shape, np.uint64)
        for t, n in enumerate(longer):
            letters = codes[:n, t]
            rise, fall = _ONE, np.uint64(0)  # of the row above
            for w in range(len(masks)):
                p, m = up[w, :, :n], down[w, :, :n]
                eq = np.take(masks[w], letters, axis=1)
                xv = eq | m
                if w:
                    eq |= fall
                x = eq & p
                x += p
                x ^= p
                x |= eq
                h = x | p
                np.invert(h, out=h)
                h |= m
                x &= p
                if w + 1 < len(masks):
                    next_ = h >> np.uint64(63), x >> np.uint64(63)
                h <<= _ONE
                h |= rise
                x <<= _ONE
                x |= fall
                np.bitwise_and(h, xv, out=m)
                xv |= h
                np.invert(xv, out=xv)
                np.bitwise_or(x, xv, out=p)
                if w + 1 < len(masks):
                    rise, fall = next_
        total = np.zeros(shape[1:], np.int32)
        for w in range(len(masks)):
            valid = _valid(patterns.size[own] - 64 * w)[:, None]
            total += np.bitwise_count(up[w] & valid)
            total -= np.bitwise_count(down[w] & valid)
        out[np.ix_(columns, own)] = (total + lengths[columns]).T
    return out


def common_lengths(patterns: Patterns, names: list[str]) -> np.ndarray:
    """(names, queries) lengths of longest common subsequences, bit-parallel."""
    out = np.zeros((len(names), len(patterns.size)), np.int32)
    for own, columns, masks, codes, longer in patterns.blocks(names):
        state = np.full((len(masks), len(own), len(columns)), _ALL)
        for t, n in enumerate(longer):
            letters, carry = codes[:n, t], None
            for w in range(len(masks)):
                s = state[w, :, :n]
                u = np.take(masks[w], letters, axis=1)
                u &= s
                total = s + u
                if w + 1 < len(masks):
                    over = total < u
                if carry is not None:
                    total += carry
                    if w + 1 < len(masks):
                        over |= carry > total
                if w + 1 < len(masks):
                    carry = over.astype(np.uint64)
                s -= u
                s |= total
        total = np.zeros(state.shape[1:], np.int32)
        for w in range(len(masks)):
            total += np.bitwise_count(~state[w] & _valid(patterns.size[own] - 64 * w)[:, None])
        out[np.ix_(columns, own)] = total.T
    return out


def _valid(bits: np.ndarray) -> np.ndarray:
    """Masks of the lowest ``bits`` bits, 0 to 64."""
    n = np.clip(bits, 0, 64).astype(np.uint64)
    return np.where(n == 64, _ALL, (_ONE << np.minimum(n, np.uint64(63))) - _ONE)


def common_length_of_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of the pairs of two lists."""
    out = np.zeros(len(a), np.int64)
    small = [i for i in range(len(a)) if 0 < len(a[i]) <= 64]
    for i in set(range(len(a))).difference(small):
        out[i] = round(tx.indel_ratio(a[i], b[i]) * (len(a[i]) + len(b[i])) / 200) if a[i] else 0
    for lo in range(0, len(small), 4096):
        own = np.array(small[lo : lo + 4096])
        own = own[np.argsort([-len(b[i]) for i in own], kind="stable")]
        left = [a[i] for i in own]
        alphabet = Alphabet(left)
        codes, size = alphabet.matrix(left)
        text, length = alphabet.matrix([b[i] for i in own])
        masks = np.zeros((len(own), alphabet.size), np.uint64)
        for k in range(codes.shape[1]):
            has = np.flatnonzero(size > k)
            masks[has, codes[has, k]] |= _ONE << np.uint64(k)
        masks[:, 0] = 0
        masks, row = masks.ravel(), np.arange(len(own)) * alphabet.size
        state = np.full(len(own), _ALL)
        for k in range(text.shape[1]):
            n = int(np.searchsorted(-length, -k, "left"))
            s = state[:n]
            u = masks[row[:n] + text[:n, k]] & s
            state[:n] = (s + u) | (s - u)
        out[own] = np.bitwise_count(~state & _valid(size))
    return out


# ---------------------------------------------------------------- postings --
class Postings:
    """Which queries hold a term."""

    def __init__(self, terms: list[set[str]]):
        self.number: dict[str, int] = {}
        pairs = [(self.number.setdefault(t, len(self.number)), q) for q, own in enumerate(terms) for t in sorted(own)]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.owner, self.queries = table[:, 1], len(terms)
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.number) + 1))
        self.size = np.array([len(t) for t in terms], np.int64)

    def shared(self, terms: list[set[str]], weight: Callable[[str], float] | None = None) -> np.ndarray:
        """(names, queries): terms in both, or the sum of their weights."""
        hits = [(i, n, t) for i, own in enumerate(terms) for t in own if (n := self.number.get(t)) is not None]
        name, term = np.array([h[0] for h in hits], np.int64), np.array([h[1] for h in hits], np.int64)
        many = self.first[term + 1] - self.first[term]
        done = np.cumsum(many)
        at = np.repeat(self.first[term] - (done - many), many) + np.arange(int(done[-1]) if len(done) else 0)
        key = np.repeat(name, many) * self.queries + self.owner[at]
        weights = None if weight is None else np.repeat(np.array([weight(h[2]) for h in hits], float), many)
        return np.bincount(key, weights, minlength=len(terms) * self.queries).reshape(len(terms), self.queries)


# ----------------------------------------------------------------- scorers --
class Scorer:
    """Scores of names with the queries it was made for."""

    #: Whether scores are rounded to single precision.
    single = False

    def __init__(self, queries: list[str]):
        self.queries = queries

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """(names, queries) scores from below and from above; None: they are exact."""
        raise NotImplementedError

    def exact(self, names: list[str], name: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of the last block's names and queries, sorted by name."""
        raise NotImplementedError


class Trigrams(Scorer):
    """Shared trigrams over all trigrams."""

    single = True

    def __init__(self, queries: list[str]):
        super().__init__(queries)
        self.postings = Postings([tx.trigram_set(q) for q in queries])

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        grams = [tx.trigram_set(t) for t in names]
        common = self.postings.shared(grams)
        total = np.array([len(g) for g in grams])[:, None] + self.postings.size - common
        return (common / np.maximum(total, 1)).astype(np.float32), None


class Extents(Scorer):
    """The best run of the name's trigrams (or whole words), against all of the query's."""

    single = True
    whole_words = False

    def __init__(self, queries: list[str]):
        super().__init__(queries)
        self.own = [tx.trigram_set(q) for q in queries]
        self.postings = Postings(self.own)

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        grams = [tx.trigram_set(t) for t in names]
        common = self.postings.shared(grams)
        size = np.array([len(g) for g in grams])[:, None]
        whole = common / np.maximum(size + self.postings.size - common, 1)  # the longest run
        return whole.astype(np.float32), (common / np.maximum(self.postings.size, 1)).astype(np.float32)

    def exact(self, names: list[str], name: np.ndarray, query: np.ndarray) -> np.ndarray:
        out = np.zeros(len(name))
        cuts = np.flatnonzero(np.diff(name, prepend=-1, append=len(names)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = self._runs(names[name[a]], query[a:b])
        return out

    def _runs(self, name: str, query: np.ndarray) -> np.ndarray:
        words = tx.word_trigrams(name)
        seq = [g for w in words for g in w]
        ends = np.cumsum([len(w) for w in words]) - 1
        last: dict[str, int] = {}
        before = np.empty(len(seq), np.int64)  # where the same trigram stood last
        for i, g in enumerate(seq):
            before[i] = last.get(g, -1)
            last[g] = i
        held = np.zeros((len(seq), len(query)), bool)
        number, first, owner = self.postings.number, self.postings.first, self.postings.owner
        for i, g in enumerate(seq):
            if (n := number.get(g)) is not None:
                held[i] = np.isin(query, owner[first[n] : first[n + 1]], assume_unique=True)
        size, best = self.postings.size[query], np.zeros(len(query))
        starts = np.concatenate([[0], ends[:-1] + 1]) if self.whole_words else np.flatnonzero(held.any(1))
        for a in starts:
            new = before[a:] < a
            seen, common = np.cumsum(new), np.cumsum(held[a:] & new[:, None], axis=0)
            if self.whole_words:
                stop = ends[ends >= a] - a
                seen, common = seen[stop], common[stop]
            np.maximum(best, (common / (size + seen[:, None] - common)).max(0), out=best)
        return best


class WordExtents(Extents):
    whole_words = True


class EditDistance(Scorer):
    """1 - Levenshtein distance over the longer length."""

    def __init__(self, queries: list[str]):
        super().__init__(queries)
        self.patterns = Patterns(queries)

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        longest = np.maximum(np.array([len(t) for t in names], np.int64)[:, None], self.patterns.size)
        return np.where(longest == 0, 1.0, 1 - edit_distances(self.patterns, names) / np.maximum(longest, 1)), None


class WeightedRatio(Scorer):
    """Weighted best of full, token and partial ratios.

    Ratios of whole and of token-sorted strings are known for all pairs.  Token
    sets matter beyond that only where tokens are shared or repeated, partial
    ratios only where one string is 1.5 times as long: those pairs have bounds.
    """

    def __init__(self, queries: list[str]):
        super().__init__(queries)
        self.tokens = [q.split() for q in queries]
        self.patterns = Patterns(queries)
        self.ordered = Patterns([" ".join(sorted(t)) for t in self.tokens])
        self.postings = Postings([set(t) for t in self.tokens])
        self.repeats = np.array([len(set(t)) < len(t) for t in self.tokens], bool)

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        tokens = [t.split() for t in names]
        ordered = [" ".join(sorted(t)) for t in tokens]
        size, own = np.array([len(t) for t in names], np.int64)[:, None], self.patterns.size
        empty = (size == 0) | (own == 0)
        base = 200.0 * common_lengths(self.patterns, names) / np.maximum(size + own, 1)
        common = common_lengths(self.ordered, ordered)
        both = np.array([len(t) for t in ordered], np.int64)[:, None] + self.ordered.size
        sorted_ = np.where(both == 0, 100.0, 200.0 * common / np.maximum(both, 1))
        ratio = np.maximum(size, own) / np.maximum(np.minimum(size, own), 1)
        near = ratio < 1.5
        low = np.where(near, np.maximum(base, sorted_ * 0.95), base)
        sets = [set(t) for t in tokens]
        shared = self.postings.shared(sets)
        repeats = np.array([len(s) < len(t) for s, t in zip(sets, tokens, strict=True)], bool)[:, None] | self.repeats
        # with shared tokens: their characters and the shorter rest's could all match
        least = np.minimum(np.array([len(" ".join(s)) for s in sets], np.int64)[:, None], np.array([len(" ".join(set(t))) for t in self.tokens], np.int64))
        most = np.maximum(np.array([len(" ".join(s)) for s in sets], np.int64)[:, None], np.array([len(" ".join(set(t))) for t in self.tokens], np.int64))
        covered = self._covered(sets, least, most, shared)
        scale = np.where(ratio <= 8.0, 0.9, 0.6)
        # no window has a longer common subsequence than the whole string
        part = lambda lcs, n: np.minimum(100.0, 200.0 * lcs / np.maximum(n + lcs, 1))
        shorter = np.minimum(size, own)
        partial = part(base * (size + own) / 200.0 + 1e-6, shorter) * scale
        short = np.minimum(both - self.ordered.size, self.ordered.size)
        token = np.where((shared > 0) | repeats | (both == 0), 100.0, part(common + 1e-6, short)) * 0.95 * scale
        high = np.where(near, np.where((shared > 0) | repeats, np.maximum(low, covered * 0.95), low), np.maximum(low, np.maximum(partial, token)))
        high = np.where(low < high, high + 1e-9, high)
        return np.where(empty, 0.0, low), np.where(empty, 0.0, high)

    def _covered(self, sets: list[set[str]], least: np.ndarray, most: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The token set ratio from above: all shared tokens match, and so do as many of the other characters as bags of letters allow."""
        held = self.postings.shared(sets, len)
        letters = _bag_overlap([" ".join(s) for s in sets], [" ".join(set(t)) for t in self.tokens])
        found = np.minimum(np.maximum(letters, held + shared), least)
        by_letters = 200.0 * (found + 1) / np.maximum(least + most, 1)
        glue = held + np.maximum(shared - 1, 0)  # the shared tokens as a string, against each whole set
        by_shared = 200.0 * glue / np.maximum(glue + least, 1)
        rest = (shared == np.minimum(np.array([len(s) for s in sets])[:, None], self.postings.size)) & (shared > 0)
        return np.where(rest, 100.0, np.minimum(100.0, np.maximum(by_letters, by_shared)))

    def exact(self, names: list[str], name: np.ndarray, query: np.ndarray) -> np.ndarray:
        size = np.array([len(t) for t in names], np.int64)[name], np.array([len(t) for t in self.queries], np.int64)[query]
        near = np.maximum(*size) / np.maximum(np.minimum(*size), 1) < 1.5
        out = np.zeros(len(name))
        for i in np.flatnonzero(~near):
            out[i] = tx.wratio(self.queries[query[i]], names[name[i]])
        own = np.flatnonzero(near)
        token_sets = {}
        left, right, known = [], [], np.zeros(len(own))
        sets = [set(t) for t in self.tokens]
        for k, i in enumerate(own):
            n = name[i]
            if n not in token_sets:
                token_sets[n] = set(names[n].split())
            a, b = sets[query[i]], token_sets[n]
            both = a & b
            x, y = " ".join(sorted(a - both)), " ".join(sorted(b - both))
            left.append(x)
            right.append(y)
            # lengths with the shared tokens in front, which always match
            front = sum(map(len, both)) + len(both) - 1 if both else -1
            known[k] = -2 if not a or not b else -3 if both and (not x or not y) else front
        lcs = common_length_of_pairs(left, right)
        la, lb = np.array([len(t) for t in left], np.int64), np.array([len(t) for t in right], np.int64)
        front = np.maximum(known, 0)
        gap = (known >= 0).astype(np.int64)
        la, lb, lcs = la + front + gap, lb + front + gap, lcs + front + gap
        ratio = 200.0 * lcs / np.maximum(la + lb, 1)
        ratio = np.where(known >= 0, np.maximum(ratio, np.maximum(200.0 * front / np.maximum(front + la, 1), 200.0 * front / np.maximum(front + lb, 1))), ratio)
        out[own] = np.where(known == -2, 0.0, np.where(known == -3, 100.0, ratio)) * 0.95
        return out  # of pairs of like lengths: what token sets add to the score from below


def _bag_overlap(names: list[str], queries: list[str]) -> np.ndarray:
    """(names, queries) characters in common, as bags."""
    alphabet = Alphabet(queries)

    def unary(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, size = alphabet.matrix(texts)
        row = np.repeat(np.arange(len(texts)), size)
        flat = codes[np.arange(codes.shape[1]) < size[:, None]]
        return np.bincount(row * alphabet.size + flat, minlength=len(texts) * alphabet.size).reshape(len(texts), alphabet.size)

    q, n = unary(queries), unary(names)
    out = np.zeros((len(names), len(queries)), np.float32)
    for k in range(1, int(q[:, 1:].max(initial=0)) + 1):  # characters met at least k times in both
        use = np.flatnonzero((q[:, 1:] >= k).any(0)) + 1
        out += (n[:, use] >= k).astype(np.float32) @ (q[:, use] >= k).astype(np.float32).T
    return out


#: Scorers by the names of their column functions.
SCORERS: dict[str, type[Scorer]] = {
    "similarity": Trigrams, "word_similarity": Extents, "strict_word_similarity": WordExtents, "levenshtein": EditDistance,
    "wratio": WeightedRatio
}


# ------------------------------------------------------------------- tasks --
def _blocks(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(canonical ids ascending, ids of aliases or a null mark, whether aliases, names)."""
    step = max(16, BLOCK_PAIRS // max(1, queries))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, min(step, batch.num_rows - a))
            yield _columns(part.take(pa.array(np.argsort(part.column("canonical_id").to_numpy(), kind="stable"))))


class _Block:
    """The scores of a block of names, pooled by canonical on demand."""

    def __init__(self, scorer: Scorer, query_ids: np.ndarray, canonical: np.ndarray, rep: np.ndarray, alias: np.ndarray, names: list[str]):
        self.scorer, self.names = scorer, names
        self.low, self.high = scorer.bounds(names)
        self.hidden = alias[:, None] & (rep[:, None] == query_ids)  # a query's own alias is no name for it
        self.low = np.where(self.hidden, -np.inf, self.low)
        self.first = np.flatnonzero(np.diff(canonical, prepend=canonical[0] - 1))
        self.canonical = canonical[self.first]

    def pooled(self) -> np.ndarray:
        return self.low if len(self.first) == len(self.low) else np.maximum.reduceat(self.low, self.first, axis=0)

    def settle(self, least: np.ndarray) -> None:
        """Make scores exact of the pairs that may reach each query's ``least`` score."""
        if self.high is None:
            return
        n, q = np.nonzero((self.high >= least) & (self.high > self.low) & ~self.hidden)
        if len(n):
            found = self.scorer.exact(self.names, n, q)
            self.low[n, q] = np.maximum(self.low[n, q], found.astype(np.float32) if self.scorer.single else found)


class Bests:
    """Each query's best ``k`` canonicals so far; blocks give pooled scores with ids ascending, and settle what may be among the best."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.least = np.full(queries, -np.inf)

    def _least(self, low: np.ndarray) -> np.ndarray:
        """What a canonical must score to be among the best so far and of this block."""
        if len(low) < self.k or np.isfinite(self.least).all():
            return self.least
        return np.maximum(self.least, np.partition(low, len(low) - self.k, axis=0)[len(low) - self.k])

    def add(self, block: _Block) -> None:
        block.settle(self._least(block.pooled()))
        low = block.pooled()
        least = self._least(low)
        equal = low == least
        use = (low > least) | (equal & (np.cumsum(equal, axis=0, dtype=np.int32) <= self.k))  # ids ascend
        use &= low > -np.inf
        n, q = np.nonzero(use)
        rows = [np.concatenate(x) for x in zip(self.rows, (q, block.canonical[n], low[n, q].astype(float)), strict=True)]
        order = np.lexsort((-rows[2], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        best = np.ones(len(order), bool)  # of a canonical's scores the highest
        best[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [x[best] for x in rows]
        order = np.lexsort((rows[1], -rows[2], rows[0]))
        rows = [x[order] for x in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        self.rows = tuple(x[place < self.k] for x in rows)
        last = place == self.k - 1
        self.least[rows[0][last]] = rows[2][last]


def _query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = part.select(*columns).toArrow()  # about QUERY_BLOCK names
        if table.num_rows:
            yield table


def _rows(reps: DataFrame) -> DataFrame:
    return reps.filter("rep_name IS NOT NULL").select(
        F.col("canonical_id").cast("long"), F.coalesce(F.col("rep_id").cast("long"), F.lit(-1)).alias("rep_id"), "is_alias", "rep_name"
    )


def _tasks(df: DataFrame) -> int:
    """All cores: scoring names costs far more than moving them."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def best_matches(queries: DataFrame, reps: DataFrame, scorer: str, k: int = 10) -> DataFrame:
    """(query_id, canonical_id, score): partial lists of each query's best ``k`` canonicals by its best name, the query's own alias left out.

    Null names match nothing.  Partial lists are merged by
    :func:`~lexweave.operators.matching.max_pool` and ``top_k``.
    """
    spark, names, out = queries.sparkSession, None, None
    kind = "float" if SCORERS[scorer].single else "double"
    for table in _query_blocks(queries.filter("query_name IS NOT NULL"), ["query_id", "query_name"]):
        names = names if names is not None else _rows(reps).repartition(_tasks(reps), "rep_id", "rep_name")
        sent = spark.sparkContext.broadcast((table.column("query_id").to_numpy(), table.column("query_name").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            made, bests = SCORERS[scorer](texts), Bests(len(ids), k)
            for block in _blocks(batches, len(ids)):
                bests.add(_Block(made, ids, *block))
            q, canonical, score = bests.rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(canonical), pa.array(score.astype(np.float32 if kind == "float" else np.float64))],
                ["query_id", "canonical_id", "score"]
            )

        found = names.mapInArrow(run, f"query_id bigint, canonical_id bigint, score {kind}")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id bigint, canonical_id bigint, score {kind}")


def expected_ranks(queries: DataFrame, reps: DataFrame, scorer: str) -> DataFrame:
    """(query_id, canonical_id, expected_score, expected_rank) of each query's expected canonical.

    Its score comes from its own names alone; then blocks count the canonicals
    that beat it.  All names of a canonical go to one task, which counts it once;
    those of a canonical with more than ``HOT_NAMES`` are dealt out, and the
    tasks name the queries it beats instead.
    """
    spark = queries.sparkSession
    single, out = SCORERS[scorer].single, None
    pairs = queries.filter("query_name IS NOT NULL").select("query_id", "query_name", F.col("canonical_id").alias("t")).join(
        reps.filter("rep_name IS NOT NULL"), F.col("t") == F.col("canonical_id")
    )
    pairs = pairs.filter(~(F.col("is_alias") & F.col("rep_id").eqNullSafe(F.col("query_id"))))
    own = pairs.groupBy("query_id").agg(F.first("t").alias("canonical_id"), F.max(tx.SCORERS[scorer]("query_name", "rep_name")).alias("expected_score"))
    known = queries.select("query_id", "query_name").join(own, "query_id")
    hot = reps.groupBy("canonical_id").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_NAMES).select("canonical_id", F.lit(True).alias("hot"))
    marked = _rows(reps).join(hot, "canonical_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    deal = F.xxhash64("canonical_id", F.when(F.col("hot"), F.xxhash64("rep_id", "rep_name")))
    dealt = marked.repartition(_tasks(reps), deal).sortWithinPartitions("hot", "canonical_id")
    schema = f"query_id bigint, canonical_id bigint, expected_score {'float' if single else 'double'}, beating bigint, n bigint"
    for table in _query_blocks(known, ["query_id", "query_name", "canonical_id", "expected_score"]):
        sent = spark.sparkContext.broadcast(
            (
                table.column("query_id").to_numpy(), table.column("query_name").to_pylist(), table.column("canonical_id").to_numpy(),
                table.column("expected_score").to_numpy()
            )
        )

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts, target, score = sent.value
            made, count = SCORERS[scorer](texts), np.zeros(len(ids), np.int64)

            def beating(block: tuple) -> tuple[np.ndarray, np.ndarray]:
                b = _Block(made, ids, *block)
                b.settle(score)
                low = b.pooled().astype(score.dtype)
                return (low > score) | ((low == score) & (b.canonical[:, None] < target)), b.canonical

            def rows(q: np.ndarray | slice, canonical: pa.Array, n: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), pa.array(target[q]), pa.array(score[q]), canonical, pa.array(n)],
                    ["query_id", "canonical_id", "expected_score", "beating", "n"]
                )

            for hot, block in _canonical_blocks(batches, len(ids)):
                better, canonical = beating(block)
                if hot:
                    c, q = np.nonzero(better)
                    yield rows(q, pa.array(canonical[c]), np.ones(len(q), np.int64))
                else:
                    count += better.sum(0)
            yield rows(slice(None), pa.nulls(len(ids), pa.int64()), count)

        found = dealt.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return own.limit(0).withColumn("expected_rank", F.lit(0).cast("bigint"))
    counted = out.groupBy("query_id", "canonical_id", "expected_score").agg(
        F.sum(F.when(F.col("beating").isNull(), F.col("n"))).alias("cold"), F.count_distinct("beating").alias("hot")
    )
    return counted.select("query_id", "canonical_id", "expected_score", (F.col("cold") + F.col("hot") + 1).alias("expected_rank"))


def _canonical_blocks(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[tuple[bool, tuple]]:
    """Blocks of a task's rows, which are sorted: those of canonicals that lie in it as a whole, never cut in two, then the others."""
    step, held = max(16, BLOCK_PAIRS // max(1, queries)), None
    for batch in batches:
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        cold = batch.filter(pa.array(~hot)).drop_columns(["hot"]) if hot.any() else batch.drop_columns(["hot"])
        held = cold if held is None else pa.Table.from_batches([held, cold]).combine_chunks().to_batches()[0] if held.num_rows + cold.num_rows else cold
        cuts = np.flatnonzero(np.diff(held.column("canonical_id").to_numpy())) + 1
        while held.num_rows > step and len(cuts):  # the last canonical may go on
            cut = int(cuts[max(0, np.searchsorted(cuts, step, "right") - 1)])
            yield False, _columns(held.slice(0, cut))
            held, cuts = held.slice(cut), cuts[cuts > cut] - cut
        if hot.any():
            for block in _blocks([batch.filter(pa.array(hot))], queries):
                yield True, block
    if held is not None and held.num_rows:
        yield False, _columns(held)


def _columns(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    return part.column("canonical_id").to_numpy(), part.column("rep_id").to_numpy(), part.column("is_alias").to_numpy(zero_copy_only=False), part.column("rep_name").to_pylist()
