"""The language model's kernels against plain ones in double precision: the same numbers, in less CPU time."""

import time

import numpy as np
import pytest

from lexweave.llm import lm
from lexweave.llm.common import WordHasher, mix64, nonspace_table


def _plain_train(m, far, near, word, weight, state, rng, noises=48, batch=2048, rate=0.08):
    cumulative = np.cumsum(m.noise)
    order = rng.permutation(len(word))
    for a in range(0, len(order), batch):
        i = order[a : a + batch]
        f, n, w, c = far[i], near[i], word[i], weight[i] / weight[i].sum()
        sample = np.minimum(np.searchsorted(cumulative, rng.random(noises) * cumulative[-1]), len(cumulative) - 1)
        v = m.prediction(f, n)
        true = (v * m.targets[w]).sum(1) + m.bias[w] - np.log(noises * m.noise[w])
        false = v @ m.targets[sample].T + m.bias[sample] - np.log(noises * m.noise[sample])
        dt, df = c / (1 + np.exp(true)), -c[:, None] / (1 + np.exp(-false))
        dv = dt[:, None] * m.targets[w] + df @ m.targets[sample]
        g = [np.zeros_like(p) for p in m.parameters()]
        np.add.at(g[2], w, dt[:, None] * v)
        np.add.at(g[2], sample, df.T @ v)
        np.add.at(g[3], w, dt)
        np.add.at(g[3], sample, df.sum(0))
        np.add.at(g[0], n, dv * m.scale[0])
        np.add.at(g[0], f, dv * m.scale[1])
        g[1][0], g[1][1] = (dv * m.vectors[n]).sum(0), (dv * m.vectors[f]).sum(0)
        for p, s, x in zip(m.parameters(), state, g, strict=True):
            s += x * x
            p += rate * x / np.sqrt(s + 1e-8)


def _plain_scores(own, far, near, word, places, counts):
    m, k, states = own.model, own.model.k, lm.STATES
    s = m.prediction(far, near) @ m.targets.T + m.bias
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for q, (c, place, prior) in enumerate(((near, places[1], lm.PRIOR_NEAR), (far, places[2], lm.PRIOR_FAR))):
        at = np.flatnonzero((c >= k) & (c < k + lm.GROUPS))
        after, row = own.after[q][c[at] - k], counts[place[at], (q + 1) * states : (q + 2) * states].astype(float)
        p[at] *= ((row + prior * after) / (row.sum(1, keepdims=True) + prior) / after)[:, own.cluster]
    out = np.log(p[np.arange(len(word)), word] / p.sum(1))
    at = np.flatnonzero((word >= k) & (word < k + lm.GROUPS))
    z = lm.nearest(m.prediction(far[at], near[at]), own.centres)
    g, w = word[at] - k, places[0][at]
    c = counts[:, :states].sum(1, dtype=float)[w]
    out[at] += np.log((c + 1) / (c + lm.PRIOR) * (counts[w, z] + lm.PRIOR * own.shares[g, z]) / own.places[g, z])
    return out


def _least_cpu(run, times=3):
    spent = []
    for _ in range(times):
        start = time.process_time()
        out = run()
        spent.append(time.process_time() - start)
    return out, min(spent)


def _tokens(rng, size, words=20_000):
    """A block's tokens: (far, near, word) classes, the places of their words or -1, and the number of words."""
    share = 1 / np.arange(1, words + 1)
    place = rng.choice(words, size, p=share / share.sum())
    place[rng.random(size) < 0.05] = -1
    of_word = np.where(np.arange(words) < lm.SHORTLIST, np.arange(words), lm.SHORTLIST + rng.integers(0, lm.GROUPS, words))
    end = lm.SHORTLIST + lm.GROUPS
    classes = np.where(place < 0, end, of_word[place])
    near, far = np.roll(classes, 1), np.roll(classes, 2)
    near[0], far[:2] = end + 1, end + 1
    places = (place, np.roll(place, 1), np.roll(place, 2))
    places[1][0], places[2][:2] = -1, -1
    return (far, near, classes), places, of_word


def test_training_step_is_that_of_plain_sums_at_less_cost():
    (far, near, word), _, _ = _tokens(np.random.default_rng(0), 60_000)
    weight = np.random.default_rng(1).integers(1, 9, len(word)).astype(float)

    def learn(train):
        m = lm.LogBilinear.start(np.bincount(word, minlength=lm.SHORTLIST + lm.GROUPS + 1).astype(float))
        train(m, far, near, word, weight, [np.zeros_like(p) for p in m.parameters()], np.random.default_rng(2))
        return m.flat()

    got, cost = _least_cpu(lambda: learn(lm.LogBilinear.train))
    expected, plain = _least_cpu(lambda: learn(_plain_train))
    assert np.abs(got - expected).max() < 1e-4 and np.abs(expected - learn(lambda *_: None)).max() > 0.5
    assert cost < 0.7 * plain


def test_scores_by_words_are_those_of_plain_sums():
    rng = np.random.default_rng(0)
    (far, near, word), places, of_word = _tokens(rng, 20_000)
    n = lm.SHORTLIST + lm.GROUPS + 1
    m = lm.LogBilinear(lm.SHORTLIST, rng.normal(size=(n + 1, 16)), rng.normal(size=(2, 16)), rng.normal(size=(n, 16)), rng.normal(size=n), np.full(n, 1 / n))
    own = lm.OwnWords.start(m)
    counts = own.count(far, near, word, places, len(of_word))
    assert counts[: lm.SHORTLIST].sum() == 0
    for q, (place, x) in enumerate(zip(places, (word, near, far), strict=True)):
        assert counts[:, q * lm.STATES : (q + 1) * lm.STATES].sum() == own.rare(x).sum() == (place >= lm.SHORTLIST).sum()
    rare = np.arange(len(of_word)) >= lm.SHORTLIST
    own = own.with_sums(own.sums(counts[rare], of_word[rare] - lm.SHORTLIST))
    got = own.log_probabilities(far, near, word, places, counts.astype(np.float32))
    assert got == pytest.approx(_plain_scores(own, far, near, word, places, counts), abs=1e-3)


def test_words_are_hashed_once_a_block(monkeypatch):
    raw = [b"The cat", b"", b"  a THE\tthe caT \xc3\xa9\xc3\xa9 x", b" "] * 50
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    hasher, seen = WordHasher(nonspace_table()), []
    monkeypatch.setattr(lm, "mix64", lambda x: seen.append(len(x)) or mix64(x))
    uniq, local, before = lm.numbered_words(hasher, data, offsets)
    low = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    words = [[low(w) for w in t.split()] for t in raw]
    flat = sum(words, [])
    assert np.diff(before).tolist() == [len(w) for w in words]
    assert np.array_equal(uniq, np.unique(uniq)) and len(uniq) == len(set(flat)) == sum(seen)
    hashes = uniq[local]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat))
    groups = np.uint64(lm.GROUPS)
    tails = np.array([int.from_bytes(w[-1:] + w[-2:-1], "little") for w in flat], np.uint64)
    assert np.array_equal(hashes % groups, mix64(tails) % groups)
    plain = hasher(data, offsets)[0]
    assert np.array_equal(hashes - hashes % groups, plain - plain % groups)
    none = lm.numbered_words(hasher, np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert [len(x) for x in none] == [0, 0, 3]
