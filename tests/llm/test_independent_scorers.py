"""Scores of all rows of sf0.001 against scorers written by definition from the fitted models."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import language_id, lm, quality
from lexweave.llm import queries as q

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def remainder(key, m):
    return zlib.crc32(("" if key is None else str(key)).encode()) % m


def by_hand(text):
    """The document statistics of one text, word by word and byte by byte."""
    raw = (text or "").encode()
    groups = {1: set(range(65, 91)), 2: set(range(48, 58)), 5: set(b".,"), 6: set(b"!?"), 7: set(b"|"), 8: set(b"$%&*#@^~<>{}[]\\_=+"), 10: set(range(128, 256)), 11: (set(range(32)) | {127}) - {9, 10, 11, 12, 13}}
    named = set().union(*groups.values()) | set(range(97, 123)) | {32, 9, 10, 11, 12, 13}
    groups[9] = set(range(256)) - named
    count = {k: sum(b in v for b in raw) for k, v in groups.items()}
    size, lines = len(raw), raw.count(b"\n")
    spans = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [w.decode().translate(LOW) for _, w in spans]
    length = [len(w) for _, w in spans]
    n, mean = len(words), sum(length) / max(len(words), 1)
    ratio = lambda k: np.log((count[k] + quality.PROSE_BYTES * quality.PROSE[k]) / (size + quality.PROSE_BYTES) + 1e-3)
    share = lambda x, usual: np.log((x + quality.PROSE_WORDS * usual) / (n + quality.PROSE_WORDS) + 1e-2)
    return [
        *(ratio(k) for k in quality.PROSE), np.log((sum(length) + 6 * quality.PROSE_WORDS) / (n + quality.PROSE_WORDS)), np.log((sum((x - mean) ** 2 for x in length) + 9 * quality.PROSE_WORDS) / (n + quality.PROSE_WORDS)),
        share(sum(x > 20 for x in length), 0.01), share(sum(a == b for a, b in zip(words[1:], words[:-1], strict=True)), 0.005), np.log(len(set(words)) + 5) - 0.85 * np.log(n + 5),
        np.log((size + 3 * quality.PROSE_BYTES) / (lines + 1)), share(sum(65 <= w[0] <= 90 for _, w in spans), 0.1),
    ]


def test_op1_by_definition(spark):
    docs = {r["doc_id"]: r["text"] for r in q.table(spark, SF, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in q.table(spark, SF, "labels").collect()}
    x = {k: np.array(by_hand(t)) for k, t in docs.items()}
    cov, mean, n = [], [], []
    for c in (0, 1):
        own = np.array([x[k] for k in docs if labels.get(k) == c and remainder(k, 4) != 2])
        mean.append(own.mean(0))
        cov.append((own - mean[c]).T @ (own - mean[c]) / len(own))
        n.append(len(own))
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / sum(n)
    density = {}
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        for k, v in x.items():
            density[c, k] = -0.5 * ((v - mean[c]) @ np.linalg.solve(s, v - mean[c]) + np.linalg.slogdet(s)[1]) + np.log(n[c] / sum(n))
    got = {r["doc_id"]: r for r in q.op1_quality(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, r in got.items():
        expected = 1 / (1 + np.exp(np.clip(density[0, k] - density[1, k], -500, 500)))
        assert r["score"] == pytest.approx(expected, abs=1e-6) and (r["predicted"] == (expected >= 0.7) or abs(expected - 0.7) < 1e-6)


def test_op10_by_definition(spark):
    docs = q.table(spark, SF, "documents").select("doc_id", "text", "lang")
    net = language_id.train(docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1))
    p = {k: v.astype(float) for k, v in net.params.items()}
    got = {r["doc_id"]: r for r in language_id.predict(docs, net, columns=["doc_id"]).collect()}
    for row in docs.collect():
        raw, r = (row["text"] or "").encode(), got[row["doc_id"]]
        if not any(c.isalpha() for c in row["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs, probs = np.zeros(len(net.languages)), np.zeros(len(net.languages))
        for a in range(0, len(raw), net.window):
            part = raw[a : a + net.window]
            e = p["E"][np.frombuffer(part.ljust(net.window, b"\0"), np.uint8)]
            pooled = [np.maximum(np.max([e[t : t + w].ravel() @ p[f"W{w}"] for t in range(net.window - w + 1)], axis=0) + p[f"b{w}"], 0) for w in net.widths]
            z = np.concatenate(pooled) @ p["V"] + p["c"]
            z -= z.max()
            z -= np.log(np.exp(z).sum())
            logs, probs = logs + z * len(part), probs + np.exp(z) * len(part)
        best = int(logs.argmax())
        assert r["score"] == pytest.approx(probs[best] / len(raw), abs=1e-3)
        assert r["lang_pred"] == net.languages[best] or np.sort(logs)[-1] - np.sort(logs)[-2] < 1e-2 * len(raw)


def test_classes_of_the_language_model_by_loops():
    rng = np.random.default_rng(0)
    n = 5 + lm.GROUPS + 1
    m = lm.LogBilinear(5, rng.normal(size=(n + 1, 16)), rng.normal(size=(2, 16)), rng.normal(size=(n, 16)), rng.normal(size=n), np.full(n, 1 / n))
    far, near, word = rng.integers(0, n + 1, 40), rng.integers(0, n + 1, 40), rng.integers(0, n, 40)
    got = m.log_probabilities(far, near, word)
    for f, c, w, g in zip(far, near, word, got, strict=True):
        scores = []
        for t in range(n):
            scores.append(sum((m.vectors[c][d] * m.scale[0][d] + m.vectors[f][d] * m.scale[1][d]) * m.targets[t][d] for d in range(16)) + m.bias[t])
        assert g == pytest.approx(scores[w] - np.log(sum(np.exp(s) for s in scores)), abs=1e-4)


def test_op5_beats_its_base(spark):
    """Base scores word by word; on texts it has not seen the model does better."""
    rows = [(r["doc_id"], r["text"]) for r in q.table(spark, SF, "documents").collect()]
    base = {}
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for k, t in rows}
    for k, words in tokens.items():
        if remainder(k, 7) != 2:
            for w in words:
                base[w] = base.get(w, 0) + 1
    total, kinds = sum(base.values()), len(base)
    got = {r["doc_id"]: r for r in q.op5_lm_scoring(spark, SF).collect()}
    for k, words in tokens.items():
        assert got[k]["base_score"] == pytest.approx(sum(np.log10((base.get(w, 0) + 1) / (total + kinds + 1)) for w in words))
        assert np.isfinite(got[k]["score"]) and got[k]["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
