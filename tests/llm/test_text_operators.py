"""Quality, language ID, language model, token files and byte-level BPE against brute force on small tables."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import byte_bpe, language_id, lm, quality, token_counts, token_files
from lexweave.llm import queries as q
from lexweave.llm.common import WordHasher, alnum_table, remainder, word_hash

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "x  y\n\n z ", "日本語 テスト 😀", "!!! 123", "word " * 3000, "z" * 20000, "<|endoftext|> don't\x1c \x85", "ÀÉ ß"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None, 0.0, "k") for i, t in enumerate(ODD)] + [(None, "null id text", None, None, 1, None, None), (3, "a", "en", "s", 1, 0.0, "k"), (3, "other text", "en", "s", 1, 0.0, "k")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_bpe(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})


# ------------------------------------------------------------------- words --
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=6))
def test_word_hashes_are_of_the_words(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, before = WordHasher(alnum_table())(data, offsets)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.decode().translate(low)) for r in raw]
    assert np.diff(before).tolist() == [len(w) for w in words]
    for h, w in zip(hashes, [x for ws in words for x in ws], strict=True):
        assert word_hash(WordHasher(alnum_table()), [w])[0] == h


# --------------------------------------------------------------------- BPE --
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(text):
    v = test_bpe_equals_the_library.v
    assert v.encode(text).tolist() == test_bpe_equals_the_library.ref.encode_ordinary(text)
    assert test_bpe_equals_the_library.dec.decode(v.encode(text))[0].tobytes() == text.encode()


@pytest.fixture(autouse=True, scope="module")
def _bpe(vocabulary, reference_bpe):
    test_bpe_equals_the_library.v, test_bpe_equals_the_library.ref, test_bpe_equals_the_library.dec = byte_bpe.Encoder(vocabulary), reference_bpe, byte_bpe.Decoder(vocabulary)


def test_bpe_equals_merging_by_definition(vocabulary):
    enc = byte_bpe.Encoder(vocabulary)
    rng = np.random.default_rng(0)
    for _ in range(300):
        word = bytes(rng.choice(np.frombuffer(b"abcdeth in\xc3\xa9", np.uint8), rng.integers(1, 25)))
        if word in vocabulary.ids:
            continue
        assert enc.encode_bytes(word) == [vocabulary.ids[p] for p in byte_bpe.merge_by_rank(word, vocabulary.ids)]


def test_bpe_on_a_tiny_vocabulary_that_needs_backtracking():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    enc = byte_bpe.Encoder(byte_bpe.Vocabulary(ranks, r".+"))
    rng = np.random.default_rng(1)
    for _ in range(500):
        word = bytes(rng.choice(np.frombuffer(b"abcd", np.uint8), rng.integers(1, 12)))
        assert enc.encode_bytes(word) == ([ranks[word]] if word in ranks else [ranks[p] for p in byte_bpe.merge_by_rank(word, ranks)])


def test_bpe_over_rows(spark, odd, vocabulary, reference_bpe):
    e = byte_bpe.encode(odd.select("doc_id", "text", "score"), vocabulary, keep_text=True)
    rows = e.collect()
    assert len(rows) == odd.count() and all(r["ids"] == reference_bpe.encode_ordinary(r["text"] or "") for r in rows)
    d = byte_bpe.decode(e, vocabulary).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in d)
    assert byte_bpe.encode(odd.limit(0).select("doc_id", "text"), vocabulary).count() == 0


def test_op9(spark, reference_bpe):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in q.table(spark, SF, "documents").collect()}
    rows = q.op9_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference_bpe.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# ------------------------------------------------------------- token files --
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(2, 6))
def test_grammar_round_trip_and_random_access(ids, least):
    ids = np.array(ids, np.uint32)
    g = token_files.Grammar.compress(ids, least)
    assert (g.decode() == ids).all()
    for a in range(0, len(ids), 37):
        assert (g.decode(a, a + 50) == ids[a : a + 50]).all()
    assert len(g.symbols) <= len(ids)


def test_grammar_with_many_symbols():
    ids = np.random.default_rng(0).integers(0, 90_000, 200_000).astype(np.uint32)
    ids[1000:41000:2], ids[1001:41001:2] = 7, 8
    g = token_files.Grammar.compress(ids)
    assert len(g.alphabet) > 1 << 16 and len(g.rules) and (g.decode() == ids).all()


def _expected_files(rows, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_op7(spark, odd, which):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd if which == "odd" else q.table(spark, SF, "documents")
    got = q.token_files.write_and_read(docs.select("doc_id", "text"), path) if which == "odd" else q.op7_token_files(spark, SF).withColumnRenamed("doc_id", "key")
    rows = [(r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()]
    expected = _expected_files([(r["doc_id"], r["text"]) for r in docs.collect()], path)
    assert sorted(rows, key=lambda r: r[1]) == expected


def test_token_files_of_nothing(spark, odd):
    assert token_files.write_and_read(odd.select("doc_id", "text").limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_damaged_files_are_noticed():
    import pyarrow as pa

    data = token_files.Shard(pa.array([1, 2]), np.array([0, 2, 3]), token_files.Grammar.compress(np.array([5, 6, 7], np.uint32))).to_bytes()
    (s,) = token_files.shards(memoryview(data))
    assert s.document(0).tolist() == [5, 6] and s.document(1).tolist() == [7] and s.keys.to_pylist() == [1, 2]
    with pytest.raises(ValueError):
        list(token_files.shards(memoryview(data[:-3])))
    with pytest.raises(ValueError):
        list(token_files.shards(memoryview(b"x" + data)))


# ------------------------------------------------------------------ quality --
def test_op1_learns_and_keeps_rows(spark):
    rows = q.op1_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in q.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_discriminant_against_densities():
    rng = np.random.default_rng(0)
    k = 3
    x = [rng.normal(size=(500, k)), rng.normal(2, 2, size=(500, k))]
    m = quality.QuadraticDiscriminant.from_moments(np.array([500.0, 500.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), shrink=0.2, diagonal=0.1)
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = sum(cov) / 2
    both = []
    for c in (0, 1):
        s = 0.8 * cov[c] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-4 * np.eye(k)
        d = x[1] - x[c].mean(0)
        both.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    assert np.allclose(m.score(x[1]), 1 / (1 + np.exp(both[0] - both[1])))


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (3, 0), (4, 1), (5, 0), (5, 1), (6, None), (7, 3), (None, 1), (8, 0)], "doc_id long, quality int")
    stats = quality.document_statistics(odd)
    for model in (quality.fit(stats, labels), quality.fit(stats, labels.limit(0)), quality.fit(stats, labels.filter("quality = 1"))):
        rows = quality.score_documents(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and set(rows[0].asDict()) == set(odd.columns)
    assert quality.fit(stats, labels.limit(0)).prior == 0.5
    assert quality.score_documents(odd.limit(0), model).count() == 0


# -------------------------------------------------------------- language ID --
def test_convolution_tables_equal_the_sum():
    net = language_id.ByteConvNet(["a", "b", "c"], window=20, embed=4, filters=5, widths=(2, 3, 4))
    net.init()
    x = np.random.default_rng(0).integers(0, 256, (7, 20), dtype=np.uint8)
    e = net.params["E"][x]
    pooled = []
    for w in net.widths:
        out = np.stack([e[:, t : t + w].reshape(7, -1) @ net.params[f"W{w}"] for t in range(20 - w + 1)], 1) + net.params[f"b{w}"]
        pooled.append(np.maximum(out.max(1), 0))
    z = np.concatenate(pooled, 1) @ net.params["V"] + net.params["c"]
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), z, atol=1e-4)


def test_gradients_are_numerically_right():
    net = language_id.ByteConvNet(["a", "b"], window=12, embed=3, filters=2, widths=(2, 3))
    net.init()
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (5, 12), dtype=np.uint8), rng.integers(0, 2, 5)
    _, g = net.gradients(x, y)
    for name in ("V", "W2", "W3", "E", "b2"):
        i = tuple(np.argwhere(np.abs(g[name]) == np.abs(g[name]).max())[0])
        old, eps = net.params[name][i], 1e-5
        losses = []
        for d in (eps, -eps):
            net.params[name][i] = old + d
            losses.append(net.gradients(x, y)[0])
        net.params[name][i] = old
        assert (losses[0] - losses[1]) / (2 * eps) == pytest.approx(g[name][i], rel=1e-2, abs=1e-6)


def test_windows_tile_whole_texts():
    raw = [b"", b"abc", b"x" * 25]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.array([0, 0, 3, 28])
    x, doc, n = language_id.windows(data, offsets, 10)
    assert doc.tolist() == [1, 2, 2, 2] and n.tolist() == [3, 10, 10, 5] and x[0].tobytes() == b"abc" + bytes(7) and x[3].tobytes() == b"xxxxx" + bytes(5)


def test_op10_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in q.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = q.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.95


def test_language_odd_rows(spark, odd):
    net = language_id.train(q.table(spark, SF, "documents"))
    rows = language_id.predict(odd, net).collect()
    got = {(r["doc_id"], r["text"]): r for r in rows}
    assert len(rows) == odd.count() and {got[i, ODD[i]]["lang_pred"] for i in (0, 1, 2, 6)} == {"und"} and got[5, ODD[5]]["lang_pred"] != "und"
    assert set(rows[0].asDict()) == set(odd.columns) | {"lang_pred"}
    assert language_id.predict(odd.limit(0), net).count() == 0
    none = language_id.train(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    one = language_id.train(odd.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(odd, one).collect()} == {"und", "en"}


# ------------------------------------------------------------ language model --
def _base(rows, train):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]) for k, t in rows]
    c = collections.Counter(w for k, ws in toks if train(k) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(k, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in toks]


def test_op5(spark):
    docs = [(r["doc_id"], r["text"]) for r in q.table(spark, SF, "documents").collect()]
    train = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    got = {r["doc_id"]: r for r in q.op5_lm_scoring(spark, SF).collect()}
    for k, n, known, total, base in _base(docs, train):
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not train(k)) and r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_lm_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    got = lm.score_documents(odd, F.lit(True), rounds=1).collect()
    expected = _base([(r["doc_id"], r["text"]) for r in odd.collect()], lambda k: True)
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    assert sorted(map(key, [(r["key"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got])) == sorted(map(key, expected))
    untrained = lm.score_documents(odd, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in untrained)
    assert lm.score_documents(odd.limit(0), F.lit(True)).count() == 0


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    n = lm.GROUPS + 4
    near = rng.integers(0, 3, 4000)
    word = (near + 1) % 3
    far = rng.integers(0, 3, 4000)
    m = lm.LogBilinear.start(np.bincount(word, minlength=n).astype(float))
    state = [np.zeros_like(p) for p in m.parameters()]
    before = m.log_probabilities(far, near, word).mean()
    for _ in range(10):
        m.train(far, near, word, np.ones(4000), state, rng)
    assert m.log_probabilities(far, near, word).mean() > before + 0.5
    total = sum(np.exp(m.log_probabilities(np.array([1]), np.array([2]), np.array([w])))[0] for w in range(n))
    assert total == pytest.approx(1, abs=1e-5)


def test_lm_learns_words_outside_the_shortlist(spark):
    from pyspark.sql import functions as F

    # two words of one group and one count: only vectors or counts of their own can tell them apart
    rows = [(i, ("p alphaxx q", "r betaxx s", "p", "q", "r", "s")[i % 6]) for i in range(600)]
    ask = ["p alphaxx", "p betaxx", "alphaxx q", "betaxx q", "alphaxx p q", "betaxx p q"]
    docs = spark.createDataFrame([*rows, *[(1000 + i, t) for i, t in enumerate(ask)]], "doc_id long, text string").repartition(2)
    got = {r["key"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") < 1000, shortlist=4).collect()}
    assert got[1000] > got[1001] + 0.3 and got[1002] > got[1003] + 0.3


def test_lm_is_normalised_over_all_words():
    rng = np.random.default_rng(0)
    k, size = 5, 200
    n = k + lm.GROUPS + 1
    group = rng.integers(0, lm.GROUPS, size)
    m = lm.LogBilinear(k, rng.normal(size=(n + 1, 16)), np.ones((2, 16)), rng.normal(size=(n, 16)), rng.normal(size=n), np.full(n, 1 / n))
    own = lm.OwnWords.start(m)
    counts = rng.integers(0, 4, (size, 3 * lm.STATES)) * (rng.random((size, 3 * lm.STATES)) < 0.2)
    counts[-lm.GROUPS :], group[-lm.GROUPS :] = 0, np.arange(lm.GROUPS)  # an unseen word of each group
    known = counts[:, : lm.STATES].sum(1) > 0
    known[-lm.GROUPS :] = True
    own = own.with_sums(own.sums(counts, group))
    for near, far in ((0, 1), (size - 70, 2), (3, size - 80)):
        word = np.concatenate([np.arange(k), [n - 1], k + group[known]])
        place = np.concatenate([np.full(k + 1, -1), np.flatnonzero(known)])
        full = lambda x: np.full(len(word), x)  # noqa: B023, E731
        p = own.log_probabilities(full(k + group[far]), full(k + group[near]), word, (place, full(near), full(far)), counts.astype(np.float32))
        assert np.exp(p).sum() == pytest.approx(1, abs=1e-5)


# -------------------------------------------------------------- token counts --
def test_ledger(spark, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    schema = "kind string, source string, lang string, version string, tokens long, old_tokens long"
    assert ledger.totals().count() == 0
    a = spark.createDataFrame([("insert", "s", "en", "v", 5, None), ("insert", "s", "en", "v", 7, None), ("insert", None, None, "v", None, None)], schema)
    b = spark.createDataFrame([("revise", "s", "en", "v", 9, 7), ("delete", "s", "en", "v", 5, None)], schema)
    assert ledger.commit("1", a) and ledger.commit("1", a) and ledger.commit("2", b) and ledger.commit("3", a.limit(0))
    expected = {("s", "en", "v", 1, 9), (None, None, "v", 1, 0)}
    assert {tuple(r) for r in ledger.totals().collect()} == expected
    ledger.compact()
    assert not ledger.commit("2", b) and {tuple(r) for r in ledger.totals().collect()} == expected
    assert ledger.commit("4", spark.createDataFrame([("delete", "s", "en", "v", 9, None)], schema))
    ledger.compact()
    assert {tuple(r) for r in ledger.totals().collect()} == {(None, None, "v", 1, 0)}
    with pytest.raises(Exception, match="unknown kind"):
        ledger.commit("5", spark.createDataFrame([("move", "s", "en", "v", 9, None)], schema))
    assert ledger.batches() == []


def test_remainder_is_crc32_of_the_text(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 7, 123456789, None]], "k long").select("k", remainder("k", 7).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(("" if r["k"] is None else str(r["k"])).encode()) % 7 for r in rows)
