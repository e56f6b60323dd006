"""Near duplicates, joins, decontamination, archives and the pipeline against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import components, decontaminate, lattice_dedup, ngram_join, warc
from lexweave.llm import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    expected = rel.fetchall()
    got = [tuple(r[c] for c in columns) for r in q.queries()[name](spark, SF).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


def brute_groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_groups(set(range(61)) | {100, 101, 102}, [e for e in edges if e[0] != e[1]])


# --------------------------------------------------------------------- joins --
def jaccard_rows(rows, threshold=0.8, n=5):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    groups = brute_groups(sets, links)
    same = {k: min(j for j in sets if j == k or (sets[j] and sets[j] == sets[k])) for k in sets}
    return {k: (same[k], sum(k in e for e in links), groups[k]) for k in sets}


def test_ngram_join_keeps_the_links_of_different_texts_of_one_key(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, b + " more")]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (3, 3, 1, 1)]


def test_ngram_join_of_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(90):  # one group of near copies, larger than a chunk
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 4)):
            w[j] = f"edit{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(20)] + [(200, None), (201, ""), (202, "!!"), (203, "one two"), (204, "One, TWO"), (205, "one two three four five six seven"), (206, " ".join(f"u{i}" for i in range(4000)))]
    expected = jaccard_rows(rows)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows] + [(100, " ".join(base), "y", 2), (None, "one two", "z", 3)], "doc_id long, text string, key string, codes int").repartition(5)
    got = ngram_join.jaccard_groups(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["key"] is None:
            assert (r["class_id"], r["n_links"], r["group_id"]) == (None, 0, None)
        else:
            assert (r["class_id"], r["n_links"], r["group_id"]) == expected[r["key"]], r["key"]
    assert ngram_join.jaccard_groups(docs.limit(0)).count() == 0


def test_both_ways_of_verifying_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    codes = np.zeros((40, 2), np.uint64)
    half = np.zeros(40, np.int64)
    brute = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(*map(np.ndarray.tolist, ngram_join.verify_block(sets, codes, half, 0.4)), strict=True)) == brute
    wide = [np.concatenate([s, np.arange(k * 1000, k * 1000 + 5, dtype=np.uint64) + np.uint64(10**6)]) for k, s in enumerate(sets)]
    ngram_join.verify_block(wide, codes, half, 0.4)


def test_plan_reaches_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.99), (0.9, 0.9999)):
        b, r = ngram_join.plan_bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall and b * r <= 256


# --------------------------------------------------------------- embeddings --
def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    y = rng.normal(0, 2, (50, 8))
    got = lattice_dedup.decode_e8(y)
    short = lattice_dedup.shortest_vectors()
    assert len(short) == 240 and np.allclose(np.square(short).sum(1), 2)
    for p, v in zip(got, y, strict=True):
        doubled = np.rint(p * 2).astype(int)
        assert np.allclose(p * 2, doubled) and (doubled % 2 == doubled[0] % 2).all() and doubled.sum() % 4 == 0
        assert all(np.square(v - p).sum() <= np.square(v - (p + s)).sum() + 1e-9 for s in short)


def test_near_duplicate_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    core = rng.normal(size=(6, 64))
    x, label = [], []
    for i in range(300):
        c = core[0] if i < 100 else core[rng.integers(0, 6)]
        x.append((c + rng.normal(0, rng.choice([0.03, 0.12, 0.3]), 64)).astype(np.float32))
        label.append(int(rng.integers(0, 2)) if i >= 100 else 0)
    x[5] = x[4] = x[3]
    x[6] = x[3] * 2
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label, strict=True))]
    rows += [(400, None, 0), (401, [0.0] * 64, 0), (402, [float("nan")] * 64, 0), (403, [None] * 64, 0), (404, x[3].tolist(), None), (405, x[3].tolist()[:32], 0), (406, [], 0), (407, [float("inf")] * 64, 0), (408, (x[3] * 1e-30).tolist(), 0)]
    u = {k: np.array(v, float) / np.linalg.norm(v) for k, v, lab in rows if k < 400}
    u[408] = np.array(rows[-1][1], float) / np.linalg.norm(np.array(rows[-1][1], float))
    lab = {k: b for k, _, b in rows}
    links = [(a, b) for a in u for b in u if a < b and lab[a] == lab[b] and u[a] @ u[b] >= 0.98]
    groups = brute_groups([k for k, *_ in rows], links)
    for chunk in (1024, 8):
        monkeypatch.setattr(lattice_dedup, "CHUNK", chunk)
        df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, x[3].tolist(), 0, "y"), (7, x[7].tolist(), label[7], "again")], "vec_id long, embedding array<float>, label int, code string").repartition(4)
        got = lattice_dedup.near_duplicates(df).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            k = r["key"]
            if k is None:
                assert (r["n_links"], r["component_id"]) == (0, None)
            else:
                assert (r["n_links"], r["component_id"]) == (sum(k in e for e in links), groups[k]), k
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_lattice_alone():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * noise  # exactly at the threshold
    h = lattice_dedup.LatticeHash(64, 6, 4, 1.5)
    zero = np.zeros(len(a), np.uint64)
    x, y = h(a, zero), h(b, zero)
    met = (x[:, :, None] == y[:, None, :]).any((1, 2)).mean()
    assert met >= 0.9


# ------------------------------------------------------------ decontamination --
def brute_hits(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(window, len(w))
        for k in range(len(w) - n + 1):
            wins.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n, table in wins.items():
            for a in range(len(w) - n + 1):
                if (ids := table.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= ids
        out.append((k, len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_phrases(spark, monkeypatch, block):
    rng = np.random.default_rng(0)
    w = lambda n, k: " ".join(f"t{i}" for i in rng.integers(0, k, n))
    items = [(1, w(30, 40)), (2, w(15, 5)), (3, "short item"), (4, None), (5, "!!"), (6, "Solo"), (1, "the the the the the the the the the the the"), (None, "short item")]
    docs = [(i, w(50, 8)) for i in range(20)] + [(50, items[0][1]), (51, f"x {items[0][1]} y {items[1][1]}"), (52, items[0][1][:60]), (53, "a SHORT, item b short item"), (54, None), (55, ""), (56, "solo"), (57, "the " * 500), (58, "end short"), (59, "item end")]
    docs += [(None, "short item"), (50, "solo solo")]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, segment string").repartition(3)
    index = decontaminate.build_index(d, segment_bytes=300)
    found = decontaminate.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int"))
    got = found.select("key", "n_words", decontaminate.hit_words().alias("h"), decontaminate.hit_items().alias("i")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["key"], r["n_words"], r["h"], r["i"]) for r in got], key=key) == sorted(brute_hits(docs, items), key=key)
    none = decontaminate.search(index, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(docs) and none.filter("size(runs) > 0").count() == 0
    assert decontaminate.search(decontaminate.build_index(d.limit(0)), d.select("doc_id", "text"), key="doc_id").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "f x x x x x x a"), (3, "c a"), (4, "a"), (5, None)], "doc_id long, text string")
    got = {(r["key"], r["first"], r["after"]) for r in decontaminate.near(decontaminate.build_index(d), ["a", "c"], 4).collect()}
    assert got == {(1, 0, 3), (3, 0, 2)}
    assert decontaminate.near(decontaminate.build_index(d), ["a", "nowhere"], 4).count() == 0


# ------------------------------------------------------------------ archives --
def test_archives(spark, tmp_path):
    big = "é" * 200
    rows = [(3, "http://B.example/x", big), (1, "http://a.example/", big), (2, None, "short"), (4, "http://a.example/\nq", "short"), (5, "http://a.example/", None), (6, "http://b.example/y", ""), (7, "http://b.example/z", "y" * (17 << 20)), (None, "http://n.example/", big), (1, "http://a.example/", big), (8, "http://c.example/", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "\0" * 300)]
    pages = spark.createDataFrame([(k, u, h, "x") for k, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/warc"
    got = warc.capture_histories(pages, path).collect()
    assert len(got) == len(rows)
    for r in got:
        h = next(h for k, u, h in rows if k == r["key"] and (k is not None or u)) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if r["key"] == 3 else ("response", None))
    order = sorted(got, key=lambda r: (r["range"], r["position"]))
    keys = [(r["url_key"], r["captured"], -1 if r["key"] is None else r["key"]) for r in order]
    assert keys == sorted(keys)
    import gzip

    for f in (tmp_path / "warc").glob("*.warc.gz"):
        data = f.read_bytes()
        assert gzip.decompress(data).startswith(b"WARC/1.1") or not data
        for r in got:
            if r["archive"] == f.name:
                fields, _ = warc.parse(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]))
                assert fields["WARC-Record-ID"] == warc.record_id(r["key"])
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_merge_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 20)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 15)
    pages = spark.createDataFrame([(i, "http://hot.example/" if i % 3 else f"http://h{i % 7}.example/{i}", f"page {i} " * 30) for i in range(200)], "page_id long, url string, html string").repartition(6)
    got = warc.capture_histories(pages).orderBy("range", "position").collect()
    keys = [(r["url_key"], r["captured"], r["key"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 200 and len({r["range"] for r in got}) > 5


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(0, 9):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 12)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(sum(runs, []))


# ------------------------------------------------------------------ pipeline --
def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    rows = [(1, a), (1, a), (2, a), (2, b), (4, "!!"), (4, "!!"), (None, "lone text"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (4, "!!"), (None, "lone text"), (5, None)], key=str)


def test_stages_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = q.table(spark, sf, "documents")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", None, None, None), (None, docs.first()["text"], "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
        if name != "byte_bpe":
            assert docs.columns == before.columns
    ids = lambda rows: {r["doc_id"] for r in rows}
    a, b = seen["language_id"]
    assert ids(a) - ids(b) == {10**6, 10**6 + 1}
    a, b = seen["quality"]
    labels = {r["doc_id"]: r["quality"] for r in q.table(spark, sf, "labels").collect()}
    assert sum(labels.get(i, 0) == 1 for i in ids(a) - ids(b)) == 0 and all(labels.get(i, 1) == 1 for i in ids(b))
    a, b = seen["ngram_join"]
    groups = jaccard_rows([(r["doc_id"], r["text"]) for r in a if r["doc_id"] is not None])
    assert ids(b) == {k for k, (_, _, g) in groups.items() if g == k} | {None}
    a, b = seen["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in q.table(spark, sf, "benchmark").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in a], items)
    assert ids(b) == {k for k, _, h, _ in hits if not h}
    a, b = seen["byte_bpe"]
    assert ids(a) == ids(b) and all(r["round_trip"] and len(r["input_ids"]) == r["n_tokens"] for r in b)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, q.table(spark, sf, "documents").limit(0), sf).count() == 0, name
