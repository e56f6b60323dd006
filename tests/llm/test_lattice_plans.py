"""Recall and selectivity of the lattice plans, and components with hot keys."""

import numpy as np
import pytest

from lexweave.llm import components, lattice_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("vectors", [100, 1000, 1_000_000, 10**9])
def test_plans_find_pairs_at_the_threshold(vectors):
    rng = np.random.default_rng(vectors)
    blocks, tables, probes = lattice_dedup.plan(vectors)
    for d in (32, 64):
        a = unit(rng.normal(size=(3000, d)))
        noise = rng.normal(size=a.shape)
        noise = unit(noise - (noise * a).sum(1, keepdims=True) * a)
        h = lattice_dedup.LatticeHash(d, tables, probes, lattice_dedup.default_scale(0.98), blocks)
        zero = np.zeros(len(a), np.uint64)
        x, y = h(a, zero), h(0.98 * a + np.sqrt(1 - 0.98**2) * noise, zero)
        met = np.zeros(len(a), bool)
        for k in range(x.shape[1]):
            met |= (x[:, k : k + 1] == y).any(1)
        assert met.mean() >= 0.995


def test_chance_meetings_stay_few_as_vectors_grow():
    rng = np.random.default_rng(0)
    met = {}
    for n in (1000, 10_000, 50_000):
        blocks, tables, probes = lattice_dedup.plan(n)
        codes = lattice_dedup.LatticeHash(64, tables, probes, lattice_dedup.default_scale(0.98), blocks)(unit(rng.normal(size=(n, 64))), np.zeros(n, np.uint64))
        _, count = np.unique(codes, return_counts=True)
        met[n] = (count * (count - 1.0)).sum() / n
    assert max(met.values()) < 8


def test_links_do_not_depend_on_how_many_vectors_a_label_has(spark):
    assert len({lattice_dedup.plan(n) for n in (0, 300, 301, 100_000, 100_001, 10**6, 10**8, 10**9)}) == 1
    rng = np.random.default_rng(177)
    a = unit(rng.normal(size=(600, 16)))
    noise = unit(rng.normal(size=a.shape))
    noise = unit(noise - (noise * a).sum(1, keepdims=True) * a)
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * noise
    pairs = [(2 * i + j, v.tolist(), i) for i in range(600) for j, v in enumerate((a[i], b[i]))]
    found = {}
    for name, rows in {"one label": [(k, v, 0) for k, v, _ in pairs], "a label for each pair": pairs}.items():
        got = lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        found[name] = {r["key"]: (r["n_links"], r["component_id"]) for r in got}
    assert found["one label"] == found["a label for each pair"] == {k: (1, k - k % 2) for k, _, _ in pairs}


def test_pairs_at_the_threshold_are_decided_alike_in_blocks_of_any_size():
    rng = np.random.default_rng(4)
    raw = unit(rng.normal(size=(2, 48))) * [[3.0], [0.2]]
    threshold = float(lattice_dedup.cosines(raw[:1], raw[1:])[0])
    x, y = raw
    assert threshold == sum(p * q for p, q in zip(x, y, strict=True)) / (np.sqrt(sum(p * p for p in x)) * np.sqrt(sum(q * q for q in y)))
    for limit, linked in ((threshold, True), (np.nextafter(threshold, 2), False)):
        for n in (2, 3, 7, 64, 500):
            rows = np.concatenate([raw, -raw[:1] + rng.normal(0, 1e-3, (n - 2, 48))]) if n > 2 else raw
            i, j = lattice_dedup.link_pairs(
                unit(rows), rows, np.zeros((n, 1), np.int64), np.array([0, n]), np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([False]), limit
            )
            assert ((0, 1) in set(zip(i.tolist(), j.tolist(), strict=True))) == linked, (n, limit)
    assert np.isclose(lattice_dedup.cosines(raw * 1e200, raw[::-1] * 1e-200), threshold).all()


def test_labels_and_vectors_are_told_apart(spark):
    rows = [(1, [1.0, 2.0], "a1"), (2, [2.0], "a1,1.0"), (3, [1.0, 2.0], "a1"), (4, [11.0, 2.0], "a")]
    got = {r["key"]: (r["n_links"], r["component_id"]) for r in lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}


def test_components_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_ROWS", 3)
    edges = [(i, 0) for i in range(1, 200)] + [(i, 500) for i in range(501, 560)] + [(559, 199), (900, 901), (901, 902), (902, 903)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(500, 560), 0), **dict.fromkeys((900, 901, 902, 903), 900)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_of_large_sets_stay_few(spark, monkeypatch):
    from lexweave.llm import ngram_join

    seen = []
    real = ngram_join._with_sets
    monkeypatch.setattr(ngram_join, "_with_sets", lambda docs, n: seen.append(sorted({r["chunks"] for r in docs.select("chunks").collect()})) or real(docs, n))
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 30_000)
    base = [f"w{i}" for i in range(1000)]
    rows = [(k, " ".join([*base[:500], f"x{k}", *base[500:]])) for k in range(20)] + [(100, "a b c d e f"), (101, "a b c d e f g")]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["key"]: (r["n_links"], r["group_id"]) for r in got if r["key"] < 100} == {k: (19, 0) for k in range(20)}
    assert max(seen[0]) == -(-20 * 997 * 8 // 30_000)


@pytest.mark.parametrize("buckets", ["never", "always", "by cost"])
def test_components_and_buckets_find_the_same_links(spark, monkeypatch, buckets):
    from lexweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CHUNK", 6)
    monkeypatch.setattr(ngram_join, "MOST_CHUNKS", {"never": 10**9, "always": 0, "by cost": 1}[buckets])
    monkeypatch.setattr(ngram_join, "plan_bands", lambda t, r: (40, 2))  # so unselective that chance meetings make long chains
    if buckets == "always":
        monkeypatch.setattr(ngram_join, "BUCKET_COST", 0.0)
    dealt, deal = [], ngram_join._deal
    monkeypatch.setattr(ngram_join, "_deal", lambda blocks: dealt.append(blocks.count()) or deal(blocks))
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        w = list(base) if k < 40 else [f"v{x}" for x in rng.integers(0, 40, 60)]
        for j in rng.integers(0, 60, rng.integers(0, 5)):
            w[j] = f"e{rng.integers(0, 9)}"
        rows.append((k, " ".join(w)))
    from test_pair_operators import jaccard_rows

    expected = jaccard_rows(rows)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["key"]: (r["class_id"], r["n_links"], r["group_id"]) for r in got} == expected
    assert len(dealt) == 1 if buckets == "never" else len(dealt) == 2
    assert buckets != "always" or dealt[1] > 0
