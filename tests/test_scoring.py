"""Block scorers against scoring every pair by definition."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.functions import text as tx
from lexweave.operators import matching, scoring

WORDS = st.lists(st.sampled_from(["ab", "abc", "red", "Red", "lace", "brand#1", "x", "naïve", "日本", "aa", "a-b"]), max_size=5).map(" ".join)
NAMES = st.lists(WORDS | st.text(alphabet="ab c#é", max_size=12) | st.just("long word " * 12) | st.just("   "), min_size=1, max_size=8)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_definition(scorer, a, b):
    if scorer == "similarity":
        x, y = tx.trigram_set(a), tx.trigram_set(b)
        return len(x & y) / len(x | y) if x | y else 0.0
    if scorer == "levenshtein":
        return 1 - levenshtein(a, b) / max(len(a), len(b)) if a or b else 1.0
    if scorer == "wratio":
        return tx.wratio(a, b)
    return tx.extent_similarity(a, b, scorer.startswith("strict"))


@pytest.mark.parametrize("scorer", sorted(scoring.SCORERS))
def test_bounds_hold_and_exact_scores_are_exact(scorer):
    @settings(max_examples=60, deadline=None)
    @given(NAMES, NAMES)
    def check(queries, names):
        made = scoring.SCORERS[scorer](queries)
        low, high = made.bounds(names)
        true = np.array([[by_definition(scorer, q, n) for q in queries] for n in names])
        if made.single:
            true = true.astype(np.float32)
        if high is None:
            assert low == pytest.approx(true, abs=1e-12)
            return
        assert (low <= true + 1e-9).all() and (high >= true - 1e-9).all()
        n, q = np.nonzero(high > low)
        found = np.maximum(low[n, q], made.exact(names, n, q).astype(low.dtype))
        assert found == pytest.approx(true[n, q], abs=1e-9)
        settled = high <= low
        assert low[settled] == pytest.approx(true[settled], abs=1e-9)

    check()


def test_long_strings_use_several_words():
    rng = np.random.default_rng(0)
    queries = ["".join(rng.choice(list("abc "), n)) for n in (1, 63, 64, 65, 128, 200)]
    names = ["".join(rng.choice(list("abc "), n)) for n in (0, 1, 64, 90, 129, 300)]
    p = scoring.Patterns(queries)
    assert scoring.edit_distances(p, names).tolist() == [[levenshtein(q, n) for q in queries] for n in names]
    lcs = [[round(tx.indel_ratio(q, n) * (len(q) + len(n)) / 200) for q in queries] for n in names]
    assert scoring.common_lengths(p, names).tolist() == lcs
    pairs = [(q, n) for q in queries for n in names]
    assert scoring.common_length_of_pairs(*map(list, zip(*pairs, strict=True))).tolist() == [lcs[names.index(n)][queries.index(q)] for q, n in pairs]


@pytest.mark.parametrize("scorer", sorted(scoring.SCORERS))
@pytest.mark.parametrize("small", [False, True])
def test_best_lists_and_ranks(spark, monkeypatch, scorer, small):
    if small:
        monkeypatch.setattr(scoring, "BLOCK_PAIRS", 64)
        monkeypatch.setattr(scoring, "QUERY_BLOCK", 7)
        monkeypatch.setattr(scoring, "HOT_NAMES", 6)
    rng = np.random.default_rng(1)
    words = ["red", "green", "lace", "blue moon", "brand#12", "b", "misty rose", "lawn"]
    name = lambda: " ".join(rng.choice(words, rng.integers(1, 5)))
    reps = [(i, i, name(), False) for i in range(60)] + [(100 + i, int(rng.integers(0, 60)) if i % 3 else 5, name(), True) for i in range(90)] + [(999, 3, None, True)]
    queries = [(100 + i, reps[60 + i][2], reps[60 + i][1]) for i in range(0, 40, 2)] + [(500, "", 7), (501, None, 8)]
    q = spark.createDataFrame(queries, "query_id long, query_name string, canonical_id long")
    r = spark.createDataFrame(reps, "rep_id long, canonical_id long, rep_name string, is_alias boolean").repartition(3)
    best = {}
    for qid, text, _ in queries:
        for rid, c, n, alias in reps:
            if text is not None and n is not None and not (alias and rid == qid):
                s = by_definition(scorer, text, n)
                best[qid, c] = max(best.get((qid, c), -1), float(np.float32(s)) if scoring.SCORERS[scorer].single else s)
    order = {qid: sorted(((-s, c) for (k, c), s in best.items() if k == qid)) for qid, *_ in queries}
    top = matching.top_k(matching.max_pool(scoring.best_matches(q, r, scorer, 5)), 5).collect()
    got = {}
    for x in sorted(top, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["canonical_id"], pytest.approx(x["score"], abs=1e-9)))
    assert {k: [c for c, _ in v] for k, v in got.items()} == {k: [c for _, c in v[:5]] for k, v in order.items() if v}
    ranks = {x["query_id"]: (x["canonical_id"], x["expected_rank"]) for x in scoring.expected_ranks(q, r, scorer).collect()}
    assert ranks == {qid: (c, [x[1] for x in order[qid]].index(c) + 1) for qid, t, c in queries if t is not None}
    assert scoring.best_matches(q.limit(0), r, scorer).count() == 0 and scoring.best_matches(q, r.limit(0), scorer).count() == 0
    assert scoring.expected_ranks(q.limit(0), r, scorer).count() == 0
