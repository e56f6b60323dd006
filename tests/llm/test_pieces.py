"""Pieces of texts, the ends of Re-Pair, word hashes and bounded memory."""

import collections
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import byte_bpe, pieces, token_files
from lexweave.llm.common import WordHasher, alnum_table, word_hash

#: Characters around which borders are easily got wrong.
ODD = st.text(alphabet=" \t\n\r\x0b\x1c\x1f\x85\xa0 　'’ab.,!19sSéßЖ日×÷ſdłtve<|😀", max_size=40)


def both(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        own = token_files.PieceEncoder(f.read())
    v = byte_bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return own, Tokenizer.from_file(path), byte_bpe.Encoder(v)


@pytest.mark.parametrize("window", [8 << 20, 7])
def test_pieces_keep_the_ids_of_whole_texts(encoders, monkeypatch, window):
    monkeypatch.setattr(pieces, "WINDOW_BYTES", window)
    own, library, bpe = encoders

    @settings(max_examples=200, deadline=None)
    @given(st.lists(ODD | st.text(max_size=20), min_size=1, max_size=5))
    def check(texts):
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, at = own.encode(*both(texts), 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*e, 2] for e in expected]
        ids, at = bpe.encode_texts(*both(texts))
        if not any("<|" in t for t in texts):
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == expected

    check()


def test_added_tokens_are_found_in_whole_texts(encoders):
    own, library, _ = encoders
    texts = ["a  <|endoftext|> b", "plain words", "<|endoftext|>"]
    ids, at = own.encode(*both(texts), 2)
    assert [ids[a : b - 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def most_places(symbols):
    """The largest number of places of a pair that do not overlap."""
    last, count = {}, collections.Counter()
    for i, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)):
        if last.get(p, -2) < i - 1:
            count[p] += 1
            last[p] = i
    return max(count.values(), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(2, 6), st.integers(1, 4))
def test_no_pair_is_left_that_pays(ids, least, times):
    g = token_files.Grammar.compress(np.array(ids * times, np.uint32), least)
    assert g.decode().tolist() == ids * times and most_places(g.symbols.tolist()) < least


def test_a_document_expands_its_own_symbols_only():
    rng = np.random.default_rng(0)
    passages = [rng.integers(0, 2000, 60) for _ in range(200)]
    ids = np.concatenate([passages[i] for i in rng.integers(0, 200, 5000)]).astype(np.uint32)
    g = token_files.Grammar.compress(ids)
    assert len(g.symbols) < len(ids) / 20
    for a in (0, 1000, 150_000, len(ids) - 60):
        g.expanded = 0
        assert (g.decode(a, a + 60) == ids[a : a + 60]).all()
        assert g.expanded <= 200  # a parse tree over 60 ids, and the paths down its two edges


def test_files_are_rolled_and_ordered(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 200)
    monkeypatch.setattr(token_files, "FILE_SHARDS", 2)
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(120)], "doc_id long, text string").repartition(5)
    rows = token_files.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["key"] for r in rows] == list(range(120)) and len({r["start"] for r in rows}) == 120
    names = ["part-100000-x.txt", "part-99999-x-c000.txt", "part-99999-x-c1000.txt", "part-99999-x-c999.txt"]
    assert sorted(names, key=token_files.file_order) == [names[1], names[3], names[2], names[0]]


def test_structured_words_have_hashes_of_their_own():
    a = "a"
    for _ in range(12):
        a += a.translate({97: 98, 98: 97})
        b = a.translate({97: 98, 98: 97})
        hashes = word_hash(WordHasher(alnum_table()), [a, b])
        assert hashes[0] != hashes[1]


def test_a_very_long_text_in_a_bounded_worker():
    code = """
import resource, sys
import numpy as np
from lexweave.llm import quality
from lexweave.llm.common import WordHasher, alnum_table, nonspace_table
rng = np.random.default_rng(0)
words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(5000)]
data = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 5000, 11_500_000)), np.uint8)
data = data[: 64 << 20]
assert len(data) > 60 << 20
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality.statistics(data, np.array([0, len(data)]), WordHasher(nonspace_table()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert float(out) < 1200  # under 20 bytes for each byte of a 64 MB text
