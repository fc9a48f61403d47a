"""Byte-level BPE by scans against the tiktoken library."""

import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from barwright.llm import scanbpe
from barwright.llm.common import read
from tests.llm.conftest import LONG, ODD

PARTS = ["a", "foo", "s", "t", "re", "ll", "ve", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "9", "½", "!", "é", "日", "ͅ", "\U0001f600", "-", "m", "d", "<|endoftext|>"]


@pytest.fixture(scope="module")
def coder():
    return scanbpe.loaded(scanbpe.default_ranks())


@pytest.fixture(scope="module")
def library(coder):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def lists(coder, texts):
    ids, own = coder.encode_many(texts)
    return [ids[a:b].tolist() for a, b in zip(own[:-1], own[1:], strict=True)]


@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_texts_side_by_side_equal_the_library(coder, library, texts):
    assert lists(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_all_of_unicode(coder, library):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    texts = ["x" * 5000, "ab" * 3000, " " * 4000 + "a", "'s" * 3000, every, LONG, "\n".join(every[:9000])]
    assert lists(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_composition_is_associative(coder):
    n, after = coder.scan.n, coder.scan.after.reshape(coder.scan.n, -1)
    f, g, h = np.indices((n, n, n)).reshape(3, -1)
    assert (after[after[f, g], h] == after[f, after[g, h]]).all()


def test_prefixes_equal_a_loop(coder):
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000, 5001):
        symbols = rng.integers(0, 16, size).astype(np.uint8)
        state, want = 0, []
        for s in symbols:
            state = scanbpe.step(int(s) % 8, 0 if s >= 8 else state)[0]
            want.append(state)
        assert coder.scan.state[coder.scan.prefixes(coder.scan.of_symbol[symbols])].tolist() == want


def test_offsets_cut_the_text_at_tokens(spark, coder):
    text = "Ça va ? It's 12 o'clock, 日本語 \U0001f600\n\n  done"
    r = scanbpe.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_ids=True).head()
    raw = text.encode()
    assert r.decoded == text and r.offsets[0] == 0
    for i, a, b in zip(r.ids, r.offsets, [*r.offsets[1:], len(raw)], strict=True):
        assert coder.vocabulary[i].as_py() == raw[a:b]
    assert bytes(coder.decode(np.array(r.ids[3:7]))) == raw[r.offsets[3] : r.offsets[7]]


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows_and_the_whole_table(spark, odd, none, sf_dir, library):
    want = sorted(((i, *digests(library, t)) for i, t in ODD), key=str)
    assert sorted(map(tuple, scanbpe.encode_documents(odd).collect()), key=str) == want
    assert scanbpe.encode_documents(none).collect() == []
    docs = read(spark, sf_dir, "documents")
    want = sorted((r.doc_id, *digests(library, r.text)) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, scanbpe.encode_documents(docs).collect())) == want
