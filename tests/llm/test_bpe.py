import hashlib

import numpy as np
import pytest
from helpers import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from veriloom.llm import bpe, packing  # noqa: E402

PATH, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "The", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "é", "É", "é", "İ", "Σ", "語", " ", "\x1c", "\x85", "123", " 9", "!?", "<|endoftext|>", "😀", "thing", "tion", "aaaa", "\x00", "²"]
mixed = st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=25).map("".join)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(mixed)
def test_equals_the_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    (coded,) = bpe.encoder(PATH).encode([text])
    assert np.frombuffer(coded, "<u4").tolist() == ids
    assert bpe.encoder(PATH).decode(coded) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(mixed)
def test_word_ids_equal_the_library(text):
    (coded,) = packing.coder(WORDS).encode([text])
    assert np.frombuffer(coded, "<u4").tolist() == packing.coder(WORDS).whole.encode(text, add_special_tokens=False).ids


def test_neighbours_are_what_plain_merging_leaves():
    e = bpe.Encoder(PATH)

    def merged(ids):
        while len(ids) > 1:
            rank, i = min((e.rank.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[i : i + 2] = [e.rank[ids[i], ids[i + 1]][1]]
        return ids

    rng = np.random.default_rng(1)
    for a, b in rng.integers(0, 50_000, (3000, 2)).tolist():
        assert e.neighbours(a, b) == (merged([e.single[x] for x in e.bytes_of[a] + e.bytes_of[b]]) == [a, b])


def test_caches_are_bounded(monkeypatch, library):
    for name in ("CACHE", "WORDS", "PAIRS"):
        monkeypatch.setattr(bpe, name, 8)
    e = bpe.Encoder(PATH)
    for i in range(40):
        text = f"word{i} some more words{i} and{i}"
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == library.encode(text).ids


def test_rows(spark, library):
    texts = ["hello world", None, "", "hello world", "<|endoftext|>", "x" * 50_000]
    df = clashing(documents(spark, [*enumerate(texts), (3, "hello world"), (None, "a")]))
    out = bpe.bpe_digest(df, PATH).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "a" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()}
    assert bpe.bpe_digest(df.limit(0), PATH).count() == 0
