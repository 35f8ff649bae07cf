import random
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from veriloom.llm import langid, quality  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
EN = "the cat sat on the mat and then it went home with a dog that was there before".split()
DE = "der hund und die katze sind nicht in dem haus weil es heute noch regnet und schneit".split()


def sentence(words, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    counts = {g: Counter(langid.words_of(" ".join(w) * 5)) for g, w in (("en", EN), ("de", DE))}
    return langid.learn(counts, PATH)


def brute(word, model, g):
    """Sum over all segmentations, by recursion."""
    index, w = {p: i for i, p in enumerate(model.pieces)}, langid.MARK + word

    def rest(i):
        if i == len(w):
            return 1.0
        total = 0.0
        for n in range(1, len(w) - i + 1):
            k = index.get(w[i : i + n], len(model.pieces) if n == 1 else None)
            total += 0 if k is None else model.p[k, g] * rest(i + n)
        return total

    return rest(0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdehnrst語éß.x", min_size=1, max_size=9), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(model, words):
    got = langid.word_scores(words, langid.Matcher(model.pieces), model.p)
    want = np.log([[brute(w, model, g) for g in range(len(model.langs))] for w in words])
    assert np.allclose(got, want, rtol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.text("abcdehnrst語éß.x", min_size=1, max_size=12), st.integers(2, 7))
def test_long_words_sum_all_segmentations_too(model, word, section):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "SECTION", section)
        got = langid.long_score(word, langid.Matcher(model.pieces), model.p)
    assert np.allclose(got, np.log([brute(word, model, g) for g in range(len(model.langs))]), rtol=1e-9)


def test_very_long_words_neither_underflow_nor_are_cut(model):
    matcher = langid.Matcher(model.pieces)
    assert max(map(len, model.pieces)) > 8
    once = langid.long_score("abcdehnrst" * 5, matcher, model.p)
    assert np.isfinite(langid.long_score("abcdehnrst" * 9_000, matcher, model.p)).all()
    assert np.allclose(once, langid.word_scores(["abcdehnrst" * 5], matcher, model.p)[0], rtol=1e-9)
    word = "der" * 40
    assert langid.Scorer(model).predict([word, "der der", word]) [0] == langid.Scorer(model).predict([word])[0]


def test_cache_is_bounded_by_bytes(model, monkeypatch):
    texts = [sentence(EN, i) for i in range(6)]
    want = langid.Scorer(model).predict(texts)
    monkeypatch.setattr(langid, "CACHE", 1)
    scorer = langid.Scorer(model)
    assert [scorer.predict([t])[0] for t in texts] == want and len(scorer.row) <= len(set(texts[-1].split()))


def test_least_hashed_sample(spark):
    """Against a window that ranks all; a key with very many rows counts once."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from veriloom.llm.common import least_hashed, within_bytes

    rows = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("g"))
    rows = rows.union(spark.range(20_000).select(F.lit(5).cast("long"), F.lit("b")))
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("k"), "k"))).where("r <= 50").orderBy("r").collect()
    assert least_hashed(rows, 50) == {g: [r["k"] for r in ranked if r["g"] == g] for g in "ab"}
    assert least_hashed(rows.limit(0), 50) == {} and len(least_hashed(rows, 10_000)["a"]) == 429
    docs = documents(spark, [(1, "é" * 10), (2, "a" * 5), (3, None), (4, "b")])
    assert within_bytes(docs, [1, 2, 9, 3, 4], 25, "doc_id", "text") == [1, 2, 3] and within_bytes(docs, [1, 2, 4], 6, "doc_id", "text") == [2, 4]


def test_learning_normalises(model):
    assert model.langs == ["de", "en"]
    assert np.allclose(model.p.sum(axis=0), 1, atol=1e-4) and (model.p > 0).all()


def test_language_rows(spark):
    texts = [sentence(EN if i % 2 else DE, i) for i in range(60)] + [None, "", "123 !?", "x" * 5000, "語"]
    langs = ["en" if i % 2 else "de" for i in range(60)] + [None] * 5
    df = clashing(documents(spark, texts, langs))
    out = {r["doc_id"]: r for r in langid.predict(df, langid.train(df, PATH)).collect()}
    assert all(out[i]["lang_pred"] == langs[i] and out[i]["score"] > 0.5 for i in range(60))
    assert [out[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3
    assert out[63]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in out.values())
    kept = langid.keep(df, langid.train(df, PATH), 0.5)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(range(60))
    none = df.limit(0)
    assert langid.predict(none, langid.train(none, PATH)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(none, PATH)).collect()} == {"und"}


def test_quality_rows(spark):
    rng = random.Random(4)
    junk = lambda i: " ".join(rng.choice(EN) + rng.choice(["%%%", "###", "&&&"]) for _ in range(60))
    texts = [sentence(EN, i, 60) if i % 2 else junk(i) for i in range(240)] + [None, "", "a" * 20_000]
    df = clashing(documents(spark, texts))
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(0, 0), (241, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    out = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    assert np.mean([out[i]["predicted"] == i % 2 for i in range(240)]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values()) and len(out) == 243
    assert quality.keep(df, model, 0.1).columns == df.columns
    bare = quality.train(df, labels.limit(0))
    assert {r["score"] for r in quality.score(df, bare).collect()} == {0.5}
    assert quality.score(df.limit(0), bare).count() == 0


def test_held_out_rows_teach_nothing(spark):
    from pyspark.sql import functions as F

    df = documents(spark, [sentence(EN, i) for i in range(30)])
    labels = df.select("doc_id", F.lit(1).alias("quality")).where(quality.fold("doc_id", 3) == 1)
    assert quality.train(df, labels).dictionaries == (b"", b"")
