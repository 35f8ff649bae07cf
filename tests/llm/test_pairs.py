import hashlib
import random
import re

import numpy as np
import pytest
from helpers import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import ann, components, minhash, suffix

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, seed, k):
    rng, words = random.Random(seed), text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = [prose(s, 120) for s in range(20)]
    texts += [edited(prose(100, 150), s, s % 14) for s in range(90)]  # many around the threshold
    chain = prose(200, 200)
    for s in range(30):  # far ends differ, neighbours don't
        chain = edited(chain, s, 3)
        texts.append(chain)
    texts += [texts[0]] * 40 + [texts[1].upper(), None, "", " \t\n", "one two", "One  two", "É one", "é one", "same " * 3000]
    rows = [*enumerate(texts), (3, texts[3])]
    df = clashing(documents(spark, rows))
    got = minhash.near_duplicates(df).collect()
    want = brute_components(list(enumerate(texts)))
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[i], len(shingles(texts[i])), want[i] == i)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_null_ids(spark):
    out = minhash.near_duplicates(documents(spark, [(None, prose(1, 50)), (None, prose(2, 50)), (7, prose(1, 50))])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == [(-1, -1, True), (-1, 7, False), (7, 7, True)]


def test_signatures_estimate_similarity():
    a, b = np.arange(4000, dtype=np.uint64), np.arange(1000, 5000, dtype=np.uint64)
    c = minhash.Circulant()
    x, y = (c.signature(minhash._mixed(v * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))) for v in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.15


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    out = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[101] == 100
    assert components.components(links.limit(0)).count() == 0


# ------------------------------------------------------------------ suffixes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=200))
def test_suffix_array(values):
    order = suffix.suffix_array(np.array(values, np.int64)).tolist()
    assert order == sorted(range(len(values)), key=lambda i: values[i:])


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), len(raw) - len(kept), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def repeated_texts():
    passage, line = prose(1, 60), "a very common line of fewer than one hundred bytes, in many texts. "
    texts = [prose(s, 80) for s in range(10)]
    texts += [f"{prose(s + 50, 20)} {line}{prose(s + 90, 20)}" for s in range(40)]
    texts += [f"{prose(s + 150, 5)} {passage} {prose(s + 190, 5)}" for s in range(30)]
    texts += [texts[2]] * 25 + [edited(texts[3], s, 2) for s in range(20)]
    texts += ["a" * 700, "ab" * 400, "abc " * 200, "a" * 99, "b" * 100, "b" * 100, "b" * 101, "é" * 120, "xé" * 90, None, "", prose(4, 30) + prose(4, 30)]
    return texts


@pytest.mark.parametrize(("group", "share"), [(8192, 2.0), (4, 2.0), (8192, 1e-3), (8192, 0.02), (8192, 0.0), (4, 0.01)])
def test_repeats_equal_brute_force(spark, monkeypatch, group, share):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "SHARE", share)
    monkeypatch.setattr(suffix, "CHUNK", 512)
    monkeypatch.setattr(suffix, "SORTED", 5000)
    rows = list(enumerate(repeated_texts()))
    df = clashing(documents(spark, [*rows, (2, rows[2][1])]))
    got = suffix.repeats_digest(df).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows) + 1
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got)
    cleaned = suffix.without_repeats(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows) + 1
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert left[9] == rows[9][1] and not left[60 + 25] and left[len(rows) - 3] is None
    assert suffix.repeats_digest(df.limit(0)).count() == 0


def test_common_anchors(spark, monkeypatch):
    """All of at least the share, none below half of it."""
    texts = [t or "" for t in repeated_texts()]
    anchors, n = np.unique(suffix.rows_of([t.encode() for t in texts])["anchor"].view(np.int64), return_counts=True)
    long = documents(spark, texts, parts=7).selectExpr("doc_id AS doc", "text").where("octet_length(text) >= 100")
    for share in (0.003, 0.01, 0.05):
        monkeypatch.setattr(suffix, "SHARE", share)
        found = set(suffix.common_anchors(long).tolist())
        assert set(anchors[n >= share * n.sum()].tolist()) <= found <= set(anchors[n >= share / 2 * n.sum()].tolist())
    assert len(suffix.common_anchors(long.limit(0))) == 0


# ------------------------------------------------------------------ nearest neighbours


def brute_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        s = x @ v
        o = np.lexsort((ids, -s))
        out[int(i)] = [int(ids[j]) for j in o if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.7 * rng.normal(size=(1500, 24))) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = ann.valid(clashing(df))
    out = ann.search(ann.index(v, shard_size=600), v.where("vec_id % 20 = 0"), block=30).collect()
    want, got = brute_nearest(rows, 20), {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        a, b = (np.array(rows[i][1], np.float32).astype(np.float64) for i in (r["query_id"], r["vec_id"]))
        assert abs(r["score"] - a @ b) < 1e-9
    assert set(got) == set(range(0, 1500, 20)) and all(len(g) == 20 for g in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in got]) >= 0.9


def test_recall_beside_a_tight_cluster(spark):
    """A third of all vectors lie close together, so their nodes get more edges back than one pruning looks at; several vectors of one id."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    x = np.concatenate([centre + 0.02 * rng.normal(size=(1200, 24)), rng.normal(size=(2400, 24))])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (3, rows[900][1]), (3, rows[3][1])], "vec_id long, embedding array<float>")
    rows[3] = (3, min(rows[3][1], rows[900][1]))
    v = ann.valid(df)
    out = ann.search(ann.index(v, shard_size=2000), v.where("vec_id % 20 = 0")).collect()
    want = brute_nearest(rows, 20)
    found = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(found) == 180
    assert np.mean([len(found[q] & set(want[q])) / 20 for q in found]) >= 0.9


def test_few_vectors_ties_and_odd_ones(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), *((i, [0.5, 0.5]) for i in range(1, 15)), (40, [0.0, 0.0]), (60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = ann.valid(df)
    out = ann.search(ann.index(v, 5), v.where("vec_id % 20 = 0"), 5).collect()
    found = {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in out}}
    assert found == {0: [20, 1, 2, 3, 4], 20: [0, 1, 2, 3, 4]}
    none = ann.valid(df.limit(0))
    assert ann.search(ann.index(none), none).count() == 0
