import itertools
import random
from collections import Counter

import pytest
from helpers import clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from veriloom.llm import packing  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """Exact, by brute force over placements."""
    for n in itertools.count(packing.lower_bound(Counter(sizes), capacity) if sizes else 0):
        def place(i, rooms):
            if i == len(sizes):
                return True
            return any(place(i + 1, tuple(sorted((*rooms[:k], r - sizes[i], *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= sizes[i] and r not in rooms[:k])

        sizes = sorted(sizes, reverse=True)
        if place(0, (capacity,) * n):
            return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal_on_small_cases(sizes):
    found = packing.bin_completion(Counter(sizes), 20)
    assert all(sum(b) <= 20 for b, _ in found)
    held = Counter(s for b, m in found for _ in range(m) for s in b)
    assert held == Counter(sizes)
    assert sum(m for _, m in found) == fewest(sizes, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=30))
def test_counts_are_kept(counts):
    for found in (packing.bin_completion(counts, 64, 3000), packing.best_fit_decreasing(counts, 64)):
        held = Counter()
        for b, m in found:
            assert sum(b) <= 64
            for s in b:
                held[s] += m
        assert held == counts


def fits_into(a, b):
    """The lengths of a, each in one of b, several in one allowed."""
    if not a:
        return True
    return any(r >= a[0] and fits_into(a[1:], (*b[:i], r - a[0], *b[i + 1 :])) for i, r in enumerate(b))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=7), st.integers(0, 20))
def test_fillings_are_the_undominated_ones(sizes, room):
    feasible = {tuple(sorted(c, reverse=True)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room}
    undominated = {a for a in feasible if not any(a != b and fits_into(a, b) for b in feasible)}
    found = list(packing.fillings(Counter(sizes), room))
    assert len(found) == len(set(found)) and set(found) == undominated
    assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)
    assert list(packing.fillings(Counter(sizes), room, 2)) == [f for f in found if room - sum(f) <= 2]


def hard(capacity, bins, seed):
    """Threes that fill a bin each, so the bound is met, and best fit misses it by much."""
    rng, out = random.Random(seed), []
    for _ in range(bins):
        a = rng.randrange(capacity // 4 + 1, capacity // 2 - 2)
        b = rng.randrange(capacity // 4 + 1, min(capacity // 2, capacity - a - capacity // 4))
        out += [a, b, capacity - a - b]
    return Counter(out)


@pytest.mark.parametrize(("capacity", "bins", "seed"), [(30, 10, 1), (50, 12, 2), (60, 15, 3), (100, 12, 4), (200, 20, 7)])
def test_search_betters_best_fit(capacity, bins, seed):
    counts = hard(capacity, bins, seed)
    first = sum(m for _, m in packing.best_fit_decreasing(counts, capacity))
    found = packing.bin_completion(counts, capacity)
    assert sum(m for _, m in found) == bins < first
    assert sum((Counter({s: k * m for s, k in Counter(b).items()}) for b, m in found), Counter()) == counts


def test_multiplicities_are_taken_back():
    """Each filling as often as it fits is not best here: some bins need the lengths of another filling."""
    for seed in range(40):
        rng = random.Random(seed)
        counts = Counter({s: rng.randrange(1, 5) for s in rng.sample(range(2, 16), 4)})
        assert sum(m for _, m in packing.bin_completion(counts, 20)) == fewest(list(counts.elements()), 20)


def test_packed_rows(spark):
    texts = ["word " * n for n in (0, 1, 5, 30, 64, 70, 200)] + [None] + ["word " * 20] * 40
    df = clashing(documents(spark, texts))
    rows = packing.pack(packing.pieces(df, PATH, capacity=64, keep_ids=True), capacity=64, buckets=4)
    out = rows.collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    coder = packing.coder(PATH)
    for i, t in enumerate(texts):
        ids = coder.encode([t or ""])[0] + b"\0\0\0\0"
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(bytes(p["ids"]) for p in parts) == ids
        assert [p["start"] for p in parts] == list(range(0, len(ids) // 4, 64))
        assert all(p["length"] == 64 for p in parts[:-1])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert len(by_sequence) == packing.lower_bound(Counter(r["length"] for r in out), 64)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(rows).collect()}
    assert all(whole[s] == b"".join(bytes(p["ids"]) for p in sorted(parts, key=lambda r: r["offset"])) for s, parts in by_sequence.items())
    assert packing.pack(packing.pieces(df.limit(0), PATH)).count() == 0


def test_repeated_rows(spark):
    df = documents(spark, [(1, "a b"), (1, "a b"), (None, "a"), (None, None)])
    out = packing.pack(packing.pieces(df, PATH)).collect()
    assert len(out) == 4 and len({(r["sequence_id"], r["offset"]) for r in out}) == 4
