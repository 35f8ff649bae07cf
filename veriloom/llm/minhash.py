"""Near-duplicate documents by circulant MinHash, confirmed by exact Jaccard similarity.

A document's set is that of its five-word shingles, as 64-bit hashes. Its signature needs two
permutations of a fixed universe: one scatters the shingles, the other, shifted circularly by
k places, gives coordinate k. Bands of coordinates are hashed to buckets.

Documents with equal sets are one class, named by its least id. In each bucket every class is
paired with the least (pairs as many as members, not their square); signatures that agree far
too little are let go, the rest is confirmed on the full sets, and links make components. Only
buckets whose members still lie in several components are looked at again, in blocks, each pair in
the first bucket it shares: members with a partner in another component whose signature agrees enough
come together once more with their sets, and what links components is confirmed on the spot, so only
the links travel on. So no pair that shares
a bucket is lost unless its ends are already connected. The chance that a pair at the threshold
shares no bucket is (1 - t**ROWS)**BANDS, below 1e-5, and that its signatures agree in fewer than
LEAST coordinates is about as small.

Defined results: words are runs of bytes other than ASCII white space, after lower-casing A-Z; fewer
words than five are one shingle; null and empty texts have an empty set and no links; rows of one id
are one document for links and each gets a row; a null id is linked with nothing but equal sets; empty tables give no rows; other columns are not
looked at. Memory: a batch of texts, or the pairs of one hub a few at a time.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import Remembered, arrow_map, arrow_schema, checkpointed, compact, small_batches, tools
from veriloom.llm.components import components

WORDS, PERCENT = 5, 75
#: Bands of so many coordinates; universe of the permutations; fewest equal coordinates of a pair worth confirming.
BANDS, ROWS, UNIVERSE = 32, 4, 1 << 20
LENGTH = BANDS * ROWS
LEAST = int(LENGTH * (PERCENT / 100) - 5.5 * (LENGTH * 0.75 * 0.25) ** 0.5)
#: Members of a block; bytes of words remembered.
BLOCK, CACHE = 1024, 64 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    def __init__(self):
        self.known: dict[bytes, int] = Remembered(CACHE)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        known.trim()
        new = [w for w in set(words) if w not in known]
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
        known.told(new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < WORDS:
            return _mixed((h * _ODD[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
        n = len(h) - WORDS + 1
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s += h[k : k + n] * _ODD[k]
        return np.unique(_mixed(s))


class Circulant:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(UNIVERSE).astype(np.int32)
        order = rng.permutation(UNIVERSE).astype(np.int32)
        self.shifted = sliding_window_view(np.concatenate([order, order[:LENGTH]]), LENGTH)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles >> np.uint64(44)).astype(np.int64)]
        out = np.full(LENGTH, UNIVERSE, np.int32)
        for i in range(0, len(at), 2048):
            np.minimum(out, self.shifted[at[i : i + 2048]].min(axis=0), out=out)
        return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mixed(h * _ODD[k] + rows[:, k])
    return h.view(np.int64)


def _tools() -> tuple[Shingler, Circulant]:
    return tools("minhash", lambda: (Shingler(), Circulant()))


SKETCH = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, digest of the set, low bytes of the signature, and band hashes of every row."""
    small_batches(docs.sparkSession)

    def rows(batch):
        shingler, circulant = _tools()
        out = {c.split()[0]: [] for c in SKETCH.split(", ")}
        for doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingler.shingles(t)
            digest = signature = bands = None
            if len(s):
                full = circulant.signature(s)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                signature, bands = full.astype(np.uint8).tobytes(), bands_of(full)
            for k, v in zip(out, (doc, len(s), digest, signature, bands), strict=True):
                out[k].append(v)
        return out

    return arrow_map(docs.select(key, text), rows, arrow_schema(SKETCH), SKETCH)


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node and the shingle set of the classes named in wanted (node, set_key)."""
    found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(wanted.select(F.col("node").alias("doc_id"), "set_key"), "doc_id")
    ddl = "node long, set_key binary, shingles binary"

    def rows(batch):
        shingler, _ = _tools()
        out = {"node": [], "set_key": [], "shingles": []}
        for doc, t, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "set_key")), strict=True):
            raw = shingler.shingles(t).tobytes()
            if hashlib.blake2b(raw, digest_size=16).digest() == digest:  # an id may come with several texts
                for k, v in zip(out, (doc, digest, raw), strict=True):
                    out[k].append(v)
        return out

    return checkpointed(arrow_map(found, rows, arrow_schema(ddl), ddl).dropDuplicates(["node", "set_key"]).select("node", "shingles"))


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, of sorted sets."""
    a, b = len(one), len(other)
    if 100 * min(a, b) < PERCENT * max(a, b):
        return False
    small, large = (one, other) if a < b else (other, one)
    i = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[i] == small).sum())
    return 100 * both >= PERCENT * (a + b - both)


def _agree(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough and whose sizes allow a link."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("signature").alias(f"{x}_s"), F.col("n_shingles").alias(f"{x}_n"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    fit = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * PERCENT
    ddl = "a long, b long"

    def near(batch):
        a, b, s, t = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "a_s", "b_s"))
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, LENGTH) for v in (s, t))
        ok = (x == y).sum(axis=1) >= LEAST
        return {"a": a.to_numpy()[ok], "b": b.to_numpy()[ok]}

    return arrow_map(rows.where(fit).select("a", "b", "a_s", "b_s"), near, arrow_schema(ddl), ddl)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) linked by their full sets. A hub's pairs lie together, and its set is read once for each run of them."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    rows = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")
    ddl = "a long, b long"

    def exact(batch):
        out = {"a": [], "b": []}
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return arrow_map(rows, exact, arrow_schema(ddl), ddl)


def _dealt(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members of buckets (band, node, component) dealt out by pairs of blocks of about BLOCK members, with what payload has
    of each node, sorted so that each pair of blocks comes in one run. The largest component of a bucket has blocks of its
    own, below 0, which don't meet each other: all their members are connected. Blocks go by hash, from counts, so no
    bucket is ranked in one task, and places are found before the payload joins."""
    counts = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("of_major"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = counts.select("band", "major", blocks(F.col("of_major")).alias("majors"), blocks(F.col("all") - F.col("of_major")).alias("minors"))
    counts = compact(checkpointed(counts))  # a side of its own, so that Spark can split a bucket with many members in the join
    placed = members.join(counts, "band").withColumn("h", F.xxhash64("node", "band"))
    placed = placed.withColumn("block", F.when(F.col("component") == F.col("major"), -1 - F.pmod("h", F.col("majors"))).otherwise(F.pmod("h", F.greatest("minors", F.lit(1)))).cast("int"))
    others = F.sequence(F.when(F.col("block") < 0, 0).otherwise(-F.col("majors")), F.col("minors") - 1)
    dealt = placed.where("minors > 0").withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.select("band", "node", "component", "block", "i", "j")
    return dealt.join(payload, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "node")


class _Group:
    """Members of two blocks of a bucket."""

    def __init__(self, rows: list[dict]):
        self.band, self.cross = rows[0]["band"], rows[0]["i"] != rows[0]["j"]
        self.node, self.component, self.size, self.block = (np.array([r[k] for r in rows], np.int64) for k in ("node", "component", "n_shingles", "block"))
        self.signature = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint8).reshape(-1, LENGTH)
        self.bands = np.array([r["bands"] for r in rows], np.int64)  # upper halves: enough to tell a band's hashes apart
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows] if "shingles" in rows[0] else []

    def worth(self, r: int) -> np.ndarray:
        """Later members of other components that may be linked with member r, and share no earlier band with it."""
        later = slice(r + 1, None)
        ok = (self.component[later] != self.component[r]) & (100 * np.minimum(self.size[later], self.size[r]) >= PERCENT * np.maximum(self.size[later], self.size[r]))
        if self.cross:
            ok &= self.block[later] != self.block[r]
        at = np.flatnonzero(ok) + r + 1
        at = at[(self.signature[at] == self.signature[r]).sum(axis=1) >= LEAST]
        here = int((self.bands[r] == self.band >> 32).argmax())
        return at[(self.bands[at] == self.bands[r]).argmax(axis=1) == here]


def _by_group(members: DataFrame, payload: DataFrame, of: Callable[[_Group], tuple[np.ndarray, np.ndarray]], names: tuple[str, str]) -> DataFrame:
    """Two columns of ids from each pair of blocks."""
    ddl = ", ".join(f"{n} long" for n in names)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def done():
            if len(rows) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in of(_Group(rows))], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if rows and (row["band"], row["i"], row["j"]) != (rows[0]["band"], rows[0]["i"], rows[0]["j"]):
                    yield from done()
                    rows = []
                rows.append(row)
        yield from done()

    return _dealt(members, payload).mapInArrow(run, ddl)


def _open_members(group: _Group) -> tuple[np.ndarray, np.ndarray]:
    """(band, node) of the members that have a partner worth confirming in this bucket."""
    some = np.zeros(len(group.node), bool)
    for r in range(len(group.node)):
        at = group.worth(r)
        some[at] = True
        some[r] |= len(at) > 0
    return np.full(int(some.sum()), group.band), group.node[some]


def _links(group: _Group) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components that confirmed links join, as few as joining takes."""
    root, a, b = {int(c): int(c) for c in group.component}, [], []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for r in range(len(group.node)):
        for t in group.worth(r).tolist():
            x, y = find(int(group.component[r])), find(int(group.component[t]))
            if x != y and linked(group.sets[r], group.sets[t]):
                root[max(x, y)] = min(x, y)
                a.append(group.component[r])
                b.append(group.component[t])
    return np.array(a, np.int64), np.array(b, np.int64)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set), component_id and kept, a row for every row of docs."""
    rows = checkpointed(sketches(docs, key, text))
    equal = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    of_class = F.min_by(F.struct("n_shingles", "signature", "bands"), "doc_id").alias("c")  # combined before the shuffle: a class of any size is a row for each task
    classes = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), of_class).select("node", "set_key", "c.*")
    exploded = classes.select("node", F.explode("bands").alias("band"))
    hubs = exploded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = checkpointed(exploded.join(hubs, "band"))
    light = checkpointed(classes.join(buckets.select("node").distinct(), "node", "left_semi"))

    star = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = compact(checkpointed(_agree(star, light)))
    named = star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct()
    sets = _sets(docs, light.join(named, "node", "left_semi"), key, text)
    links = compact(checkpointed(_confirmed(star, sets)))
    labels = components(links)

    placed = buckets.where("members > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    members = compact(checkpointed(placed.join(open_, "band", "left_semi").select("band", "node", "component")))  # apart from the join's partitions by band, so that counts combine before their shuffle
    payload = light.select("node", "n_shingles", "signature", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands"))
    left = compact(checkpointed(_by_group(members, payload, _open_members, ("band", "node")).distinct()))
    if left.limit(1).count():
        lacking = left.select("node").distinct().join(sets, "node", "left_anti")
        if lacking.limit(1).count():
            sets = sets.unionByName(_sets(docs, light.join(lacking, "node", "left_semi"), key, text))
        found = checkpointed(_by_group(members.join(left, ["band", "node"], "left_semi"), payload.join(sets, "node"), _links, ("a", "b")))
        if found.limit(1).count():
            labels = _joined(labels, components(found))
    return _labelled(rows, equal, labels)


def _joined(labels: DataFrame, above: DataFrame) -> DataFrame:
    """Labels after components were joined; above: components (node) and what they became. A component of one node has no label yet."""
    alone = above.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    became = above.select(F.col("node").alias("component"), F.col("component").alias("became"))
    return labels.unionByName(alone).join(became, "component", "left").select("node", F.coalesce("became", "component").alias("component"))


def _labelled(rows: DataFrame, equal: DataFrame, labels: DataFrame) -> DataFrame:
    several = compact(checkpointed(equal.where("n > 1").select("set_key", "node")))  # a side of its own, so that the join can be split
    out = rows.select("doc_id", "n_shingles", "set_key").join(several, "set_key", "left").withColumn("class_id", F.coalesce("node", "doc_id")).drop("node")
    out = out.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


assert sys.byteorder == "little"  # sets are compared as bytes written by the same kind of machine
