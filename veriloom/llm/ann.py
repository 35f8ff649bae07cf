"""Nearest neighbours by inner product on robust-pruned directed graphs, one graph a shard.

Equal vectors are one node, with their least ids (one more than the neighbours asked for is all
that can matter). Vectors are dealt to shards by hash, as many shards as their count needs at
SHARD nodes each. In a shard, inner products become distances by one more coordinate that makes
all lengths equal. The graph grows in batches: a greedy beam search from the entry points proposes
neighbours of each new node, and relaxed pruning keeps a neighbour only if no kept one is closer to
it by the factor ALPHA; the edges back are pruned alike, BACK at a time until all have been seen;
a node that no edge leads to gets one more edge from a neighbour of its own.
Queries are searched by beam in each shard: a shard is followed by its queries in one sorted stream,
so it crosses the network once for each BLOCK of queries, and what is found is merged. Scores are
taken anew in double precision on the original vectors.

Defined results: vectors that are null, empty, all zeros or hold null or non-finite components take
no part; vectors of different lengths never meet; rows that repeat an id count once, with the least
vector; ties go to the smaller id; fewer candidates give fewer rows; an empty table gives none; other
columns are not looked at. Memory: a shard of SHARD nodes and a batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import checkpointed, small_batches

#: Nodes of a shard, about; queries that follow one copy of a shard.
SHARD, BLOCK = 12_288, 1 << 18
#: Edges of a node, beam when building and when searching, nodes expanded at a step, relaxation, entry points.
DEGREE, BUILD_BEAM, BEAM, STEP, ALPHA, ENTRIES = 32, 48, 192, 4, 1.2, 16
BATCH, FIRST = 512, 128
#: Edges back that a node's pruning looks at beside those it has.
BACK = 64


def spread_evenly(n: int, k: int) -> np.ndarray:
    return np.unique(np.arange(min(n, k)) * n // min(n, k))


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (negative inner products, or whatever -x.q orders) of the beams, nearest first; -1 where there is none."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no edge"
    seen[:, entries] = True
    ids = np.full((b, beam), n, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    k = min(beam, len(entries))
    first = -(q @ x[entries].T)
    order = np.argsort(first, axis=1, kind="stable")[:, :k]
    ids[:, :k], dist[:, :k] = entries[order], np.take_along_axis(first, order, 1)
    done = ids == n
    rows = np.arange(b)
    while len(rows):
        r_ids, r_dist, r_done = ids[rows], dist[rows], done[rows]
        pick = np.argsort(r_done, axis=1, kind="stable")[:, :STEP]  # beams are sorted: the first open ones are the nearest
        fresh = ~np.take_along_axis(r_done, pick, 1)
        np.put_along_axis(r_done, pick, True, 1)
        near = np.where(fresh, np.take_along_axis(r_ids, pick, 1), n)
        found = graph[near].reshape(len(rows), -1)
        new = ~seen[rows[:, None], found]
        # the same node may come from two expanded ones: keep its first place
        by = np.argsort(found, axis=1, kind="stable")
        same = np.zeros_like(new)
        srt = np.take_along_axis(found, by, 1)
        np.put_along_axis(same, by, np.concatenate([np.zeros((len(rows), 1), bool), srt[:, 1:] == srt[:, :-1]], axis=1), 1)
        new &= ~same
        seen[rows[:, None], found] = True
        at = np.nonzero(new)
        d = np.full(found.shape, np.inf, np.float32)
        d[at] = -np.einsum("ij,ij->i", q[rows[at[0]]], x[found[at]])
        all_ids = np.concatenate([r_ids, np.where(new, found, n)], axis=1)
        all_dist = np.concatenate([r_dist, d], axis=1)
        all_done = np.concatenate([r_done, ~new], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, order, 1)
        dist[rows] = np.take_along_axis(all_dist, order, 1)
        done[rows] = np.take_along_axis(all_done, order, 1)
        rows = rows[~done[rows].all(axis=1)]
    return np.where(ids == n, -1, ids), dist


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning for many points at once. candidates: -1 or the point itself where there is none. Squared distances."""
    b, m = candidates.shape
    c = np.where(candidates < 0, points[:, None], candidates)
    xc = x[c]
    d = ((xc - x[points][:, None, :]) ** 2).sum(axis=2)
    alive = c != points[:, None]
    order = np.argsort(np.where(alive, d, np.inf), axis=1, kind="stable")
    c, d, alive = (np.take_along_axis(v, order, 1) for v in (c, d, alive))
    alive[:, 1:] &= c[:, 1:] != c[:, :-1]
    xc = x[c]
    sq = (xc**2).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(xc, xc.transpose(0, 2, 1))
    kept = np.full((b, degree), -1, np.int32)
    rows = np.arange(b)
    for k in range(degree):
        if not alive.any():
            break
        i = alive.argmax(axis=1)
        some = alive[rows, i]
        kept[:, k] = np.where(some, c[rows, i], -1)
        alive &= ~some[:, None] | (ALPHA * ALPHA * between[rows, i] > d)
        alive[rows, i] = False
    return kept


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Graph (nodes by degree; the number of nodes stands for no edge) and entry points."""
    x = vectors.astype(np.float32)
    n = len(x)
    length = (x.astype(np.float64) ** 2).sum(axis=1)
    x = np.concatenate([x, np.sqrt(np.maximum(length.max() - length, 0))[:, None].astype(np.float32)], axis=1)
    if n <= FIRST:  # all edges
        graph = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return np.concatenate([graph, np.full((1, n), n, np.int32)]), np.array([0])
    graph = np.full((n + 1, DEGREE), n, np.int32)
    order = np.random.default_rng(7).permutation(n)
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.concatenate([[middle], order[order != middle]])

    def join(points: np.ndarray, kept: np.ndarray) -> None:
        graph[points] = np.where(kept < 0, n, kept)
        to, by = kept.ravel(), np.repeat(points, kept.shape[1])
        by, to = by[to >= 0], to[to >= 0]
        o = np.argsort(to, kind="stable")
        by, to = by[o], to[o]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(start, count)
        for low in range(0, int(count.max(initial=0)), BACK):
            some = nodes[count > low]
            back = np.full((len(some), DEGREE + BACK), -1, np.int32)
            back[:, :DEGREE] = np.where(graph[some] == n, -1, graph[some])
            now = (place >= low) & (place < low + BACK)
            back[np.searchsorted(some, to[now]), DEGREE + place[now] - low] = by[now]
            back = back[:, : DEGREE + min(int(count.max()) - low, BACK)]
            for a in range(0, len(some), BATCH):
                part = prune(x, some[a : a + BATCH], back[a : a + BATCH], DEGREE)
                graph[some[a : a + BATCH]] = np.where(part < 0, n, part)

    first = order[:FIRST]
    join(first, prune(x, first, np.tile(first, (FIRST, 1)), DEGREE))
    at = FIRST
    while at < n:
        points = order[at : at + min(BATCH, at)]
        entries = order[spread_evenly(at, ENTRIES)]
        # with the added coordinate all lengths are equal, so inner products order as distances do
        found, _ = beam_search(x, graph, entries, x[points], BUILD_BEAM)
        join(points, prune(x, points, found, DEGREE))
        at += len(points)
    return reachable(graph), order[spread_evenly(n, ENTRIES)]


def reachable(graph: np.ndarray) -> np.ndarray:
    """The graph with more columns, in which every node that no edge leads to gets one from a neighbour of its own, the one that gave the fewest."""
    n = len(graph) - 1
    led = np.zeros(n + 1, bool)
    led[graph[:n]] = True
    given: dict[int, list[int]] = {}
    for v in np.flatnonzero(~led[:n]).tolist():
        by = min((u for u in graph[v].tolist() if u != n), key=lambda u: len(given.get(u, ())), default=None)
        if by is not None:
            given.setdefault(by, []).append(v)
    more = np.full((n + 1, max(map(len, given.values()), default=0)), n, graph.dtype)
    for u, vs in given.items():
        more[u, : len(vs)] = vs
    return np.concatenate([graph, more], axis=1)


INDEX = "dim int, shard int, n int, ids binary, groups binary, vectors binary, graph binary, entries binary"


def valid(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, one row an id."""
    v = F.col(vector).cast("array<float>")
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0)
    return df.where(F.col(key).isNotNull() & sound).groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def index(vectors: DataFrame, neighbours: int = 20, shard_size: int = SHARD) -> DataFrame:
    """One row a shard. vectors: the rows of valid()."""
    keyed = vectors.withColumn("dim", F.size("v"))
    sizes = {r["dim"]: r["n"] for r in keyed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in sizes.items():  # one entry for each length of vectors
        shards = F.when(F.col("dim") == dim, F.lit(-(-n // shard_size))).otherwise(shards)
    least = Window.partitionBy("v").orderBy("vec_id")
    few = keyed.withColumn("shard", F.pmod(F.xxhash64("v"), shards).cast("int")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= neighbours + 1)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        _, first, group = np.unique(raw.view([("", raw.dtype)] * raw.shape[1]).ravel(), return_index=True, return_inverse=True)
        x = raw[first]
        graph, entries = build(x)
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(x), pdf["vec_id"].to_numpy(np.int64).tobytes(), group.astype(np.int32).tobytes(), x.tobytes(), graph.astype(np.int32).tobytes(), entries.astype(np.int32).tobytes())], columns=[c.split()[0] for c in INDEX.split(", ")])

    return few.select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInPandas(make, INDEX)


FOUND = "query_id long, vec_id long, score double"


class Shard:
    """A row of the index, ready for queries."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.x = np.frombuffer(row["vectors"], np.float32).reshape(self.n, -1)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(self.n + 1, -1)
        self.entries, self.ids, group = (np.frombuffer(row[c], t) for c, t in (("entries", np.int32), ("ids", np.int64), ("groups", np.int32)))
        self.by = np.argsort(group, kind="stable")  # ids of a node, ascending
        self.start = np.searchsorted(group[self.by], np.arange(self.n + 1))

    def nearest(self, queries: np.ndarray, q: np.ndarray, neighbours: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of the nearest found."""
        out = []
        for a in range(0, len(q), BATCH):
            near, _ = beam_search(self.x, self.graph, self.entries, q[a : a + BATCH], max(beam, neighbours + 1))
            for query, vector, nodes in zip(queries[a : a + BATCH], q[a : a + BATCH], near, strict=True):
                nodes = nodes[nodes >= 0]
                exact = self.x[nodes].astype(np.float64) @ vector.astype(np.float64)
                members = [self.by[self.start[i] : self.start[i + 1]] for i in nodes]
                who, score = self.ids[np.concatenate(members)], np.repeat(exact, [len(m) for m in members])
                own = who != query
                who, score = who[own], score[own]
                best = np.lexsort((who, -score))[:neighbours]
                out.append((np.full(len(best), query), who[best], score[best]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def search(shards: DataFrame, queries: DataFrame, neighbours: int = 20, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score. queries: rows of valid(); every query against every shard of its length."""
    small_batches(shards.sparkSession)
    shards = checkpointed(shards)
    blocks = max(1, -(-queries.count() // block))
    many = F.lit(0)
    for r in shards.groupBy("dim").agg(F.max("shard").alias("last")).collect():  # one row for each length of vectors
        many = F.when(F.col("dim") == r["dim"], F.lit(r["last"] + 1)).otherwise(many)
    asked = queries.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("many", many).where("many > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).drop("many")
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    stream = held.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    place = ("dim", "shard", "block", "kind")
    stream = stream.repartition("dim", "shard", "block").sortWithinPartitions(*place)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in place], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here, part = tuple(keys[a, :3].tolist()), batch.slice(a, b - a)
                if keys[a, 3] == 0:
                    at, shard = here, Shard(part.slice(0, 1).to_pylist()[0])
                elif at == here:  # else no vector fell to the shard
                    q = np.array(part.column(part.schema.get_field_index("v")).to_pylist(), np.float32)
                    ids = part.column(part.schema.get_field_index("vec_id")).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in shard.nearest(ids, q, neighbours, beam)], names=["query_id", "vec_id", "score"])

    found = stream.mapInArrow(look, FOUND)
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
