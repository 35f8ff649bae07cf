"""Filtered dense, sparse and hybrid top-k search, score fusion, text dedup, reranking, top-n.

Queries and facts meet by an equi-join on the filter keys (or on shared tokens), so the search is
one plan for all queries; the ranking keeps k rows a query in each task before the shuffle.
Ties go to the smaller node id. Without filter keys every query meets every fact, which is what an
exact search is; give keys, or use an index, where facts are many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.backends import Containment, Reranker
from veriloom.functions.columns import cosine, text_match
from veriloom.functions.session import checkpointed, small_batches

OPERATORS = {"==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v), "text_match": lambda c, v: text_match(c, F.lit(v))}


def condition(field: str, op: str, value) -> Column:
    """One metadata filter; a null field never passes."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(OPERATORS[op](F.col(field), value), F.lit(False))


def build_filter(must=(), should=(), must_not=(), min_should: int | None = None, min_of=()) -> Column:
    """AND of must, OR of should (if any), at least min_should of min_of, AND NOT of must_not; each a list of (field, operator, value)."""
    parts = [condition(*c) for c in must] + [~condition(*c) for c in must_not]
    if min_of:
        parts.append(reduce(lambda a, b: a + b, (condition(*c).cast("int") for c in min_of)) >= (1 if min_should is None else min_should))
    if should:
        parts.append(reduce(lambda a, b: a | b, (condition(*c) for c in should)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def merge_filters(*filters: dict) -> dict:
    """Concatenates the lists of several filters; of min_should the largest counts."""
    out = {k: [c for f in filters for c in f.get(k, ())] for k in ("must", "should", "must_not", "min_of")}
    least = [f["min_should"] for f in filters if f.get("min_should") is not None]
    return out | ({"min_should": max(least)} if least else {})


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, node: str = "node_id", score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best rows of each group; null scores count as 0."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(node).asc())
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def dense_search(queries: DataFrame, facts: DataFrame, k: int, keys: list[str] = (), where: Column | None = None) -> DataFrame:
    """query_id, node_id, score, rank. queries: query_id, q, keys; facts: node_id, v, keys. Filters come before the ranking.

    Without keys every query meets every fact: scan() does that in blocks of queries."""
    found = facts.where(where) if where is not None else facts
    if not keys:
        return scan(queries, found, k)
    pairs = queries.select("query_id", "q", *keys).join(found.select("node_id", "v", *keys), list(keys))
    scored = pairs.select("query_id", "node_id", cosine("q", "v").alias("score")).where(F.col("score").isNotNull())
    return top_k(scored, k)


def sparse_search(queries: DataFrame, postings: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """Inner product over shared tokens. queries: query_id, token, weight; postings: node_id, token, weight."""
    q = queries.select("query_id", "token", F.col("weight").alias("qw"), *keys)
    pairs = q.join(postings.select("node_id", "token", F.col("weight").alias("dw"), *keys), ["token", *keys])
    return top_k(pairs.groupBy("query_id", "node_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("score")), k)


#: Queries of a block: their vectors travel to every task.
SCAN_BLOCK = 8_192


def scan(queries: DataFrame, facts: DataFrame, k: int, similarity: str = "cosine", block: int = SCAN_BLOCK) -> DataFrame:
    """The k best facts of every query, exactly, where no key narrows them: query_id, node_id, score, rank.

    Facts stay where they lie. A block of at most `block` queries is broadcast, each task multiplies its batches with it
    and keeps k facts a query, and only these are ranked. similarity: 'cosine', or 'positive', the inner product of
    positive components, as the join of vector_postings() gives it. Vectors are of one length; zero ones have no cosine."""
    return scans(queries, facts, k, {"": similarity}, block).drop("source")


def scans(queries: DataFrame, facts: DataFrame, k: int, similarities: dict[str, str], block: int = SCAN_BLOCK) -> DataFrame:
    """scan() by several similarities in one pass over the facts: query_id, source, node_id, score, rank. similarities: by source."""
    small_batches(facts.sparkSession)
    ids = {f.name: f.dataType.simpleString() for f in queries.select("query_id").schema} | {f.name: f.dataType.simpleString() for f in facts.select("node_id").schema}
    ddl = f"query_id {ids['query_id']}, source string, node_id {ids['node_id']}, score double"
    asked, facts = queries.select("query_id", "q").where("q is not null"), facts.select("node_id", "v")
    blocks = max(1, -(-asked.count() // block))
    if blocks > 1:  # or each block would make all vectors again
        asked, facts = checkpointed(asked), checkpointed(facts)
    asked = asked.withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    out = []
    for b in range(blocks):
        rows = asked.where(F.col("__b") == b).orderBy("query_id").collect()  # a block by hash: about `block` rows
        held = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], {s: _matrix([r["q"] for r in rows], kind) for s, kind in similarities.items()}))
        found = facts.mapInPandas(_best_of(held, k, similarities), ddl)  # a filter on v below would make it twice
        out.append(top_k(found, k, ["query_id", "source"]))
    return reduce(DataFrame.unionByName, out)


def _matrix(vectors: list, similarity: str) -> np.ndarray:
    x = np.array([list(v) for v in vectors], float)
    if similarity == "positive" or not len(x):
        return np.maximum(x, 0)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)


#: Scores held at once in a scan.
SCAN_SCORES = 1 << 20


def _best_of(held, k: int, similarities: dict[str, str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked = held.value
        best: dict[str, list[list[tuple]]] = {s: [[] for _ in ids] for s in similarities}  # (-score, node) of each query, at most k
        least = {s: np.full(len(ids), -np.inf) for s in similarities}  # the k-th score so far
        step = max(1, min(1024, SCAN_SCORES // max(1, len(ids))))
        for frame in frames if len(ids) else ():
            frame = frame[frame["v"].notna()]
            nodes, vectors = frame["node_id"].to_numpy(), list(frame["v"])
            for a in range(0, len(nodes), step):
                some = nodes[a : a + step]
                for source, similarity in similarities.items():
                    scores = asked[source] @ _matrix(vectors[a : a + step], similarity).T
                    scores[np.isnan(scores) | ((scores <= 0) if similarity == "positive" else False)] = -np.inf
                    top = np.partition(scores, -min(k, len(some)), axis=1)[:, -min(k, len(some))]
                    may = (scores >= np.maximum(top, least[source])[:, None]) & (scores > -np.inf)  # all that tie with the k-th may count
                    for i in np.flatnonzero(may.any(axis=1)).tolist():
                        at = np.flatnonzero(may[i])
                        found = best[source][i] = sorted([*best[source][i], *zip((-scores[i, at]).tolist(), some[at].tolist(), strict=True)])[:k]
                        if len(found) == k:
                            least[source][i] = -found[-1][0]
        flat = [(ids[i], source, node, -s) for source, lists in best.items() for i, b in enumerate(lists) for s, node in b]
        yield pd.DataFrame(flat, columns=["query_id", "source", "node_id", "score"])

    return run


def vector_postings(df: DataFrame, node: str, vector: str, keys: list[str] = ()) -> DataFrame:
    """Positive components of a vector as token weights, as a sparse head with a rectifier gives them."""
    return df.select(F.col(node), *keys, F.posexplode(vector).alias("token", "w")).where("w > 0").select(node, *keys, "token", F.col("w").cast("double").alias("weight"))


# fusion: every function takes rows (query_id, source, node_id, score) and gives (query_id, node_id, score, rank)


def simple_fusion(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row a text with its best score; the first node keeps its id."""
    best = rows.groupBy("query_id", text).agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.min("node_id").alias("node_id"))
    return top_k(best, 1 << 30)


def relative_score_fusion(rows: DataFrame, weights: dict[str, float] | None = None, distribution: bool = False) -> DataFrame:
    """Scores of each list scaled by its range (or mean and three deviations), weighted, summed by node, divided by the lists."""
    own = Window.partitionBy("query_id", "source")
    s = F.coalesce(F.col("score"), F.lit(0.0))
    if distribution:
        mean, spread = F.avg(s).over(own), F.stddev_pop(s).over(own)
        low, high = mean - 3 * spread, mean + 3 * spread
    else:
        low, high = F.min(s).over(own), F.max(s).over(own)
    bounded = rows.select("query_id", "source", "node_id", s.alias("s"), low.alias("low"), high.alias("high"))
    flat = F.when(F.col("high") > 0, 1.0).otherwise(0.0)
    scaled = F.when(F.col("high") == F.col("low"), flat).otherwise((F.col("s") - F.col("low")) / (F.col("high") - F.col("low")))
    if weights:
        total = sum(weights.values())
        table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, v / total)))
        scaled = scaled * F.coalesce(table[F.col("source")], F.lit(0.0))
    lists = F.size(F.collect_set("source").over(Window.partitionBy("query_id")))
    summed = bounded.select("query_id", "source", "node_id", scaled.alias("x"), lists.alias("lists")).groupBy("query_id", "node_id").agg((F.sum("x") / F.max("lists")).alias("score"))
    return top_k(summed, 1 << 30)


def distribution_based_score_fusion(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return relative_score_fusion(rows, weights, distribution=True)


def reciprocal_rank_fusion(rows: DataFrame, k: float = 60.0) -> DataFrame:
    """Sum of 1 / (rank + k), ranks from 0 within each list."""
    place = Window.partitionBy("query_id", "source").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "node_id")
    ranked = rows.withColumn("r", F.row_number().over(place) - 1)
    return top_k(ranked.groupBy("query_id", "node_id").agg(F.sum(1.0 / (F.col("r") + k)).alias("score")), 1 << 30)


FUSIONS = {"simple": simple_fusion, "relative": relative_score_fusion, "distribution": distribution_based_score_fusion, "reciprocal": reciprocal_rank_fusion}


def fuse(rows: DataFrame, method: str = "distribution") -> DataFrame:
    """Fuses queries with two lists or more; a query with one list keeps its scores."""
    lists = F.size(F.collect_set("source").over(Window.partitionBy("query_id")))
    marked = rows.withColumn("__lists", lists)
    several = FUSIONS[method](marked.where("__lists > 1").drop("__lists")).select("query_id", "node_id", "score", "rank")
    single = top_k(marked.where("__lists = 1"), 1 << 30).select("query_id", "node_id", "score", "rank")
    return several.unionByName(single)


def provenance(rows: DataFrame, fused: DataFrame) -> DataFrame:
    """The fused rows with each source's own score beside them, that score scaled by its list's range, and the fused one by its name."""
    own = Window.partitionBy("query_id", "source")
    s, low, high = F.coalesce(F.col("score"), F.lit(0.0)), F.min(F.coalesce("score", F.lit(0.0))).over(own), F.max(F.coalesce("score", F.lit(0.0))).over(own)
    scaled = rows.withColumn("scaled", F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((s - low) / (high - low)))
    wide = scaled.groupBy("query_id", "node_id").pivot("source", ["dense", "sparse"]).agg(F.max("score").alias("score"), F.max("scaled").alias("normalized_score"))
    return fused.withColumn("fusion_score", F.col("score")).join(wide, ["query_id", "node_id"], "left")


def dedup_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """The best row of each text within a query."""
    best = Window.partitionBy("query_id", text).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "node_id")
    return rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def rerank(rows: DataFrame, top_n: int, backend: Reranker | None = None, query: str = "query", text: str = "text", truncation: str = "rerank") -> DataFrame:
    """New scores by a model of (query, text). truncation: 'rerank' cuts by the new scores, 'fusion' by the old ones."""
    model = backend or Containment()
    small_batches(rows.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(model.score(q.tolist(), t.tolist()))

    new = rows.withColumn("rerank_score", scored(query, text))
    if truncation == "fusion":
        new = top_k(new, top_n)
        return top_k(new.withColumn("score", F.col("rerank_score")), top_n)
    return top_k(new.withColumn("score", F.col("rerank_score")), top_n)


#: What each source scans by where there are no keys.
SIMILARITIES = {"dense": "cosine", "sparse": "positive"}
#: How each method searches and whether it reranks.
PRESETS = {"dense": (("dense",), False), "sparse": (("sparse",), False), "hybrid": (("dense", "sparse"), False), "rerank": (("dense", "sparse"), True)}


def searched(queries: DataFrame, facts: DataFrame, sources: list[str], k: int, keys: list[str] = ()) -> DataFrame:
    """query_id, source, node_id, score, rank: the k best facts by each source, 'dense' or 'sparse'. Without keys one pass over the facts serves all sources."""
    if not keys:
        return scans(queries, facts, k, {s: SIMILARITIES[s] for s in sources})
    found = []
    for s in sources:
        if s == "dense":
            rows = dense_search(queries, facts, k, keys)
        else:
            rows = sparse_search(vector_postings(queries, "query_id", "q", keys), vector_postings(facts, "node_id", "v", keys), k, keys)
        found.append(rows.select("query_id", F.lit(s).alias("source"), "node_id", "score", "rank"))
    return reduce(DataFrame.unionByName, found)


#: Ids of found facts that are broadcast at most.
FOUND_IDS = 200_000


def facts_of(found: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """node_id and columns of the facts that were found. The others stay where they lie, unless more than FOUND_IDS were found. found is read twice."""
    ids = found.select("node_id").distinct()
    few = ids.limit(FOUND_IDS + 1).count() <= FOUND_IDS
    return facts.select("node_id", *columns).join(F.broadcast(ids) if few else ids, "node_id", "left_semi")


def retrieve(queries: DataFrame, facts: DataFrame, method: str = "hybrid", top_n: int = 10, keys: list[str] = (), fusion: str = "distribution", dedup: bool = False, backend: Reranker | None = None) -> DataFrame:
    """The whole retrieval. queries: query_id, q (and query for reranking), keys; facts: node_id, v, text, keys."""
    sources, again = PRESETS[method]
    found = searched(queries, facts, list(sources), top_n, keys).select("query_id", "source", "node_id", "score")
    if dedup or again:  # only the texts that were found
        found = checkpointed(found)
        out = fuse(found, fusion).join(facts_of(found, facts, "text"), "node_id")
    else:
        out = fuse(found, fusion)
    if dedup:
        out = dedup_text(out)
    if again:
        out = rerank(out.join(queries.select("query_id", "query"), "query_id"), top_n, backend)
    return top_k(out, top_n)


def mean_dense(df: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """Component means, as an array."""
    parts = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))


def mean_sparse(df: DataFrame, by: list[str], weights: str = "weights") -> DataFrame:
    """Means over the maps that have the token."""
    return df.select(*by, F.explode(weights).alias("token", "w")).groupBy(*by, "token").agg(F.avg("w").alias("mean"))
