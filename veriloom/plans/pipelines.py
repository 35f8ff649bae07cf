"""Whole runs: ingest of documents, evaluation over a grid of settings with resume, agreement of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.backends import ClaimFinder, Embedder, Judge
from veriloom.functions.columns import config_string, content_uuid, sentences
from veriloom.functions.session import checkpointed
from veriloom.operators import agreement, context, decompose, retrieval, stats
from veriloom.sources.tables import not_yet_done, upsert

NODE = ("node_id", "node_kind", "source_document_id", "parent_chunk_id", "node_monotonic_idx", "text")


def build_nodes(docs: DataFrame, key: str, text: str, known: DataFrame | None = None, most: int = 128, embedder: Embedder | None = None, finder: ClaimFinder | None = None) -> DataFrame:
    """Chunks of new documents, and the sentences and claims of each chunk, as nodes of three kinds with embeddings.

    known: nodes of earlier runs; documents that have some are skipped.
    """
    new = docs if known is None else docs.join(known.select(F.col("source_document_id").alias(key)).distinct(), key, "left_anti")
    chunks = decompose.semantic_chunks(new, key, text, most, embedder).select(F.col("doc").alias("source_document_id"), F.col("chunk").alias("node_monotonic_idx"), F.col("chunk_text").alias("text"))
    chunks = chunks.withColumns({"node_id": content_uuid("text", "source_document_id", "node_monotonic_idx", F.lit("semantic")), "parent_chunk_id": F.lit(None).cast("string"), "node_kind": F.lit("semantic")})
    keep = [F.col("source_document_id"), F.col("node_id").alias("parent_chunk_id")]

    def children(parts: DataFrame, kind: str) -> DataFrame:
        return parts.withColumn("node_monotonic_idx", F.col("node_monotonic_idx").cast("long")).withColumns({"node_kind": F.lit(kind), "node_id": content_uuid("text", "parent_chunk_id", "node_monotonic_idx", F.lit(kind))})

    cut = children(chunks.select(*keep, F.posexplode(sentences("text")).alias("node_monotonic_idx", "text")), "sentence")
    said = decompose.claims(chunks.select(F.struct(*keep).alias("k"), "text"), "k", "text", finder)
    told = children(said.select("k.*", F.col("claim_idx").alias("node_monotonic_idx"), F.col("claim").alias("text")), "claim")
    nodes = reduce(DataFrame.unionByName, [x.select(*NODE) for x in (chunks, cut, told)])
    return decompose.embed(nodes, "text", embedder)


def add_nodes(store: DataFrame | None, nodes: DataFrame) -> DataFrame:
    return upsert(store, nodes, "node_id")


def scroll(facts: DataFrame, where=None, order_by: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A filtered scan, with a page of it if asked for."""
    out = facts.where(where) if where is not None else facts
    out = out.orderBy(order_by) if order_by else out
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def evaluate(propositions: DataFrame, facts: DataFrame, methods: list[str], top_n: list[int], formats: list[str], keys: list[str], done: DataFrame | None = None, judge: Judge | None = None) -> DataFrame:
    """Verdicts of every proposition under every setting that done (query_id, rater) lacks.

    propositions: query_id, q, query, keys; facts: node_id, v, text, category, description, keys. Facts are searched once,
    as far as the largest of top_n, of which each setting takes its part, and only the texts found go further. A
    proposition under a setting is a query of its own, so all settings are one plan.
    """
    sources = sorted({s for m in methods for s in retrieval.PRESETS[m][0]})
    found = checkpointed(retrieval.searched(propositions, facts, sources, max(top_n), keys))
    texts = checkpointed(retrieval.facts_of(found, facts, "text", "category", "description").withColumn("__t", F.sha2("text", 256)))
    settings = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(n).alias("n")) for m in methods for n in top_n)))
    key = F.struct("query_id", "__s.method", "__s.n")
    uses = reduce(lambda a, b: a | b, ((F.col("__s.method") == m) & F.col("source").isin(*retrieval.PRESETS[m][0]) for m in methods))
    rows = found.withColumn("__s", settings).where(uses & (F.col("rank") <= F.col("__s.n"))).select(key.alias("query_id"), "source", "node_id", "score")
    rows = retrieval.dedup_text(retrieval.fuse(rows).join(texts.select("node_id", "__t"), "node_id"), "__t").select("query_id", "node_id", "score")
    again = F.col("query_id.method").isin(*(m for m in methods if retrieval.PRESETS[m][1]))
    asked = rows.where(again).join(texts.select("node_id", "text"), "node_id").join(propositions.select(F.col("query_id").alias("__q"), "query"), F.col("query_id.query_id") == F.col("__q"))
    reranked = retrieval.rerank(asked, max(top_n)).select("query_id", "node_id", "score")
    best = retrieval.top_k(rows.where(~again).unionByName(reranked), max(top_n)).where(F.col("rank") <= F.col("query_id.n"))
    shown = best.join(texts.drop("__t"), "node_id")
    out = []
    for form in formats:
        rater = config_string({"retrieval_method": F.col("key.method"), "top_n": F.col("key.n"), "reference_format": F.lit(form)})
        todo = propositions.select("query_id", settings.alias("__s")).select("query_id", key.alias("key")).withColumn("rater", rater)
        todo = todo if done is None else not_yet_done(todo, done, ["query_id", "rater"])
        told = context.contexts(todo.select(F.col("key").alias("query_id")), shown, form).withColumnRenamed("query_id", "key")
        out.append(told.select(F.col("key.query_id").alias("query_id"), rater.alias("rater"), "context"))
    asked = reduce(DataFrame.unionByName, out).join(propositions.select("query_id", "query"), "query_id")
    return decompose.judge(asked, "query", "context", judge).select("query_id", "rater", "verdict", "reason")


def reports(verdicts: DataFrame) -> DataFrame:
    return stats.score_report(verdicts, ["rater"])


def agreement_run(verdicts: DataFrame, truth: DataFrame, strata: list[str]) -> DataFrame:
    """Agreement of each rater with the truth in all strata at once. verdicts: item, rater, value and the strata columns."""
    rows = stats.with_stratum(verdicts, strata).select("stratum", "item", "rater", "value")
    return agreement.against_truth(rows, truth, ["stratum"])
