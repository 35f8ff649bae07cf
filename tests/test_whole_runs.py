"""Whole runs make each vector once, whatever the number of settings, and give what a search for each setting gives."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriloom.functions.backends import HashedWords
from veriloom.operators import context, decompose, retrieval
from veriloom.plans import pipelines

WORDS = "the red fox saw a blue bird near some old stone bridge while rain fell over green hills".split()


def writes_down(path):
    """Hashed words that write down in a file how many texts they were given; a class of its own function travels with the task."""

    class Noted:
        def embed(self, texts):
            with open(str(path), "a") as f:
                f.write(f"{len(texts)}\n")
            return HashedWords().embed(texts)

    return Noted()


def noted(path):
    return [int(x) for x in path.read_text().split()] if path.exists() else []


@pytest.fixture
def tables(spark):
    text = lambda i: " ".join(WORDS[(i * (j + 3) + j * j) % len(WORDS)] for j in range(3 + i % 7))
    facts = [(i, text(i % 150), "c" if i % 3 else None, "d") for i in range(200)] + [(500, "", "c", "d"), (501, None, "c", "d")]
    asked = [(i, text(7 * i + 1)) for i in range(12)] + [(90, ""), (91, None)]
    return (spark.createDataFrame(facts, "node_id long, text string, category string, description string").repartition(3), spark.createDataFrame(asked, "query_id long, query string"))


def embedded(tables, path=None):
    facts, asked = tables
    facts = decompose.embed(facts, "text", path and writes_down(path), sparse=False).withColumnRenamed("dense", "v")
    return decompose.embed(asked, "query", sparse=False).withColumnRenamed("dense", "q"), facts


def test_dense_alone_is_the_same(tables):
    for r in decompose.embed(decompose.embed(tables[0], "text").withColumnRenamed("dense", "both"), "text", sparse=False).collect():
        assert r["both"] == r["dense"]


@pytest.mark.parametrize("keys", [[], ["s"]])
def test_evaluation_equals_a_search_for_each_setting(spark, tables, keys):
    asked, facts = (x.withColumn("s", F.lit(1)) for x in embedded(tables))
    facts, asked = facts.localCheckpoint(), asked.localCheckpoint()
    want = Counter()
    for method in retrieval.PRESETS:
        for n in (1, 4):
            found = retrieval.retrieve(asked, facts, method, n, keys, dedup=True).select("query_id", "node_id", "score")
            told = context.contexts(asked, found.join(facts.select("node_id", "text", "category", "description"), "node_id"))
            for r in decompose.judge(told.join(asked.select("query_id", "query"), "query_id"), "query", "context").collect():
                want[r["query_id"], f"retrieval_method={method},top_n={n},reference_format=score", r["verdict"], r["reason"]] += 1
    got = pipelines.evaluate(asked, facts, list(retrieval.PRESETS), [1, 4], ["score"], keys)
    assert Counter(map(tuple, got.collect())) == want and len(want) == 14 * 8
    done = got.where("query_id < 5 or rater like '%dense%'").select("query_id", "rater").localCheckpoint()
    rest = pipelines.evaluate(asked, facts, list(retrieval.PRESETS), [1, 4], ["score"], keys, done)
    assert Counter(map(tuple, rest.collect())) == {k: v for k, v in want.items() if k[0] >= 5 and "dense" not in k[1]}


def test_evaluation_embeds_each_fact_once(tables, tmp_path):
    asked, facts = embedded(tables, tmp_path / "calls")
    assert pipelines.reports(pipelines.evaluate(asked, facts, list(retrieval.PRESETS), [2, 3], ["score"], [])).count() == 8
    assert sum(noted(tmp_path / "calls")) == 202


def test_blocks_of_queries_embed_each_fact_once(tables, tmp_path):
    asked, facts = embedded(tables, tmp_path / "calls")
    whole = sorted(map(tuple, retrieval.scan(asked, embedded(tables)[1], 3).collect()))
    assert sorted(map(tuple, retrieval.scan(asked, facts, 3, block=4).collect())) == whole
    assert sum(noted(tmp_path / "calls")) == 202


def test_texts_come_in_small_batches(spark, tmp_path):
    rows = spark.range(3000).select(F.repeat(F.lit("some words of a text "), 100).alias("text")).coalesce(1)
    assert decompose.embed(rows, "text", writes_down(tmp_path / "calls")).where("size(dense) = 64").count() == 3000
    assert max(noted(tmp_path / "calls")) <= 512


def test_retrieval_embeds_each_fact_once(tables, tmp_path):
    asked, facts = embedded(tables, tmp_path / "calls")
    found = retrieval.retrieve(asked, facts, "rerank", 3, dedup=True)
    rows = [(r["query_id"], r["text"]) for r in found.collect()]
    assert {q for q, _ in rows} == set(range(12)) and len(rows) == len(set(rows))
    assert sum(noted(tmp_path / "calls")) == 202
