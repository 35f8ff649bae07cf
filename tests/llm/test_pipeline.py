import random

import pytest
from helpers import DOCS, clashing

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN = "the cat sat on mat and then it went home with a dog that was there before we saw them again in town".split()
DE = "der hund und die katze sind nicht in dem haus weil es heute noch regnet und schneit auf allen wegen".split()


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(DE if i % 3 == 0 else EN) for _ in range(80)) for i in range(120)]
    junk = [" ".join(rng.choice(EN) + "%%%" for _ in range(80)) for _ in range(60)]
    passage = " ".join(rng.choice(EN) for _ in range(60))
    rows = [(i, t, "de" if i % 3 == 0 else "en") for i, t in enumerate(texts)]
    rows += [(200 + i, t, "en") for i, t in enumerate(junk)] + [(300, "12 34 !!", None), (301, None, None), (302, texts[5] + " more", "en"), (303, texts[6], "de")]
    rows += [(310 + i, " ".join(rng.choice(EN) for _ in range(40)) + " " + passage + " " + " ".join(rng.choice(EN) for _ in range(40)), "en") for i in range(4)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i in range(120)] + [(200 + i, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == columns
    assert seen[0] >= set(range(120)) and not seen[0] & {300, 301}
    assert len(seen[1] & set(range(200, 260))) <= 3 and len(seen[1] & set(range(120))) >= 118
    assert not seen[2] & {302, 303} and seen[2] >= set(range(310, 314))
    left = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/3").collect()}
    assert passage in left[310] and all(passage not in left[i] for i in (311, 312, 313))
    final = corpus_pipeline.run(spark, folder)
    assert final.count() >= len(seen[3]) and {r["doc_id"] for r in final.collect()} == seen[3]


def test_quality_stage_follows_the_classifier(spark, tmp_path):
    from veriloom.llm import quality

    rng = random.Random(11)
    mixed = lambda share: " ".join(rng.choice(EN) + ("%%%" if rng.random() < share else "") for _ in range(60))
    texts = [mixed(0) for _ in range(120)] + [mixed(1) for _ in range(120)] + [mixed(i / 100) for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert any(0.1 <= r["score"] < 0.5 for r in scored)
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {r["doc_id"] for r in scored if r["predicted"] == 1}


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_of_one_id_or_none_are_documents(spark, parts):
    said = lambda seed, n=80: " ".join(random.Random(seed).choices(EN, k=n))
    rows = [(0, said(2) + " more"), (1, said(1)), (1, said(2)), (1, said(1)), (None, said(3)), (None, said(4)), (None, said(5)), (7, said(5) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(parts)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["text"]) for r in out.collect()) == sorted([(0, rows[0][1]), (1, said(1)), (99, said(3)), (99, said(4)), (7, rows[7][1])])

    passage = said(6, 60)
    rows = [(i, f"{said(10 + k, 40)} {passage} {said(20 + k, 40)}") for k, i in enumerate((3, 3, None, None))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(parts)
    out = corpus_pipeline.repeats_stage(spark, docs, "")
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert [i for i, t in left if passage in t] == [3]
    for k, (i, _) in enumerate(rows):
        assert sum(j == i and t.startswith(said(10 + k, 40)[:-5]) and t.endswith(said(20 + k, 40)[5:]) for j, t in left) == 1


@pytest.mark.parametrize("case", ["empty", "clashing", "repeated"])
def test_odd_tables(spark, tmp_path, case):
    """Empty tables give no rows; clashing columns are kept up to stage 4; repeated and very long rows."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(EN, k=60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, " ".join(rng.choices(EN, k=60_000))), (53, "the" * 30_000)] + ([(3, texts[3])] * 20 if case == "repeated" else [])
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)) if case != "empty" else spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)] if case != "empty" else [], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids == (set() if case == "empty" else {*range(30), 52, 53}) and docs.count() >= len(ids)
    assert docs.count() == docs.select("doc_id", "piece").distinct().count()
