"""Hand-checked cases and edge cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriloom.functions import backends, distributions
from veriloom.functions.columns import age_years, between_markers, binarized, char_span, config_map, config_string, content_uuid, day_window, text_match, valid_verdict, whole_days
from veriloom.operators import agreement, classification, cohort, context, decompose, retrieval, stats
from veriloom.sources import tables
from veriloom.streaming.ingest import ingest, stream_files


def near(x, y):
    assert x == pytest.approx(y, abs=1e-8)


@pytest.fixture
def lists(spark):
    return spark.createDataFrame([(1, "dense", "a", 0.9), (1, "dense", "b", 0.5), (1, "dense", "c", 0.1), (1, "sparse", "b", 4.0), (1, "sparse", "d", 2.0)], "query_id int, source string, node_id string, score double")


def scores(df):
    return {r["node_id"]: r["score"] for r in df.collect()}


def test_relative_fusion(lists):
    assert scores(retrieval.relative_score_fusion(lists)) == pytest.approx({"a": 0.5, "b": 0.75, "c": 0, "d": 0})
    weighted = scores(retrieval.relative_score_fusion(lists, {"dense": 3, "sparse": 1}))
    near(weighted["a"], 0.375)
    near(weighted["b"], 0.3125)


def test_single_scores_in_fusion(spark):
    one = spark.createDataFrame([(1, "dense", "a", 0.7), (2, "dense", "b", -0.2)], "query_id int, source string, node_id string, score double")
    assert scores(retrieval.relative_score_fusion(one)) == {"a": 1.0, "b": 0.0}


def test_reciprocal_fusion(lists):
    out = retrieval.reciprocal_rank_fusion(lists)
    assert [r["node_id"] for r in out.orderBy("rank").collect()] == ["b", "a", "d", "c"]
    near(scores(out)["b"], 1 / 61 + 1 / 60)


def test_fuse_keeps_single_lists(lists):
    single = lists.where("source = 'dense'")
    assert scores(retrieval.fuse(single)) == {"a": 0.9, "b": 0.5, "c": 0.1}
    assert retrieval.fuse(lists.limit(0)).count() == 0


def test_dedup_text(spark):
    rows = spark.createDataFrame([(1, "x", "t", 0.4), (1, "y", "t", 0.9), (1, "z", "u", 0.5)], "query_id int, node_id string, text string, score double")
    assert scores(retrieval.dedup_text(rows)) == {"y": 0.9, "z": 0.5}


def test_rerank_truncation(spark):
    rows = spark.createDataFrame([(1, "x", "a b", "a b", 0.1), (1, "y", "a b", "c", 0.9)], "query_id int, node_id string, query string, text string, score double")
    assert scores(retrieval.rerank(rows, 1)) == {"x": 1.0}
    assert scores(retrieval.rerank(rows, 1, truncation="fusion")) == {"y": 0.0}


def test_null_fields_never_pass(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, kind string")
    assert [r.id for r in df.where(retrieval.build_filter(must=[("kind", "!=", "y")])).collect()] == [2]
    with pytest.raises(ValueError):
        retrieval.condition("kind", "~", 1)


@pytest.fixture
def rated(spark):
    return spark.createDataFrame([(1, 1, "S"), (1, 2, "S"), (1, 3, "S"), (2, 1, "S"), (2, 2, "N"), (2, 3, None), (3, 1, "S"), (3, 2, "S"), (3, 3, "N"), (4, 1, "N")], "item int, rater int, value string")


def test_coefficients(rated):
    r = agreement.coefficients(rated).first()
    near(r["percent_agreement"], 4 / 9)
    near(r["gwet_ac1"], -3 / 29)


def test_perfect_and_empty_agreement(spark, rated):
    r = agreement.coefficients(rated.where("item = 1")).first()
    assert r["percent_agreement"] == 1 and r["gwet_ac1"] is None
    assert agreement.coefficients(rated.limit(0), ["item"]).count() == 0


def test_intraclass_and_concordance(spark):
    # Shrout and Fleiss, 1979
    scores_ = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    rows = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(scores_) for j, v in enumerate(r)], "item int, rater int, value double")
    r = agreement.intraclass(rows, [0, 1, 2, 3]).first()
    assert [round(r[k], 2) for k in ("icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k")] == [0.17, 0.29, 0.71, 0.44, 0.62, 0.91]
    same = rows.where("rater = 0").unionByName(rows.where("rater = 0").withColumn("rater", F.lit(1)))
    assert agreement.concordance(same, 0, 1).first()["ccc"] == 1.0


def test_krippendorff_textbook(spark):
    # Krippendorff's four observers: nominal 0.743, interval 0.849
    grid = ["1 2 3 3 2 1 4 1 2 . . .", "1 2 3 3 2 2 4 1 2 5 . 3", ". 3 3 3 2 3 4 2 2 5 1 .", "1 2 3 3 2 4 4 1 2 5 1 ."]
    rows = spark.createDataFrame([(i, j, v) for j, r in enumerate(grid) for i, v in enumerate(r.split()) if v != "."], "item int, rater int, value string")
    assert round(agreement.coefficients(rows).first()["krippendorff_alpha"], 3) == 0.743
    assert round(agreement.krippendorff_interval(rows).first()[0], 3) == 0.849


def test_one_vs_rest(spark):
    rows = spark.createDataFrame(list(zip("SSNNA", "SNNNS", strict=True)), "y_true string, y_pred string")
    out = {r["label"]: r for r in classification.one_vs_rest(rows, ["S", "N", "A"]).collect()}
    assert (out["S"]["tpr"], out["S"]["ppv"], out["S"]["support"], out["A"]["ppv"]) == (0.5, 0.5, 2, None)
    near(out["S"]["tnr"], 2 / 3)
    assert classification.confusion_matrix(rows.limit(0), ["S", "N"]).agg(F.sum("n")).first()[0] == 0


def test_distributions():
    near(distributions.t_quantile(0.975, 10), 2.2281388520)
    near(distributions.t_two_sided(2.2281388520, 10), 0.05)
    near(distributions.f_upper(4.1028210, 2, 10), 0.05)


def test_labels_and_config(spark):
    df = spark.createDataFrame([(None,), ("Supported",), ("not addressed",), ("maybe",)], "v string")
    assert [r[0] for r in df.select(valid_verdict("v")).collect()] == [None, "Supported", "Not Addressed", None]
    assert [r[0] for r in df.select(binarized("v")).collect()][:2] == [None, "Supported"]
    row = spark.range(1).select(config_map(config_string({"reference_format": F.lit("absolute_time"), "top_n": F.lit(50)})).alias("m")).first()
    assert row["m"] == {"reference_format": "absolute time", "top_n": "50"}


def test_dates(spark):
    d = dt.datetime
    df = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 3, 23, 59, 59),), (d(2024, 1, 4),)], "at timestamp")
    a, b = F.lit(d(2024, 1, 1, 10)), F.lit(d(2024, 1, 3, 9))
    assert [r[0] for r in df.select(day_window("at", a, b)).collect()] == [True, True, False]
    one = spark.range(1).select(whole_days(a, b).alias("stay"), age_years(F.lit(d(1724, 1, 1)), a).alias("old")).first()
    assert tuple(one) == (1, 90)


def test_text_columns(spark):
    df = spark.createDataFrame([("x [a] body [b] [a]",), ("none",)], "t string")
    assert [r[0] for r in df.select(between_markers("t", "[a]", "[b]")).collect()] == ["body", ""]
    span = df.select(*char_span("t", F.lit("body"))).collect()
    assert tuple(span[0]) == (6, 10) and tuple(span[1]) == (None, None)
    assert [r[0] for r in df.select(text_match("t", F.lit("bod X"))).collect()] == [True, False]
    import hashlib
    import uuid

    assert df.select(content_uuid("t", F.lit(None).cast("string"))).first()[0] == str(uuid.UUID(hashlib.md5(b"x [a] body [b] [a]-").hexdigest()))


def test_breakpoints_and_packing(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(([1.0, 0.0], [0.9, 0.1], [0.8, 0.2], [0.0, 1.0]))], "doc int, i int, v array<double>")
    assert [r["chunk"] for r in decompose.breakpoints(rows, "doc", "i", "v").orderBy("i").collect()] == [0, 0, 0, 1]
    sizes = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 3), (2, 0, 9), (2, 1, 1)], "g int, i int, size int")
    packed = {(r["g"], r["i"]): r["pack"] for r in decompose.repacked(sizes, "g", "i", "size", 8).collect()}
    assert packed == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (2, 0): 0, (2, 1): 1}


def test_semantic_split_ends():
    pieces = [f"word{i} same text here. " for i in range(40)]
    out = decompose.semantic_split(pieces, 30, backends.HashedWords().embed)
    assert "".join(out) == "".join(pieces) and all(len(backends.word_list(c)) <= 30 for c in out)


def test_sentences_rejoin(spark):
    df = spark.createDataFrame([(1, "One. Two!  Three? "), (2, ""), (3, None)], "id int, t string")
    out = decompose.sentence_nodes(df, "id", "t").orderBy("source_document_id", "node_monotonic_idx").collect()
    assert "".join(r["text"] for r in out) == "One. Two!  Three? " and out[1]["prev_id"] == out[0]["node_id"]


def test_context_formats(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    d = dt.datetime
    rows = spark.createDataFrame([(1, "n", 0.5, d(2024, 1, 1, 5), d(2024, 1, 1), d(2024, 1, 3, 6), "Note", None, "text")], "query_id int, node_id string, score double, at timestamp, admit timestamp, end timestamp, category string, description string, text string")
    told = {f: {r["query_id"]: r["context"] for r in context.contexts(q, rows, f).collect()} for f in context.FORMATS}
    assert told["score"] == {1: "1. Score: 0.500, Category: Note, Description:  | text", 2: context.EMPTY}
    assert told["relative_time"][1] == "1. 2 days 1 hours before the end, Note | text"
    assert told["absolute_time"][1].startswith("Admission: 2024-01-01 00:00:00\n1. 2024-01-01 05:00:00")


def test_reports_and_strata(spark):
    v = spark.createDataFrame([(1, "Supported"), (1, None), (1, "Not Addressed")], "g int, verdict string")
    r = stats.score_report(v, ["g"]).first()
    assert (r["supported_count"], r["total_count"], r["supported_score"]) == (1, 2, 0.5)
    with pytest.raises(Exception, match="unknown verdict"):
        stats.score_report(spark.createDataFrame([(1, "Maybe")], "g int, verdict string"), ["g"]).collect()
    with pytest.raises(Exception, match="null in stratum"):
        stats.with_stratum(v, ["verdict"]).collect()


def test_cohort(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None)], "id int, iserror double")
    assert [r.id for r in cohort.without_errors(rows).collect()] == [2, 3]
    v = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3), (None, "a", 4)], "k int, j string, row int")
    assert sorted(r["row"] for r in cohort.latest_version(v, ["k", "j"], [F.col("row").desc()]).collect()) == [2, 3, 4]
    with pytest.raises(AssertionError):
        cohort.assert_disjoint(rows, rows, "id")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb \"q\""), (2, None)], "row_id long, text string")
    for name in ("t.parquet", "t.csv", "t.csv.gz", "t.json", "t.orc", "t.feather"):
        tables.write_any(df, str(tmp_path / name))
        back = tables.conform(tables.read_any(spark, str(tmp_path / name)), tables.NOTES)
        assert sorted((r["row_id"], r["text"]) for r in back.select("row_id", "text").collect() if r["row_id"] == 1) == [(1, 'a\nb "q"')], name
    with pytest.raises(ValueError):
        tables.read_any(spark, "x.unknown")
    up = tables.upsert(df, spark.createDataFrame([(2, "new"), (3, "c")], "row_id long, text string"), "row_id")
    assert {r["row_id"]: r["text"] for r in up.collect()}[2] == "new" and up.count() == 3
    assert tables.delete_documents(df, df.where("row_id = 1"), "row_id").count() == 1


def test_note_nodes(spark):
    d = dt.datetime
    notes = spark.createDataFrame([(1, 7, 5, d(2024, 1, 2), "b"), (2, 7, 5, d(2024, 1, 1), "a"), (3, 7, None, d(2024, 1, 1), "c")], "row_id long, subject_id long, hadm_id long, chartdate timestamp, text string")
    out = tables.note_nodes(notes, order=("chartdate", "row_id")).orderBy("node_monotonic_idx").collect()
    assert [r["row_id"] for r in out] == [2, 1] and out[0]["next_id"] == out[1]["node_id"] and out[0]["prev_id"] is None


def test_streamed_ingest(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, text string")
    df.write.parquet(str(source))
    for _ in range(2):
        ingest(stream_files(spark, str(source), df.schema), target, str(tmp_path / "ck"), lambda b: b.withColumn("n", F.length("text")), "id")
        df.write.mode("append").parquet(str(source))
    assert spark.read.parquet(target).count() == 2


def test_verdict_report(spark):
    from veriloom.functions.columns import verdict_report

    df = spark.createDataFrame([("Supported", "it says so", "a", "b", "first, then", "yes"), ("Not Addressed", None, "a", None, "", None)], "v string, r string, t string, f string, c string, z string")
    got = [r[0] for r in df.select(verdict_report("v", "r", "t", "f", "c", "z")).collect()]
    assert got == ["Verdict: Supported\nReason: it says so\nText: a\nReference: \nb\nReasoning Chain: first, then\nReasoning Final Answer: yes", "Verdict: Not Addressed\nReason: \nText: a\nReference: \n"]


def test_result_table(spark):
    from veriloom.operators.stats import result_table

    df = spark.createDataFrame([("x", 0.5, 1), ("y", 0.6, 2)], "model string, share double, other int")
    out = result_table(df, {"share": "Share", "model": "Judge"}, {"model": ["y"]})
    assert out.columns == ["Share", "Judge"] and [tuple(r) for r in out.collect()] == [(0.6, "y")]
