"""Bootstrap by blocks, scans of all facts, splitting and writing against plain versions."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest

from veriloom.functions import backends
from veriloom.functions.columns import experiment_group
from veriloom.operators import agreement, classification, decompose, retrieval, stats
from veriloom.sources import tables


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(3)
    rows = [(i, r, rng.choice("aab") if rng.random() < 0.7 else "c") for i in range(300) for r in (1, 2, 3) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "item long, rater long, value string")


def drawn_items(items, draws, blocks, seed, block_of):
    """The same draws, item by item."""
    lists = [sorted(i for i in items if block_of[i] == b) for b in range(blocks)]
    before = np.cumsum([0, *map(len, lists)])
    for d in range(draws):
        out = []
        for b, own in enumerate(lists):
            k = agreement.drawn_in_block(d, b, before, seed)
            if own:
                out += [own[j] for j in np.random.default_rng((seed, d, b)).integers(0, len(own), k)]
        yield out


def test_draws_of_blocks_sum_to_all():
    before = np.cumsum([0, 5, 0, 70, 1, 24])
    for d in range(50):
        drawn = [agreement.drawn_in_block(d, b, before) for b in range(5)]
        assert sum(drawn) == 100 and drawn[1] == 0
    mean = np.mean([[agreement.drawn_in_block(d, b, before) for b in range(5)] for d in range(3000)], axis=0)
    assert np.allclose(mean, [5, 0, 70, 1, 24], atol=0.6)


def test_bootstrap_equals_resampled_ratings(spark, rated, monkeypatch):
    from pyspark.sql import functions as F

    values = ["a", "b", "c"]
    items = agreement.nominal_stats(rated, values)
    sums = agreement.bootstrap_sums(items, 4, 7, block_items=100)
    got = {r["draw"]: r for r in agreement.nominal_from_sums(sums, 3).collect()}
    blocks = 3
    block_of = {r["item"]: r["b"] for r in items.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("b")).collect()}
    frame = rated.toPandas()
    for d, drawn in enumerate(drawn_items(block_of, 4, blocks, 7, block_of)):
        assert len(drawn) == len(block_of)
        again = pd.concat([frame[frame["item"] == i].assign(item=k) for k, i in enumerate(drawn)])
        want = agreement.coefficients(spark.createDataFrame(again)).first()
        for m in agreement.NOMINAL:
            assert got[d][m] == pytest.approx(want[m], abs=1e-8)


def test_intervals_of_all_metrics(rated):
    out = {r["metric_name"]: r for r in agreement.bootstrap_nominal(rated, 200).collect()}
    assert set(out) == set(agreement.NOMINAL)
    assert all(r["ci_lower"] < r["value"] < r["ci_upper"] and r["se"] > 0 for r in out.values())


def test_continuous_bootstrap_equals_resampling(spark):
    rng = random.Random(8)
    base = [rng.gauss(0, 3) for _ in range(60)]
    rows = [(i, r, b + rng.gauss(0, 1)) for i, b in enumerate(base) for r in ("x", "y") if (i, r) != (5, "y")]
    df = spark.createDataFrame(rows, "item long, rater string, value double")
    out = {r["metric_name"]: r for r in agreement.bootstrap_continuous(df, "x", "y", 300).collect()}
    frame = df.toPandas().pivot(index="item", columns="rater", values="value").dropna().to_numpy()
    again = []
    for d in range(300):
        x = frame[np.argsort(np.arange(len(frame)))][np.random.default_rng((0, d, 0)).integers(0, len(frame), len(frame))]
        gap = x.mean(axis=0)
        again.append(2 * np.cov(x.T, bias=True)[0, 1] / (x.var(axis=0).sum() + (gap[0] - gap[1]) ** 2))
    assert out["ccc"]["ci_lower"] == pytest.approx(np.quantile(again, 0.025), abs=1e-8) and out["ccc"]["se"] == pytest.approx(statistics.stdev(again), abs=1e-8)
    assert all(r["ci_lower"] < r["value"] < r["ci_upper"] for r in out.values()) and set(out) == set(agreement.CONTINUOUS)


def test_measures_and_counts(spark):
    rng = random.Random(2)
    rows = [(i, t, t if rng.random() < 0.8 else 1 - t) for i in range(200) for t in [int(rng.random() < 0.4)]] + [(999, None, 1)]
    df = spark.createDataFrame(rows, "item long, y_true long, y_pred long")
    out = {(r["label"], r["metric_name"]): r for r in classification.bootstrap_measures(df, [0, 1], 200).collect()}
    point = {r["label"]: r for r in classification.one_vs_rest(df, [0, 1]).collect()}
    assert len(out) == 18
    for label in (0, 1):
        for m in classification.MEASURES:
            assert out[label, m]["value"] == pytest.approx(point[label][m]) and out[label, m]["ci_lower"] <= out[label, m]["value"] <= out[label, m]["ci_upper"]
        assert sum(out[label, c]["value"] for c in ("tp", "fp", "fn", "tn")) == 200
    assert out[0, "tp"]["value"] == out[1, "tn"]["value"]


def test_bootstrap_items_draws_as_many(spark):
    items = spark.createDataFrame([(g, i) for g, n in (("a", 50), ("b", 7)) for i in range(n)], "g string, item long")
    out = agreement.bootstrap_items(items, 5, ["g"]).groupBy("g", "draw").sum("times").collect()
    assert {(r["g"], r["sum(times)"]) for r in out} == {("a", 50), ("b", 7)} and len(out) == 10


def test_own_metrics_by_name(rated):
    from pyspark.sql import functions as F

    mine = {"raters": lambda ratings, by: ratings.groupBy(*by).agg(F.count_distinct("rater").cast("double").alias("raters"))}
    out = {r["metric_name"]: r["value"] for r in agreement.dispatch(rated, ("gwet_ac1", "conger_kappa", "raters"), more=mine).collect()}
    assert out["raters"] == 3 and set(out) == {"gwet_ac1", "conger_kappa", "raters"}
    with pytest.raises(ValueError):
        agreement.dispatch(rated, ("nothing",))


# ------------------------------------------------------------------ scans


@pytest.mark.parametrize("similarity", ["cosine", "positive"])
def test_scan_is_exact(spark, similarity):
    rng = np.random.default_rng(4)
    facts = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(500, 8)), 1))] + [(900, [0.0] * 8), (901, None)]
    facts += [(1000 + i, facts[3][1]) for i in range(5)]  # ties
    queries = [(i, facts[i][1]) for i in range(40)] + [(77, None)]
    f, q = spark.createDataFrame(facts, "node_id long, v array<double>").repartition(5), spark.createDataFrame(queries, "query_id long, q array<double>")
    got = {}
    for r in retrieval.scan(q, f, 6, similarity, block=9).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["node_id"], round(r["score"], 9)))
    for i, v in queries[:-1]:
        a, want = np.array(v), []
        for n, w in facts:
            if w is not None:
                b = np.array(w)
                s = float(np.maximum(a, 0) @ np.maximum(b, 0)) if similarity == "positive" else (float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if b.any() else None)
                if s is not None and (similarity == "cosine" or s > 0):
                    want.append((-round(s, 9), n))
        assert [s for _, s in got[i]] == [-s for s, _ in sorted(want)[:6]]
    assert 77 not in got and retrieval.scan(q.limit(0), f, 3).count() == 0 and retrieval.scan(q, f.limit(0), 3).count() == 0


def test_scan_equals_keyed_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 16)))]
    facts = spark.createDataFrame(rows, "node_id long, s long, v array<double>")
    queries = spark.createDataFrame(rows[:20], "query_id long, s long, q array<double>")
    keyed, free = (retrieval.dense_search(queries, facts, 5, k).select("query_id", "rank", "node_id").collect() for k in (["s"], []))
    assert sorted(map(tuple, keyed)) == sorted(map(tuple, free))
    a, b = retrieval.retrieve(queries, facts, "hybrid", 5, ["s"]), retrieval.retrieve(queries, facts, "hybrid", 5)
    assert sorted((r["query_id"], r["rank"], r["node_id"]) for r in a.collect()) == sorted((r["query_id"], r["rank"], r["node_id"]) for r in b.collect())


def test_filters_with_a_least_number(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, "y", 9)], "id long, k string, n long")
    both = retrieval.merge_filters({"min_of": [("k", "==", "x")], "min_should": 1}, {"min_of": [("n", ">", 2)], "min_should": 2})
    assert [r["id"] for r in df.where(retrieval.build_filter(**both)).collect()] == [1]
    assert df.where(retrieval.build_filter(min_of=both["min_of"])).count() == 3


# ------------------------------------------------------------------ splitting and writing


def plain_split(pieces, most, percentile=90, buffer=3, shrink=0.75, force=False):
    """By recursion on texts, with every window embedded anew."""
    size, embed = backends.count_words, backends.HashedWords().embed
    if size("".join(pieces)) <= most and not force:
        return ["".join(pieces)]
    cuts = [pieces]
    if len(pieces) > 1:
        windows = ["".join(pieces[max(0, i - buffer) : i + buffer + 1]) for i in range(len(pieces))]
        v = np.array([e for e, _ in embed(windows)])
        far = 1 - (v[:-1] * v[1:]).sum(axis=1)
        at = [0, *(np.flatnonzero(far > np.percentile(far, percentile)) + 1).tolist(), len(pieces)]
        cuts = [pieces[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    out = []
    for c in cuts:
        n = size("".join(c))
        if n < most:
            out.append("".join(c))
        elif n < shrink * size("".join(pieces)):
            out += plain_split(c, most, percentile, buffer, shrink, True)
        else:
            parts = decompose.packed(c, most, size)
            out += parts if len(parts) > 1 else decompose.packed(c, max(1, most // 2), size)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_semantic_split_equals_plain_recursion(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pieces = [" ".join(rng.choices(words[20 * (i // 15 % 3) : 20 * (i // 15 % 3) + 20], k=rng.randrange(1, 25))) + ". " for i in range(rng.randrange(1, 120))]
    embed = backends.HashedWords().embed
    for most in (5, 40, 200):
        got = decompose.semantic_split(pieces, most, embed)
        assert "".join(got) == "".join(pieces) and got == plain_split(pieces, most)
        assert got == decompose.semantic_split(pieces, most, lambda x: embed(x))
    assert all(backends.count_words(c) <= 40 for c in decompose.semantic_split(pieces, 40, embed))


def test_backup_halves_and_force():
    embed = backends.HashedWords().embed
    assert decompose.semantic_split(["a b c d "], 4, embed) == ["a b c d "]
    assert decompose.semantic_split(["a b c d "], 4, embed, force=True) == ["a b ", "c d "]
    assert decompose.semantic_split([], 4, embed) == [] and decompose.semantic_split(["abcdefgh" * 9], 1, embed, size=len) == ["abcdefgh" * 9]


def test_writing_equals_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [(g, i, " ".join(f"s{g}{i}{k}." for k in range(rng.randrange(1, 9)))) for g in range(20) for i in range(rng.randrange(1, 12))] + [(99, 0, None), (None, 1, "x."), (None, 0, "y.")]
    df = spark.createDataFrame(rows, "g long, i long, t string").repartition(6)
    model, want = backends.FirstSentences(), {}
    for g in {r[0] for r in rows}:
        out = ""
        for _, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            out = model.write([out, t or ""] if out else [t or ""], 12)
        want[g] = out
    got = {r["g"]: r["written"] for r in decompose.written(df, "g", "i", "t", 12).collect()}
    assert got == want
    assert {r["g"] for r in decompose.course(df, "g", "i", "t", 12, 20).collect()} >= set(range(20))


def test_explanations_and_full_reports(spark):
    rows = [("s", i, "Supported", f"r{i % 7}") for i in range(300)] + [("s", 400, "Not Supported", None), ("t", 1, None, "x")]
    v = spark.createDataFrame(rows, "subject string, query_id long, verdict string, reason string")
    told = decompose.explained(v, ["subject"], together=20)
    assert {(r["subject"], r["verdict"]) for r in told.collect()} == {("s", "Supported"), ("s", "Not Supported")}
    report = stats.full_report(v, ["subject"], ["query_id"], told).collect()
    assert len(report) == 1 and tuple(report[0].asDict())[1:] == stats.REPORT
    r = report[0]
    assert (r["supported_count"], r["total_count"], len(r["verdicts"]), len(r["not_supported"])) == (300, 301, 301, 1) and r["not_addressed_explanation"] is None and r["supported_explanation"].startswith("Supported: ")


# ------------------------------------------------------------------ stores


def test_metrics_by_stratum_and_whole(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([("all", 0.5), ("1", 0.25)], "stratum string, value double")
    tables.save_metrics(df, str(tmp_path / "m"))
    assert {r["stratum"]: r["value"] for r in tables.load_metrics(spark, str(tmp_path / "m")).collect()} == {"all": 0.5, "1": 0.25}
    shutil.rmtree(tmp_path / "m/metrics/stratum=1")
    assert [r["value"] for r in tables.load_metrics(spark, str(tmp_path / "m"), ["1"]).collect()] == [0.25]
    with pytest.raises(FileNotFoundError):
        tables.load_metrics(spark, str(tmp_path / "none"))


def test_tables_are_reconciled(spark):
    spark.sql("DROP TABLE IF EXISTS facts_t")
    df = spark.createDataFrame([("a", 1)], "node_id string, n long")
    assert tables.ensure_table(df, "facts_t") == [] and tables.ensure_table(df.selectExpr("*", "1.5D AS w"), "facts_t") == ["w"]
    assert spark.table("facts_t").columns == ["node_id", "n", "w"]
    with pytest.raises(ValueError):
        tables.ensure_table(df.selectExpr("node_id", "'x' AS n"), "facts_t")
    spark.sql("DROP TABLE facts_t")


def test_upsert_is_settled_by_content(spark):
    new = [("a", i) for i in range(50)]
    seen = {tables.upsert(None, spark.createDataFrame(new, "node_id string, n long").repartition(p), "node_id").first()["n"] for p in (1, 3, 7)}
    assert len(seen) == 1


def test_pickles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    tables.write_any(df, str(tmp_path / "x.pkl"))
    assert sorted(r["id"] for r in tables.read_any(spark, str(tmp_path / "x.pkl")).collect()) == [1, 2]


def test_experiment_groups(spark):
    df = spark.createDataFrame([("author_type=llm,proposition_type=claim,fact_type=sentence",), ("x",)], "name string")
    assert [tuple(r["g"]) for r in df.select(experiment_group("name").alias("g")).collect()] == [("llm", "claim", "sentence"), (None, None, None)]
