"""Catalogue: agreement, confusion measures, bootstrap, score reports. Ratings: order = item, line = rater, return flag = value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.columns import NEITHER, binarized, display, ordinal, valid_verdict
from veriloom.operators import agreement, classification, stats
from veriloom.plans.registry import Tables, query
from veriloom.plans.relational import ratings

R = "(SELECT l_orderkey AS item, l_linenumber AS rater, min(l_returnflag) AS value, min(l_linestatus) AS stratum FROM lineitem GROUP BY 1, 2)"
X = "(SELECT l_orderkey AS item, l_linenumber AS rater, min(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def counts_sql(rows: str, by: str = "'all'") -> str:
    """by, n, n2, pa, q and the sums of shares that the coefficients need."""
    return f"""(SELECT g, sum(x.p) AS n, sum(x.items2) AS n2, sum(x.agree) / sum(x.items2) AS pa, count(*) AS q, sum(x.p * x.p) / (sum(x.p) * sum(x.p)) AS pp, sum(x.c) AS a, sum(x.c * x.c) AS aa, sum(x.w) AS within FROM (
SELECT g, value, sum(r / ri) AS p, sum(CASE WHEN ri >= 2 THEN r / ri END) AS items2, sum(CASE WHEN ri >= 2 THEN r * (r - 1) / (ri * (ri - 1)) END) AS agree, sum(CASE WHEN ri >= 2 THEN r END) AS c, sum(CASE WHEN ri >= 2 THEN r * (r - 1) / (ri - 1) END) AS w FROM (
SELECT {by} AS g, item, value, count(*) AS r, sum(count(*)) OVER (PARTITION BY {by}, item) AS ri FROM {rows} WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) x GROUP BY 1)"""


AC1 = "CASE WHEN q > 1 THEN round((pa - (1 - pp) / (q - 1)) / (1 - (1 - pp) / (q - 1)), 9) + 0.0 END"
ALL = f"CAST(round(n) AS BIGINT) AS n_items, q AS n_values, round(pa, 9) + 0.0 AS percent_agreement, {AC1} AS gwet_ac1, round((pa - pp) / (1 - pp), 9) + 0.0 AS fleiss_kappa, round((pa - 1.0 / q) / (1 - 1.0 / q), 9) + 0.0 AS brennan_prediger, CASE WHEN a * a > aa THEN round(1 - (a - 1) * (a - within) / (a * a - aa), 9) + 0.0 END AS krippendorff_alpha"


@query(f"SELECT {ALL} FROM {counts_sql(R)}")
def agreement_coefficients(t: Tables) -> DataFrame:
    return agreement.coefficients(ratings(t))


def _one(metric: str, expression: str) -> None:
    def f(t: Tables) -> DataFrame:
        return agreement.coefficients(ratings(t)).select(metric)

    f.__name__ = metric
    query(f"SELECT {expression} AS {metric} FROM {counts_sql(R)}")(f)


_one("percent_agreement", "round(pa, 9) + 0.0")
_one("gwet_ac1", AC1)
_one("fleiss_kappa", "round((pa - pp) / (1 - pp), 9) + 0.0")
_one("brennan_prediger", "round((pa - 1.0 / q) / (1 - 1.0 / q), 9) + 0.0")
_one("krippendorff_alpha", "round(1 - (a - 1) * (a - within) / (a * a - aa), 9) + 0.0")


def _stratified(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater")).agg(F.min("l_returnflag").alias("value"), F.min("l_linestatus").alias("stratum"))


@query(f"SELECT g AS stratum, {ALL} FROM {counts_sql(R, 'stratum')}")
def agreement_by_stratum(t: Tables) -> DataFrame:
    return agreement.coefficients(_stratified(t), ["stratum"])


@query(f"""SELECT g AS "Line Status", CAST(round(n) AS BIGINT) AS "Items", round(pa, 9) + 0.0 AS "Percent Agreement", {AC1} AS "Gwet's AC1" FROM {counts_sql(R, 'stratum')}""")
def metric_result_table(t: Tables) -> DataFrame:
    headers = {"stratum": "Line Status", "n_items": "Items", "percent_agreement": "Percent Agreement", "gwet_ac1": "Gwet's AC1"}
    return stats.result_table(agreement.coefficients(_stratified(t), ["stratum"]), headers)


@query(f"""SELECT round((pa - pe) / (1 - pe), 9) + 0.0 AS conger_kappa FROM {counts_sql(R)}, (SELECT sum(m * m) - sum(v / k) AS pe FROM (
SELECT value, sum(share) / max(k) AS m, (sum(share * share) - max(k) * (sum(share) / max(k)) * (sum(share) / max(k))) / (max(k) - 1) AS v, max(k) AS k FROM (
SELECT rater, value, count(*) / sum(count(*)) OVER (PARTITION BY rater) AS share, (SELECT count(DISTINCT rater) FROM {R}) AS k FROM {R} GROUP BY 1, 2) GROUP BY 1))""")
def conger_kappa(t: Tables) -> DataFrame:
    return agreement.conger_kappa(ratings(t))


def _quantities(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater")).agg(F.min("l_quantity").alias("value"))


@query(f"""SELECT round(1 - (sum(w) / sum(m)) / (2 * (sum(m) * sum(ss) - sum(s) * sum(s)) / (sum(m) * (sum(m) - 1))), 9) + 0.0 AS krippendorff_alpha_interval FROM (
SELECT item, count(*) AS m, sum(value) AS s, sum(value * value) AS ss, 2 * (count(*) * sum(value * value) - sum(value) * sum(value)) / (count(*) - 1) AS w FROM {X} GROUP BY 1 HAVING count(*) >= 2)""")
def krippendorff_interval(t: Tables) -> DataFrame:
    return agreement.krippendorff_interval(_quantities(t))


@query(f"""SELECT count(*) AS n_items, round(2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y))), 9) + 0.0 AS ccc FROM (
SELECT item, max(CASE WHEN rater = 1 THEN value END) AS x, max(CASE WHEN rater = 2 THEN value END) AS y FROM {X} GROUP BY 1) WHERE x IS NOT NULL AND y IS NOT NULL""")
def ccc(t: Tables) -> DataFrame:
    return agreement.concordance(_quantities(t), 1, 2)


@query(f"""WITH c AS (SELECT item, max(CASE WHEN rater = 1 THEN value END) AS a, max(CASE WHEN rater = 2 THEN value END) AS b, max(CASE WHEN rater = 3 THEN value END) AS c FROM {X} GROUP BY 1),
f AS (SELECT * FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
m AS (SELECT count(*) AS n, avg((a + b + c) / 3) AS g, avg(a) AS ga, avg(b) AS gb, avg(c) AS gc FROM f),
s AS (SELECT n, 3 * sum(((a + b + c) / 3 - g) * ((a + b + c) / 3 - g)) AS ssr, max(n * ((ga - g) * (ga - g) + (gb - g) * (gb - g) + (gc - g) * (gc - g))) AS ssc, sum((a - g) * (a - g) + (b - g) * (b - g) + (c - g) * (c - g)) AS sst FROM f, m GROUP BY n),
q AS (SELECT n, ssr / (n - 1) AS r, ssc / 2 AS c, (sst - ssr - ssc) / ((n - 1) * 2) AS e, (sst - ssr) / (n * 2) AS w FROM s)
SELECT n AS n_items, round((r - w) / (r + 2 * w), 6) + 0.0 AS icc1, round((r - e) / (r + 2 * e + 3 * (c - e) / n), 6) + 0.0 AS icc2, round((r - e) / (r + 2 * e), 6) + 0.0 AS icc3, round((r - w) / r, 6) + 0.0 AS icc1k, round((r - e) / (r + (c - e) / n), 6) + 0.0 AS icc2k, round((r - e) / r, 6) + 0.0 AS icc3k FROM q""")
def icc(t: Tables) -> DataFrame:
    out = agreement.intraclass(_quantities(t), [1, 2, 3])
    return out.select("n_items", *((F.round(c, 6) + 0.0).alias(c) for c in ("icc1", "icc2", "icc3", "icc1k", "icc2k", "icc3k")))


@query(None)
def icc_inference(t: Tables) -> DataFrame:
    return agreement.intraclass_p(agreement.intraclass(_quantities(t), [1, 2, 3]))


@query(f"""WITH c AS (SELECT item, value, count(*) AS r, sum(count(*)) OVER (PARTITION BY item) AS ri FROM {R} GROUP BY 1, 2), p AS (SELECT value, sum(r / ri) AS p FROM c GROUP BY 1), s AS (SELECT value, p / sum(p) OVER () AS s, count(*) OVER () AS q FROM p),
h AS (SELECT sum(s * (1 - s)) / (max(q) - 1) AS pe, max(q) AS q FROM s), i AS (SELECT item, CASE WHEN max(ri) >= 2 THEN sum(r * (r - 1)) / (max(ri) * (max(ri) - 1)) END AS a, sum(r / ri * (1 - s)) AS e FROM c JOIN s USING (value) GROUP BY 1),
g AS (SELECT count(*) AS n, count(a) AS n2, avg(a) AS pa FROM i), k AS (SELECT *, (pa - pe) / (1 - pe) AS k FROM g, h),
d AS (SELECT n, k, (coalesce(a, 0) * n / n2 - pe) / (1 - pe) - 2 * (1 - k) * (e / (q - 1) - pe) / (1 - pe) - k AS d FROM i, k)
SELECT round(max(k), 8) + 0.0 AS gwet_ac1, round(sqrt(sum(d * d) / (max(n) * (max(n) - 1))), 8) + 0.0 AS se FROM d""")
def gwet_standard_error(t: Tables) -> DataFrame:
    return agreement.gwet_inference(ratings(t)).select(*((F.round(c, 8) + 0.0).alias(c) for c in ("gwet_ac1", "se")))


@query(None)
def gwet_inference(t: Tables) -> DataFrame:
    return agreement.gwet_inference(ratings(t))


@query(f"""WITH p AS (SELECT a.rater AS r1, b.rater AS r2, a.value AS v1, b.value AS v2 FROM {R} a JOIN {R} b ON a.item = b.item AND a.rater < b.rater),
s AS (SELECT r1, r2, v, count(*) / 2 AS m FROM (SELECT r1, r2, v1 AS v FROM p UNION ALL SELECT r1, r2, v2 FROM p) GROUP BY 1, 2, 3),
c AS (SELECT r1, r2, sum(m) AS n, (1 - sum(m * m) / (sum(m) * sum(m))) / (count(*) - 1) AS pe FROM s GROUP BY 1, 2), o AS (SELECT r1, r2, avg(CAST(v1 = v2 AS INTEGER)) AS pa FROM p GROUP BY 1, 2)
SELECT r1, r2, CAST(n AS BIGINT) AS n_items, round(pa, 9) + 0.0 AS percent_agreement, round((pa - pe) / (1 - pe), 9) + 0.0 AS gwet_ac1 FROM c JOIN o USING (r1, r2)""")
def pairwise_agreement(t: Tables) -> DataFrame:
    return agreement.pairwise(ratings(t))


@query(f"""WITH p AS (SELECT x.rater AS g, x.item, unnest([x.value, g.value]) AS value FROM {R} x JOIN {R} g ON g.item = x.item AND g.rater = 1 WHERE x.rater > 1)
SELECT g AS rater, CAST(round(n) AS BIGINT) AS n_items, round(pa, 9) + 0.0 AS percent_agreement, {AC1} AS gwet_ac1 FROM {counts_sql('p', 'g')}""")
def agreement_vs_ground_truth(t: Tables) -> DataFrame:
    r = ratings(t)
    return agreement.against_truth(r.where("rater > 1"), r.where("rater = 1").select("item", "value")).select("rater", "n_items", "percent_agreement", "gwet_ac1")


@query(f"SELECT 'percent_agreement' AS metric_name, round(pa, 9) + 0.0 AS value FROM {counts_sql(R)} UNION ALL SELECT 'gwet_ac1', {AC1} FROM {counts_sql(R)}")
def metric_dispatch(t: Tables) -> DataFrame:
    return agreement.dispatch(ratings(t))


# ------------------------------------------------------------------ bootstrap

DRAWS = 20
TIMES = f"""(SELECT draw, item, count(*) AS times FROM (SELECT draw, CAST('0x' || substr(md5(draw || '-' || j), 1, 8) AS BIGINT) % n AS j FROM (SELECT row_number() OVER (ORDER BY md5(CAST(item AS VARCHAR)), item) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT item FROM {{0}})), range({DRAWS}) d(draw)) x
JOIN (SELECT row_number() OVER (ORDER BY md5(CAST(item AS VARCHAR)), item) - 1 AS j, item FROM (SELECT DISTINCT item FROM {{0}})) USING (j) GROUP BY 1, 2)"""
DRAWN = f"""(SELECT draw, sum(w * agree) / sum(w) AS pa FROM (SELECT draw, item, max(times) AS w, sum(r * (r - 1)) / (max(ri) * (max(ri) - 1)) AS agree FROM (SELECT item, value, count(*) AS r, sum(count(*)) OVER (PARTITION BY item) AS ri FROM {R} GROUP BY 1, 2) JOIN {TIMES.format(R)} USING (item) WHERE ri >= 2 GROUP BY 1, 2) GROUP BY 1)"""


@query(f"SELECT draw, round(pa, 9) + 0.0 AS percent_agreement FROM {DRAWN}")
def bootstrap_percent_agreement(t: Tables) -> DataFrame:
    return agreement.bootstrap_agreement(ratings(t), DRAWS).select(F.col("draw").cast("long").alias("draw"), "percent_agreement")


@query(f"""SELECT round(quantile_cont(p, 0.025), 7) + 0.0 AS ci_lower, round(quantile_cont(p, 0.975), 7) + 0.0 AS ci_upper, round(stddev_samp(p), 7) + 0.0 AS se FROM (SELECT round(pa, 9) AS p FROM {DRAWN})""")
def bootstrap_interval(t: Tables) -> DataFrame:
    r = ratings(t)
    out = agreement.bootstrap_summary(agreement.bootstrap_agreement(r, DRAWS), agreement.coefficients(r), "percent_agreement")
    return out.select(*((F.round(c, 7) + 0.0).alias(c) for c in ("ci_lower", "ci_upper", "se")))


ALL_DRAWS = 1000


@query(None)
def bootstrap_all_nominal(t: Tables) -> DataFrame:
    """Intervals of all categorical coefficients from 1000 draws, as exact resamples by blocks."""
    return agreement.bootstrap_nominal(ratings(t), ALL_DRAWS)


@query(None)
def bootstrap_all_continuous(t: Tables) -> DataFrame:
    """The same of ICC(3), concordance and interval alpha of two raters."""
    return agreement.bootstrap_continuous(_quantities(t), 1, 2, ALL_DRAWS)


@query(None)
def bootstrap_all_classification(t: Tables) -> DataFrame:
    """The same of four measures and five counts by label."""
    return classification.bootstrap_measures(_labels(t), [0, 1], ALL_DRAWS)


L = "(SELECT doc_id AS item, quality AS y_true, 1 - toxic AS y_pred FROM labels)"


def _labels(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("item"), F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


def _cells(rows: str, by: str = "", weight: str = "1") -> str:
    ratio = lambda a, b: f"round(CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) END, 9) + 0.0"
    return f"""SELECT {by} label, {ratio('tp', 'fn')} AS tpr, {ratio('tn', 'fp')} AS tnr, {ratio('tp', 'fp')} AS ppv, {ratio('tn', 'fn')} AS npv, CAST(tp + fn AS BIGINT) AS support FROM (
SELECT {by} label, sum(CASE WHEN y_true = label AND y_pred = label THEN {weight} ELSE 0 END) AS tp, sum(CASE WHEN y_true <> label AND y_pred = label THEN {weight} ELSE 0 END) AS fp, sum(CASE WHEN y_true = label AND y_pred <> label THEN {weight} ELSE 0 END) AS fn, sum(CASE WHEN y_true <> label AND y_pred <> label THEN {weight} ELSE 0 END) AS tn
FROM {rows}, (VALUES (0), (1)) k(label) GROUP BY ALL)"""


@query(f"SELECT a.y AS y_true, b.y AS y_pred, count(item) AS n FROM (VALUES (0), (1)) a(y) CROSS JOIN (VALUES (0), (1)) b(y) LEFT JOIN {L} l ON l.y_true = a.y AND l.y_pred = b.y GROUP BY 1, 2")
def confusion_matrix(t: Tables) -> DataFrame:
    return classification.confusion_matrix(_labels(t), [0, 1])


@query(_cells(L))
def sens_spec_ppv_npv(t: Tables) -> DataFrame:
    return classification.one_vs_rest(_labels(t), [0, 1])


@query(f"""WITH m AS (SELECT CAST(label AS VARCHAR) AS label, coalesce(ppv, 0) AS p, coalesce(tpr, 0) AS r, support AS s FROM ({_cells(L)})), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT label, round(p, 7) + 0.0 AS precision, round(r, 7) + 0.0 AS recall, round(f1, 7) + 0.0 AS f1, s AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 7) + 0.0, round(avg(r), 7) + 0.0, round(avg(f1), 7) + 0.0, CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 7) + 0.0, round(sum(r * s) / sum(s), 7) + 0.0, round(sum(f1 * s) / sum(s), 7) + 0.0, CAST(sum(s) AS BIGINT) FROM f""")
def classification_report(t: Tables) -> DataFrame:
    out = classification.classification_report(_labels(t), [0, 1])
    return out.select("label", *((F.round(c, 7) + 0.0).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(_cells(f"(SELECT * FROM {L} JOIN {TIMES.format(L)} USING (item))", "draw,", "times"))
def bootstrap_classification(t: Tables) -> DataFrame:
    return classification.bootstrap(_labels(t), [0, 1], DRAWS).withColumn("draw", F.col("draw").cast("long"))


# ------------------------------------------------------------------ verdicts and reports

V = "(SELECT l_orderkey AS item, l_linenumber AS rater, CASE min(l_returnflag) WHEN 'R' THEN 'Supported' WHEN 'A' THEN 'Not Supported' ELSE 'Not Addressed' END AS verdict FROM lineitem GROUP BY 1, 2)"


def _verdicts(t: Tables) -> DataFrame:
    v = F.when(F.col("value") == "R", "supported").when(F.col("value") == "A", "not supported").otherwise("not addressed")
    return ratings(t).select("item", "rater", valid_verdict(v).alias("verdict"))


@query(f"SELECT item, rater, CASE WHEN verdict = 'Supported' THEN verdict ELSE '{NEITHER}' END AS verdict FROM {V}")
def binarize(t: Tables) -> DataFrame:
    return _verdicts(t).withColumn("verdict", binarized("verdict"))


REPORT = f"SELECT rater, count(*) FILTER (verdict = 'Supported') AS supported_count, count(*) FILTER (verdict = 'Not Supported') AS not_supported_count, count(*) FILTER (verdict = 'Not Addressed') AS not_addressed_count, count(*) AS total_count FROM {V} GROUP BY 1"


@query(f"SELECT *, round(supported_count / total_count, 9) + 0.0 AS supported_score, round(not_supported_count / total_count, 9) + 0.0 AS not_supported_score, round(not_addressed_count / total_count, 9) + 0.0 AS not_addressed_score FROM ({REPORT})")
def score_report(t: Tables) -> DataFrame:
    return stats.score_report(_verdicts(t), ["rater"])


@query(f"SELECT rater, item, verdict FROM {V}")
def score_report_explode(t: Tables) -> DataFrame:
    nested = stats.nested_report(_verdicts(t), ["item"], ["rater", "verdict"])
    return stats.explode_report(nested, ["item"]).select("rater", "item", "verdict")


@query(f"SELECT item, rater, verdict FROM {V} WHERE rater <= 3")
def melt_raters(t: Tables) -> DataFrame:
    cells = [c for i in (1, 2, 3) for c in (F.lit(i).alias(f"rater{i}"), F.max(F.when(F.col("rater") == i, F.col("verdict"))).alias(f"verdict{i}"))]
    return stats.melt_raters(_verdicts(t).groupBy("item").agg(*cells), 3, ["item"])


@query(f"""SELECT rater, supported_count AS "Supported", not_supported_count AS "Not Supported", not_addressed_count AS "Not Addressed" FROM ({REPORT})""")
def pivot_verdicts(t: Tables) -> DataFrame:
    cells = _verdicts(t).groupBy("rater", F.col("verdict").alias("item")).agg(F.count(F.lit(1)).alias("value"))
    return stats.pivot_ratings(cells, ["Supported", "Not Supported", "Not Addressed"]).fillna(0)


@query(f"""SELECT rater, max(CASE WHEN item % 4 = 0 THEN n END) AS "0", max(CASE WHEN item % 4 = 1 THEN n END) AS "1", max(CASE WHEN item % 4 = 2 THEN n END) AS "2", max(CASE WHEN item % 4 = 3 THEN n END) AS "3" FROM (SELECT rater, item % 4 AS item, count(*) FILTER (verdict = 'Supported') AS n FROM {V} GROUP BY 1, 2) GROUP BY 1""")
def pivot_ratings(t: Tables) -> DataFrame:
    cells = _verdicts(t).groupBy("rater", (F.col("item") % 4).alias("item")).agg(F.count_if(F.col("verdict") == "Supported").alias("value"))
    return stats.pivot_ratings(cells, [0, 1, 2, 3])


@query(f"SELECT item % 3 AS g, rater, supported FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY supported DESC, rater) AS r FROM (SELECT item % 3 AS item, rater, round(avg(CAST(verdict = 'Supported' AS INTEGER)), 9) + 0.0 AS supported FROM {V} GROUP BY 1, 2)) WHERE r = 1")
def best_system(t: Tables) -> DataFrame:
    from veriloom.functions.columns import rounded

    m = _verdicts(t).groupBy((F.col("item") % 3).alias("g"), "rater").agg(rounded(F.avg((F.col("verdict") == "Supported").cast("int"))).alias("supported"))
    return stats.best_system(m, ["g"], "supported", "rater")


@query(f"""SELECT rater, printf('%.1f%% (%.1f-%.1f%%)', 100 * p, 100 * (p - h), 100 * (p + h)) AS shown, printf('%.2f', p) AS plain, CAST(row_number() OVER (ORDER BY k, rater) AS BIGINT) AS place, k AS top FROM (
SELECT rater, p, 1.96 * sqrt(p * (1 - p) / total_count) AS h, CAST(CASE WHEN supported_count >= greatest(not_supported_count, not_addressed_count) THEN 1 WHEN not_supported_count >= not_addressed_count THEN 2 ELSE 3 END AS BIGINT) AS k FROM (SELECT *, supported_count / total_count AS p FROM ({REPORT})))""")
def display_strings(t: Tables) -> DataFrame:
    """Shares with normal bounds, and raters in the order of their most frequent verdict's category."""
    r = stats.score_report(_verdicts(t), ["rater"]).withColumn("p", F.col("supported_count") / F.col("total_count"))
    h, s, n, a = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("total_count")) * 1.96, *(F.col(f"{c}_count") for c in ("supported", "not_supported", "not_addressed"))
    most = F.when(s >= F.greatest(n, a), "Supported").when(n >= a, "Not Supported").otherwise("Not Addressed")
    none = F.lit(None).cast("double")
    out = r.select("rater", display("p", F.col("p") - h, F.col("p") + h, percent=True).alias("shown"), display("p", none, none).alias("plain"), ordinal(most, ["Supported", "Not Supported", "Not Addressed"]).cast("long").alias("top"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("top", "rater")).cast("long"))  # one row a rater
