"""Confusion matrices and one-vs-rest measures; 0/0 is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.columns import rounded
from veriloom.operators.agreement import bootstrap_items, bootstrap_sums, intervals

MEASURES = ("tpr", "tnr", "ppv", "npv")
COUNTS = ("tp", "fp", "fn", "tn", "support")


def confusion_matrix(rows: DataFrame, labels: list, by: list[str] = (), normalize: bool = False) -> DataFrame:
    """by, y_true, y_pred, n for all pairs of labels, absent ones 0. rows: y_true, y_pred."""
    spark, by = rows.sparkSession, list(by)
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("y_true"))
    grid = one.crossJoin(one.withColumnRenamed("y_true", "y_pred"))  # labels by labels: a constant
    if by:
        grid = rows.select(*by).distinct().crossJoin(F.broadcast(grid))
    counts = rows.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(counts, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalize:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        total = F.sum("n").over(whole)
        out = out.withColumn("n", rounded(F.when(total > 0, F.col("n") / total)))
    return out


def one_vs_rest(rows: DataFrame, labels: list, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, label and tpr, tnr, ppv, npv, support in one pass over the rows."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    counts = rows.where("y_true is not null and y_pred is not null").groupBy(*by, "y_true", "y_pred").agg(F.sum(w).alias("n"))
    per = counts.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    t, p = F.col("y_true") == F.col("label"), F.col("y_pred") == F.col("label")
    cell = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = per.groupBy(*by, "label").agg(cell(t & p).alias("tp"), cell(~t & p).alias("fp"), cell(t & ~p).alias("fn"), cell(~t & ~p).alias("tn"))
    ratio = lambda a, b: rounded(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))))
    return sums.select(*by, "label", ratio("tp", "fn").alias("tpr"), ratio("tn", "fp").alias("tnr"), ratio("tp", "fp").alias("ppv"), ratio("tn", "fn").alias("npv"), (F.col("tp") + F.col("fn")).cast("long").alias("support"))


def classification_report(rows: DataFrame, labels: list) -> DataFrame:
    """Precision, recall and F1 of each label, with macro and weighted means; undefined ones count as 0 in the means."""
    per = one_vs_rest(rows, labels).select(F.col("label").cast("string").alias("label"), F.coalesce("ppv", F.lit(0.0)).alias("precision"), F.coalesce("tpr", F.lit(0.0)).alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    n = ("precision", "recall", "f1")
    macro = per.agg(*(F.avg(c).alias(c) for c in n), F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = per.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in n), F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    out = per.unionByName(macro).unionByName(weighted)
    return out.select("label", *(rounded(c).alias(c) for c in n), "support")


def bootstrap(rows: DataFrame, labels: list, draws: int) -> DataFrame:
    """draw, label and measures; truth and prediction of an item are drawn together. rows: item, y_true, y_pred."""
    times = bootstrap_items(rows, draws)
    return one_vs_rest(rows.join(times, "item"), labels, ["draw"], "times")


def bootstrap_measures(rows: DataFrame, labels: list, draws: int = 1000, seed: int = 0) -> DataFrame:
    """label, metric_name, value, bounds, se and p-value of the four measures and the five counts. rows: item, y_true, y_pred."""
    known = rows.where("y_true is not null and y_pred is not null")
    cell = [F.sum(F.when((F.col("y_true") == a) & (F.col("y_pred") == b), 1.0).otherwise(0.0)) for a in labels for b in labels]
    items = known.groupBy("item").agg(F.array(*cell).alias("stats"))
    whole = items.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sums"))
    point, drawn = _measured(whole, labels), _measured(bootstrap_sums(items, draws, seed), labels)
    return intervals(drawn, point, ["label"])


def _measured(sums: DataFrame, labels: list) -> DataFrame:
    """The columns besides sums, label, measures and counts, from sums of cells (truth by prediction)."""
    n = len(labels)
    at = lambda i: F.get("sums", F.lit(i))
    add = lambda cells: reduce(lambda a, b: a + b, map(at, cells), F.lit(0.0))
    each = []
    for k, label in enumerate(labels):
        tp, row, column = at(k * n + k), add(range(k * n, k * n + n)), add(range(k, n * n, n))
        each.append(F.struct(F.lit(label).alias("label"), tp.alias("tp"), (column - tp).alias("fp"), (row - tp).alias("fn"), (add(range(n * n)) - row - column + tp).alias("tn"), row.alias("support")))
    rest = [c for c in sums.columns if c != "sums"]
    out = sums.select(*rest, F.explode(F.array(*each)).alias("c")).select(*rest, "c.*")
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.select(*rest, "label", ratio("tp", "fn").alias("tpr"), ratio("tn", "fp").alias("tnr"), ratio("tp", "fp").alias("ppv"), ratio("tn", "fn").alias("npv"), *COUNTS)
