"""Descriptive statistics, strata, completeness and reports."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.columns import NOT_ADDRESSED, NOT_SUPPORTED, SUPPORTED, rounded, word_count


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each group; null keys are left out."""
    some = df
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_distinct"))


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """Counts and shares of the non-null values."""
    counts = group_sizes(df, value)
    return counts.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


def describe(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear quartiles."""
    x = F.col(value).cast("double")
    q = F.percentile(x, [0.25, 0.5, 0.75])
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("q"))
    return out.select(*by, "n", rounded("mean").alias("mean"), rounded("std").alias("std"), rounded("min").alias("min"), *(rounded(F.col("q")[i]).alias(f"q{25 * (i + 1)}") for i in range(3)), rounded("max").alias("max"))


def context_lengths(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    return df.groupBy(*by).agg(rounded(F.avg(word_count(text))).alias("mean_words"), rounded(F.avg(F.length(text))).alias("mean_chars"))


def with_stratum(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """A stratum label k=v,k=v; one stratum 'all' without columns. Null values of a stratum column raise at run time."""
    if not columns:
        return df.withColumn("stratum", F.lit("all"))
    value = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in stratum column {c}"))).otherwise(F.col(c).cast("string"))
    return df.withColumn("stratum", F.concat_ws(",", *(F.concat(F.lit(f"{c}="), value(c)) for c in columns)))


def total_and_strata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of all rows together and of each stratum, in one pass."""
    out = df.groupingSets([[], [F.col(c) for c in columns]], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return out.select(*columns, "n", F.when(F.col("g") == 0, "stratum").otherwise("all").alias("scope"))


def parameter_grid(spark, **values: list) -> DataFrame:
    """The cross product of parameter lists."""
    names = list(values)
    return spark.createDataFrame([tuple(r) for r in product(*values.values())], names)


def completeness(rows: DataFrame, grid: DataFrame, keys: list[str], item: str, expected: str = "expected") -> DataFrame:
    """For every grid cell: rows, distinct items, missing ones and a status."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(item).alias("n_items"))
    out = grid.join(found, keys, "left").fillna(0, ["n_rows", "n_items"]).withColumn("missing", F.col(expected) - F.col("n_items"))
    status = F.when(F.col("n_items") == 0, "not started").when(F.col("missing") > 0, "incomplete").when(F.col("missing") < 0, "more than expected").otherwise("complete")
    return out.withColumn("status", status)


def score_report(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Counts and ratios of the three verdicts. An unknown label raises; groups without verdicts have no row."""
    known = F.col("verdict").isin(SUPPORTED, NOT_SUPPORTED, NOT_ADDRESSED)
    checked = verdicts.where(F.col("verdict").isNotNull()).withColumn("verdict", F.when(known, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.col("verdict")))))
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = checked.groupBy(*by).agg(n(SUPPORTED).alias("supported_count"), n(NOT_SUPPORTED).alias("not_supported_count"), n(NOT_ADDRESSED).alias("not_addressed_count"), F.count(F.lit(1)).alias("total_count"))
    return out.withColumns({f"{k}_score": rounded(F.col(f"{k}_count") / F.col("total_count")) for k in ("supported", "not_supported", "not_addressed")})


# The fields of a report's row, in order.
REPORT = ("supported_score", "not_supported_score", "not_addressed_score", "supported_count", "not_supported_count", "not_addressed_count", "total_count", "supported_explanation", "not_supported_explanation", "not_addressed_explanation", "verdicts", "supported", "not_supported", "not_addressed", "proposition_type", "fact_type", "judge_config")


def full_report(verdicts: DataFrame, by: list[str], fields: list[str], explanations: DataFrame | None = None) -> DataFrame:
    """by and the 17 fields of a report. verdicts: by, fields, verdict and, if known, proposition_type, fact_type, judge_config.

    A report holds all of its verdicts, so by must name what is judged together, one subject's statements under one setting."""
    kinds = [c for c in ("proposition_type", "fact_type", "judge_config") if c in verdicts.columns]
    row = F.struct(*fields, "verdict")
    of = lambda v: F.sort_array(F.collect_list(F.when(F.col("verdict") == v, row)))
    whole = verdicts.where("verdict is not null").groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("verdicts"), of(SUPPORTED).alias("supported"), of(NOT_SUPPORTED).alias("not_supported"), of(NOT_ADDRESSED).alias("not_addressed"), *(F.min(c).alias(c) for c in kinds))
    out = score_report(verdicts, by).join(whole, by)
    if explanations is not None:
        wide = explanations.groupBy(*by).pivot("verdict", [SUPPORTED, NOT_SUPPORTED, NOT_ADDRESSED]).agg(F.first("explanation"))
        out = out.join(wide.withColumnsRenamed({SUPPORTED: "supported_explanation", NOT_SUPPORTED: "not_supported_explanation", NOT_ADDRESSED: "not_addressed_explanation"}), by, "left")
    return out.select(*by, *(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in REPORT))


def nested_report(verdicts: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """One row a group with its verdicts as an array of structs; explode_report is the inverse."""
    return verdicts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("verdicts"))


def explode_report(reports: DataFrame, by: list[str]) -> DataFrame:
    return reports.select(*by, F.explode("verdicts").alias("v")).select(*by, "v.*")


def melt_raters(wide: DataFrame, raters: int, keep: list[str]) -> DataFrame:
    """rater_i and verdict_i columns to rows, pairs without a verdict left out."""
    pairs = F.array(*(F.struct(F.col(f"rater{i}").alias("rater"), F.col(f"verdict{i}").alias("verdict")) for i in range(1, raters + 1)))
    return wide.select(*keep, F.inline(pairs)).where("verdict is not null")


def pivot_ratings(ratings: DataFrame, items: list) -> DataFrame:
    """Raters by items, for display; a second value in a cell raises."""
    single = F.when(F.count("value") > 1, F.raise_error(F.lit("two values for one rater and item"))).otherwise(F.max("value"))
    return ratings.groupBy("rater").pivot("item", items).agg(single)


def flag_table(df: DataFrame, flags: list[str], kind: str) -> DataFrame:
    """flag, value of kind, and how many rows have the flag, cells without rows 0; with the share of the kind's rows."""
    long = df.select(kind, F.explode(F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*(F.col(f).cast("int") for f in flags)))).alias("flag", "on"))
    return long.groupBy("flag", kind).agg(F.coalesce(F.sum("on"), F.lit(0)).alias("n"), rounded(F.coalesce(F.avg("on"), F.lit(0.0))).alias("share"))


def best_system(metrics: DataFrame, by: list[str], metric: str, name: str) -> DataFrame:
    """The name with the highest metric of each group; ties to the lesser name."""
    best = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), name) if by else Window.partitionBy(F.lit(0)).orderBy(F.col(metric).desc_nulls_last(), name)
    return metrics.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def result_table(metrics: DataFrame, headers: dict[str, str], where: dict[str, list] | None = None) -> DataFrame:
    """The columns that headers names, in its order and under its titles; where: values to keep by column."""
    for c, values in (where or {}).items():
        metrics = metrics.where(F.col(c).isin(*values))
    return metrics.select(*(F.col(c).alias(title) for c, title in headers.items()))
