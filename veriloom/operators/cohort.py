"""Cohorts from record tables: versions, last admissions, minimum counts, semi- and anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_errors(notes: DataFrame, flag: str = "iserror") -> DataFrame:
    """Rows whose flag isn't 1; null flags stay."""
    return notes.where(~F.col(flag).eqNullSafe(1.0))


def any_null(columns: list[str]):
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def latest_version(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each natural key; rows with a null in the key stand for themselves."""
    last = Window.partitionBy(*keys).orderBy(*order)
    whole = rows.where(~any_null(keys)).withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    return whole.unionByName(rows.where(any_null(keys)))


def last_per_group(rows: DataFrame, group: str, order: list) -> DataFrame:
    last = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def with_minimum(notes: DataFrame, last: DataFrame, group: str, at: str, end: str, least: int, category: tuple[str, str] | None = None) -> DataFrame:
    """Groups with so many notes (of a category) up to their last date."""
    joined = notes.join(last.select(group, end), group).where(F.col(at) <= F.col(end))
    if category:
        joined = joined.where(F.col(category[0]) == category[1])
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if a.select(key).join(b.select(key), key, "left_semi").limit(1).count():
        raise AssertionError(f"{key} occurs on both sides")
