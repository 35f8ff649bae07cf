"""Reference contexts: the retrieved facts of a query as one text, by score or by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "No reference facts were found."


def _numbered(rows: DataFrame, order: list[Column], line: Column, header: Column | None = None) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(*order)
    lines = rows.withColumn("__i", F.row_number().over(place)).withColumn("__line", F.concat(F.col("__i").cast("string"), F.lit(". "), line))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__line"))), lambda e: e["__line"]), "\n")
    if header is not None:
        return lines.withColumn("__head", header).groupBy("query_id").agg(F.concat(F.min("__head"), F.lit("\n"), joined).alias("context"))
    return lines.groupBy("query_id").agg(joined.alias("context"))


def _text(c: str, missing: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def by_score(rows: DataFrame) -> DataFrame:
    """rows: query_id, node_id, score, category, description, text."""
    head = F.format_string("Score: %.3f", F.coalesce(F.col("score"), F.lit(0.0)))
    line = F.concat(head, F.lit(", Category: "), _text("category"), F.lit(", Description: "), _text("description"), F.lit(" | "), _text("text"))
    return _numbered(rows, [F.coalesce("score", F.lit(0.0)).desc(), F.col("node_id")], line)


def _timed() -> list[Column]:
    return [F.col("at").asc_nulls_last(), F.col("node_id")]


def by_absolute_time(rows: DataFrame) -> DataFrame:
    """rows: query_id, node_id, at, admit, category, text; headed by the admission."""
    line = F.concat(F.coalesce(F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("unknown time")), F.lit(" "), _text("category"), F.lit(" | "), _text("text"))
    header = F.concat(F.lit("Admission: "), F.coalesce(F.date_format("admit", "yyyy-MM-dd HH:mm:ss"), F.lit("unknown")))
    return _numbered(rows, _timed(), line, header)


def by_relative_time(rows: DataFrame) -> DataFrame:
    """rows as before with the admission's end: days and hours before it."""
    seconds = F.unix_timestamp("end") - F.unix_timestamp("at")
    days, hours = F.floor(seconds / 86400), F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    before = F.concat(days.cast("string"), F.lit(" days "), hours.cast("string"), F.lit(" hours before the end"))
    line = F.concat(F.coalesce(before, F.lit("unknown time")), F.lit(", "), _text("category"), F.lit(" | "), _text("text"))
    return _numbered(rows, _timed(), line)


FORMATS = {"score": by_score, "absolute_time": by_absolute_time, "relative_time": by_relative_time}


def contexts(queries: DataFrame, rows: DataFrame, form: str = "score") -> DataFrame:
    """A context for every query; a fixed sentence where nothing was found."""
    return queries.select("query_id").join(FORMATS[form](rows), "query_id", "left").withColumn("context", F.coalesce("context", F.lit(EMPTY)))
