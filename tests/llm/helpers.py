"""Small tables for the tests of this folder."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, langs=None, parts=3):
    """A documents table; texts: list, or list of (doc_id, text)."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    langs = langs or ["en"] * len(rows)
    data = [(i, t, g, "s", None if t is None else len(t)) for (i, t), g in zip(rows, langs, strict=True)]
    return spark.createDataFrame(data, DOCS).repartition(parts)


def clashing(df):
    """The table with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("length", "piece", "score", "shingles", "bucket", "node", "doc", "found", "band", "ids", "key", "n", "rank", "signature", "place", "first", "__found", "__doc", "__row", "row", "number", "kept_id", "component", "class_id", "hub", "g", "k", "h", "y")
    return df.withColumns({n: F.lit("x") for n in names})
