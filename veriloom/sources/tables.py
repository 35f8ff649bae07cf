"""Reading and writing tables: by file suffix, with fixed types, notes, upserts and partitioned metrics."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.columns import content_uuid, node_digest, token_count

L, S, D, B, I, TS = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


NOTES = fields(row_id=L, subject_id=L, hadm_id=L, chartdate=TS, charttime=TS, storetime=TS, category=S, description=S, cgid=L, iserror=D, text=S)
ADMISSIONS = fields(row_id=L, subject_id=L, hadm_id=L, admittime=TS, dischtime=TS, ethnicity=S, diagnosis=S, hospital_expire_flag=B)
PATIENTS = fields(subject_id=L, gender=S, dob=TS)
PROPOSITIONS = fields(proposition_id=S, text=S, parent_text_chunk=S, subject_id=L, row_id=L, hadm_id=L, author_type=S, proposition_type=S, brief_hospital_course=S)
VERDICTS = fields(proposition_id=S, model=S, rater_name=S, filename=S, subject_id=L, author_type=S, proposition_type=S, fact_type=S, retrieval_method=S, top_n=L, reference_format=S, reference_only_admission=B, deduplicate_text=B, verdict=S, reason=S, reasoning_chain=S, reasoning_final_answer=S, text=S, reference=S)


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV (also gzipped), JSON lines, ORC, text, feather or Excel, by suffix. ValueError for others.

    Feather and Excel go through the driver: they are small result files.
    """
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        reader = spark.read.options(header=True, multiLine=True, escape='"', quote='"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if name.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if name.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if name.endswith(".orc"):
        return spark.read.orc(path)
    if name.endswith(".txt"):
        return spark.read.text(path, wholetext=True)
    if name.endswith(".feather"):
        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(path))
    if name.endswith((".xlsx", ".xlsm")):
        import pandas

        return spark.createDataFrame(pandas.read_excel(path))
    if name.endswith((".pkl", ".pickle")):  # a pickle runs code: read only what you wrote
        import pandas

        return spark.createDataFrame(pandas.read_pickle(path))
    raise ValueError(f"no reader for {os.path.basename(path)}")


def write_any(df: DataFrame, path: str) -> None:
    """The counterpart of read_any; feather, Excel and pickle go through the driver. Text is the one column of the frame, a value a line."""
    name, writer = path.rstrip("/").lower(), df.write.mode("overwrite")
    if name.endswith((".csv", ".csv.gz")):
        writer.options(header=True, escape='"', compression="gzip" if name.endswith(".gz") else "none").csv(path)
    elif name.endswith(".parquet"):
        writer.parquet(path)
    elif name.endswith((".json", ".jsonl")):
        writer.json(path)
    elif name.endswith(".orc"):
        writer.orc(path)
    elif name.endswith(".txt"):
        writer.text(path)
    elif name.endswith((".xlsx", ".xlsm", ".pkl", ".pickle")):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        frame = df.toPandas()
        if name.endswith((".pkl", ".pickle")):
            frame.to_pickle(path)
        else:
            frame.to_excel(path, index=False)
    elif name.endswith(".feather"):
        import pyarrow.feather

        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        pyarrow.feather.write_feather(df.toArrow(), path)
    else:
        raise ValueError(f"no writer for {os.path.basename(path)}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts the columns that the schema names, whichever of them are there; others stay. NaN becomes null."""
    have = {f.name: f.dataType for f in df.schema}
    changes = {}
    for f in schema:
        if f.name in have:
            c = F.col(f.name)
            if isinstance(have[f.name], (T.DoubleType, T.FloatType)):
                c = F.when(~F.isnan(c), c)
            changes[f.name] = c.cast(f.dataType)
    return df.withColumns(changes) if changes else df


def note_nodes(notes: DataFrame, group: str = "hadm_id", order: tuple[str, ...] = ("chartdate", "charttime", "storetime", "row_id"), text: str = "text") -> DataFrame:
    """Notes as linked nodes: index within the admission, ids of neighbours, sizes. Notes without an admission are left out."""
    by = Window.partitionBy(group).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    nodes = notes.where(F.col(group).isNotNull()).withColumn("node_id", content_uuid(text, *(c for c in ("subject_id", "row_id") if c in notes.columns)))
    nodes = nodes.withColumn("node_monotonic_idx", (F.row_number().over(by) - 1).cast("int"))
    nodes = nodes.withColumns({"prev_id": F.lag("node_id").over(by), "next_id": F.lead("node_id").over(by)})
    return nodes.withColumns({"num_characters": F.length(text).cast("long"), "num_tokens": token_count(text), "row_hash": node_digest(group, text)})


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "node_id", version: str | None = None) -> DataFrame:
    """Keep-last union by key: new rows win over existing ones, of several new ones the highest version, then the greatest hash of all columns."""
    content = F.xxhash64(*(F.col(f"`{f.name}`") if not isinstance(f.dataType, T.MapType) else F.to_json(f"`{f.name}`") for f in new.schema))
    last = Window.partitionBy(key).orderBy(*([F.col(version).desc_nulls_last()] if version else []), content.desc())
    new = new.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    if existing is None:
        return new
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(facts: DataFrame, ids: DataFrame, key: str = "source_document_id") -> DataFrame:
    return facts.join(ids.select(key).distinct(), key, "left_anti")


def not_yet_done(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: what no finished row has the keys of."""
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti")


def ensure_table(df: DataFrame, name: str, partition_by: list[str] = ()) -> list[str]:
    """Creates an empty table of the frame's schema unless it is there, partitioned by what is filtered by. Of a table that is
    there, columns that it lacks are added, and a column of another type raises ValueError. Returns the columns added."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.limit(0).write.partitionBy(*partition_by).saveAsTable(name)
        return []
    have = {f.name.lower(): f.dataType for f in spark.table(name).schema}
    if wrong := [f.name for f in df.schema if f.name.lower() in have and have[f.name.lower()] != f.dataType]:
        raise ValueError(f"{name} has other types of {wrong}")
    new = [f for f in df.schema if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    return [f.name for f in new]


def save_metrics(df: DataFrame, path: str) -> None:
    """The metrics by stratum, and beside them all in one table."""
    df.write.mode("overwrite").partitionBy("stratum").parquet(f"{path}/metrics")
    df.write.mode("overwrite").parquet(f"{path}/all")


def load_metrics(spark: SparkSession, path: str, strata: list[str] | None = None) -> DataFrame:
    """The metrics of the strata asked for (all, if none): from the folders by stratum, and where these can't be read or lack one, from the whole table. FileNotFoundError if neither is there."""

    def kept(df: DataFrame) -> DataFrame:
        return df.withColumn("stratum", F.col("stratum").cast("string")).where(F.col("stratum").isin(strata) if strata else F.lit(True))

    def complete(df: DataFrame) -> bool:
        return not strata or {r["stratum"] for r in df.select("stratum").distinct().collect()} >= set(strata)

    for part in ("metrics", "all"):
        try:
            df = kept(spark.read.parquet(f"{path}/{part}"))
        except AnalysisException:
            continue
        if part == "all" or complete(df):
            return df
    raise FileNotFoundError(f"no metrics in {path}")


def gather_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a folder, one file a report, with the config in the file's name as a map."""
    df = spark.read.parquet(path).withColumn("filename", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1))
    return df.withColumn("config", F.str_to_map(F.regexp_replace("filename", r"\.[a-z]+$", ""), F.lit(","), F.lit("=")))


def tagged_union(frames: dict[str, DataFrame], tag: str = "model") -> DataFrame:
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9=,_.-]", "_", text)
