"""A corpus from raw documents to packed sequences: five stages, each an operator of veriloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, and what one stage drops or cuts the next never sees.

1. language ID drops texts without a letter or without a likely language (posterior below LEAST_LANGUAGE);
2. the quality classifier, learnt from labels, drops the texts it decides are bad (scored below quality.DECISION);
3. MinHash keeps one document, the least id, of each group of near copies;
4. suffix sorting cuts out every passage of 100 bytes or more that also starts earlier;
5. best-fit packing turns what is left into sequences of at most 2048 tokens.

Null and empty texts go in stage 1; rows that share an id or have none are documents of their own, those
of one id in a fixed order and those of none last; an empty table gives no rows; extra columns are kept up to stage 4.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import langid, minhash, packing, quality, suffix
from veriloom.llm.common import checkpointed, shared_folder, table, unused

LEAST_LANGUAGE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.keep(docs, model, LEAST_LANGUAGE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")), quality.DECISION)


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that no two rows share: doc_id, or, where ids are null or come twice, numbers in order of id and content."""
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        return docs, "doc_id"
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64(rest))
    row = unused(docs, "row")
    return checkpointed(ordered.withColumn(row, F.monotonically_increasing_id())), row


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = told_apart(docs)
    kept = minhash.near_duplicates(rows, key).where("kept").select(F.col("doc_id").alias("kept_id"))
    return rows.join(kept, rows[key] == kept["kept_id"], "left_semi").select(docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = told_apart(docs)
    return suffix.without_repeats(rows, key).select(docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: Models and hashes stand between the tables and the rows, so SQL has no say; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return docs


def removed(spark: SparkSession, folder: str) -> None:
    """What one stage wrote, once the next has read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
