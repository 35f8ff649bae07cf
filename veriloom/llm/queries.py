"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import ann, bpe, chat, html, langid, media, minhash, packing, quality, suffix
from veriloom.llm.common import fold, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", quality.LEARN_MODULUS) == quality.HELD_OUT).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    predicted = langid.predict(docs, langid.train(docs, path))
    return predicted.select("doc_id", (fold("doc_id", langid.LEARN_MODULUS) == langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid(table(spark, sf_dir, "embeddings"))
    return ann.search(ann.index(vectors), vectors.where(F.col("vec_id") % 20 == 0))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(said.alias("prompt"), said.alias("response"))).alias("record"))
    turns = chat.turns_of_table(table(spark, sf_dir, "conversations")).unionByName(chat.turns_of_json(extra))
    return chat.chat_digest(chat.format_chat(turns))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_columns(table(spark, sf_dir, "documents")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op9_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), path)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_html_extraction, op4_language_id, op5_nearest_neighbours, op6_chat_formatting, op7_media_columns, op8_minhash_dedup, op9_bpe, op10_suffix_dedup)}


OP6_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length('### ' || regexp_replace(role, '[\\:#<]', '\\\0', 'g') || ': ' || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || ' </turn>' || chr(10)) AS k FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(k) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""

OP8_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')] ELSE list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1),
e AS (SELECT doc_id, array_agg(g ORDER BY g) AS gs FROM s GROUP BY 1), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM e)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept, coalesce(m.class_id, d.doc_id) AS class_id FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP10_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i + 100 <= n THEN md5(substr(h, 2 * i + 1, 200)) END AS g FROM (SELECT doc_id, h, n, unnest(range(n)) AS i FROM d)),
f AS (SELECT doc_id, i, b, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT doc_id, i, b, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, CAST(gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS INTEGER) AS starts FROM c),
o AS (SELECT doc_id, sum(gone) AS gone, sum(starts) AS spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM r GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the others rest on models, codecs, vocabularies or an index."""
    return {"op6_chat_formatting": OP6_SQL, "op8_minhash_dedup": OP8_SQL, "op10_suffix_dedup": OP10_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
