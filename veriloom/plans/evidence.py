"""Catalogue: retrieval, fusion, contexts, decomposition, judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import payload
from veriloom.functions.columns import char_span, cosine, rounded, sentences, token_count, verdict_report, words
from veriloom.operators import context, decompose, retrieval
from veriloom.plans import pipelines
from veriloom.plans.registry import Tables, query

# Queries are the vectors whose id is a multiple of 50; every vector of the same label is a fact.
Q = "(SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
DENSE = f"""(SELECT query_id, node_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM (
SELECT q.query_id, e.vec_id AS node_id, list_dot_product(CAST(q.q AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.q AS DOUBLE[]), CAST(q.q AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS score
FROM {Q} q JOIN embeddings e ON q.label = e.label)) WHERE r <= 10)"""
SPARSE = f"""(SELECT query_id, node_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM (
SELECT q.query_id, d.vec_id AS node_id, sum(CAST(q.w AS DOUBLE) * CAST(d.w AS DOUBLE)) AS score FROM
(SELECT vec_id AS query_id, label, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS t FROM embeddings WHERE vec_id % 50 = 0) q
JOIN (SELECT vec_id, label, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS t FROM embeddings) d ON q.label = d.label AND q.t = d.t WHERE q.w > 0 AND d.w > 0 GROUP BY 1, 2)) WHERE r <= 10)"""
LISTS = f"(SELECT query_id, 'dense' AS source, node_id, score FROM {DENSE} UNION ALL SELECT query_id, 'sparse', node_id, score FROM {SPARSE})"


def _queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))


def _facts(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("node_id"), "label", F.col("embedding").alias("v"))


def _dense(t: Tables) -> DataFrame:
    return retrieval.dense_search(_queries(t), _facts(t), 10, ["label"])


def _sparse(t: Tables) -> DataFrame:
    q, d = _queries(t), _facts(t)
    return retrieval.sparse_search(retrieval.vector_postings(q, "query_id", "q", ["label"]), retrieval.vector_postings(d, "node_id", "v", ["label"]), 10, ["label"])


def _lists(t: Tables) -> DataFrame:
    both = [x.withColumn("source", F.lit(s)) for x, s in ((_dense(t), "dense"), (_sparse(t), "sparse"))]
    return both[0].unionByName(both[1]).select("query_id", "source", "node_id", "score")


def _ranked(df: DataFrame, n: int | None = None) -> DataFrame:
    """Scores rounded before ranking, so that engines agree on ties."""
    df = retrieval.top_k(df.select("query_id", "node_id", rounded("score").alias("score")), n or 1 << 30)
    return df.select("query_id", "node_id", "score", "rank")


def _ranked_sql(inner: str, n: int = 1 << 30) -> str:
    return f"SELECT * FROM (SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM (SELECT query_id, node_id, round(score, 9) + 0.0 AS score FROM ({inner}))) WHERE rank <= {n}"


@query(f"SELECT query_id, node_id, round(score, 9) + 0.0 AS score, rank FROM {DENSE}")
def dense_topk(t: Tables) -> DataFrame:
    return _dense(t).withColumn("score", rounded("score"))


@query(f"SELECT query_id, node_id, round(score, 9) + 0.0 AS score, rank FROM {SPARSE}")
def sparse_topk(t: Tables) -> DataFrame:
    return _sparse(t).withColumn("score", rounded("score"))


@query(r"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS token FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS token FROM benchmark),
s AS (SELECT item_id AS query_id, doc_id AS node_id, round(sum(1.0 / (length(token) * length(token))), 9) + 0.0 AS score FROM b JOIN d USING (token) GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def sparse_text_topk(t: Tables) -> DataFrame:
    def postings(df: DataFrame, key: str, node: str) -> DataFrame:
        tokens = df.select(F.col(key).alias(node), F.explode(words("text")).alias("token"))
        return tokens.withColumn("weight", F.lit(1.0) / F.length("token"))

    found = retrieval.sparse_search(postings(t.benchmark, "item_id", "query_id"), postings(t.documents, "doc_id", "node_id"), 1 << 30)
    return _ranked(found, 5)


@query(_ranked_sql(f"SELECT query_id, min(node_id) AS node_id, max(score) AS score FROM (SELECT query_id, node_id, node_id // 3 AS text, score FROM {LISTS}) GROUP BY query_id, text"))
def fusion_simple(t: Tables) -> DataFrame:
    # three vectors in a row share a text
    return _ranked(retrieval.simple_fusion(_lists(t).withColumn("text", F.floor(F.col("node_id") / 3).cast("string"))))


def _relative_sql(low: str, high: str, weight: str = "1.0") -> str:
    return _ranked_sql(f"""SELECT query_id, node_id, sum(x * {weight}) / max(lists) AS score FROM (
SELECT *, CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END AS x, (SELECT count(DISTINCT source) FROM {LISTS}) AS lists FROM (
SELECT *, {low} AS lo, {high} AS hi FROM {LISTS} WINDOW w AS (PARTITION BY query_id, source))) GROUP BY 1, 2""")


MEAN3 = "avg(score) OVER w {} 3 * stddev_pop(score) OVER w"


@query(_relative_sql("min(score) OVER w", "max(score) OVER w"))
def fusion_minmax(t: Tables) -> DataFrame:
    return _ranked(retrieval.relative_score_fusion(_lists(t)))


@query(_relative_sql("min(score) OVER w", "max(score) OVER w", "CASE source WHEN 'dense' THEN 0.75 ELSE 0.25 END"))
def fusion_minmax_weighted(t: Tables) -> DataFrame:
    return _ranked(retrieval.relative_score_fusion(_lists(t), {"dense": 3, "sparse": 1}))


@query(_relative_sql(MEAN3.format("-"), MEAN3.format("+")))
def fusion_dbsf(t: Tables) -> DataFrame:
    return _ranked(retrieval.distribution_based_score_fusion(_lists(t)))


@query(_ranked_sql(f"SELECT query_id, node_id, sum(1.0 / (r - 1 + 60)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, node_id) AS r FROM {LISTS}) GROUP BY 1, 2"))
def fusion_rrf(t: Tables) -> DataFrame:
    return _ranked(retrieval.reciprocal_rank_fusion(_lists(t)))


@query(f"SELECT * FROM ({_relative_sql(MEAN3.format('-'), MEAN3.format('+'))}) WHERE rank <= 10")
def hybrid_retrieval(t: Tables) -> DataFrame:
    """Dense and sparse top-k, distribution-based fusion, top-n: the flagship."""
    return _ranked(retrieval.retrieve(_queries(t), _facts(t), "hybrid", 10, ["label"]).select("query_id", "node_id", "score"), 10)


SCALED = "(SELECT query_id, node_id, score, CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END AS scaled FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {}))"


@query(f"""SELECT f.query_id, f.node_id, round(d.score, 9) + 0.0 AS dense_score, round(d.scaled, 6) + 0.0 AS dense_normalized_score, round(s.score, 9) + 0.0 AS sparse_score, round(s.scaled, 6) + 0.0 AS sparse_normalized_score, round(u.score, 6) + 0.0 AS fusion_score
FROM (SELECT DISTINCT query_id, node_id FROM {LISTS}) f LEFT JOIN {SCALED.format(DENSE)} d USING (query_id, node_id) LEFT JOIN {SCALED.format(SPARSE)} s USING (query_id, node_id)
JOIN ({_relative_sql(MEAN3.format('-'), MEAN3.format('+'))}) u USING (query_id, node_id)""")
def score_provenance(t: Tables) -> DataFrame:
    lists = _lists(t)
    out = retrieval.provenance(lists, retrieval.fuse(lists))
    return out.select("query_id", "node_id", *(rounded(f"{s}_{c}", d).alias(f"{s}_{c}") for s in ("dense", "sparse") for c, d in (("score", 9), ("normalized_score", 6))), rounded(rounded("fusion_score"), 6).alias("fusion_score"))


@query("SELECT lang AS query_id, doc_id AS node_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_text_keep_best(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("node_id"), "text", F.col("n_chars").cast("double").alias("score"))
    return retrieval.dedup_text(rows).select("query_id", "node_id")


class WordShare:
    """Shared numbers over wanted numbers of texts that list numbers: a stand-in for a cross-encoder."""

    def score(self, query, text):
        return [len(set(q.split()) & set(x.split())) / len(set(q.split())) for q, x in zip(query, text, strict=True)]


@query(f"""WITH top AS (SELECT query_id, node_id, list_sort(list_distinct(list_transform(list_filter(range(64), lambda i: q.embedding[i + 1] > 0.1), lambda i: i))) AS a, list_filter(range(64), lambda i: e.embedding[i + 1] > 0.1) AS b
FROM {DENSE} d JOIN embeddings q ON q.vec_id = d.query_id JOIN embeddings e ON e.vec_id = d.node_id)
SELECT * FROM (SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM (SELECT query_id, node_id, round(len(list_intersect(a, b)) * 1.0 / len(a), 9) + 0.0 AS score FROM top)) WHERE rank <= 5""")
def rerank_topn(t: Tables) -> DataFrame:
    marks = lambda c: F.concat_ws(" ", F.filter(F.transform(F.col(c), lambda x, i: F.when(x > 0.1, i.cast("string"))), lambda s: s.isNotNull()))
    rows = _dense(t).drop("rank").join(_queries(t).select("query_id", marks("q").alias("query")), "query_id").join(_facts(t).select("node_id", marks("v").alias("text")), "node_id")
    return _ranked(retrieval.rerank(rows, 5, WordShare()))


# ------------------------------------------------------------------ contexts over user timelines


def _timeline(t: Tables) -> DataFrame:
    span = Window.partitionBy("user_id")
    return t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("node_id"), F.col("value").alias("score"), F.col("ts").alias("at"), F.col("event_type").alias("category"), F.lit("event").alias("description"), F.col("props").alias("text"), F.min("ts").over(span).alias("admit"), F.max("ts").over(span).alias("end"))


@query("""SELECT user_id AS query_id, string_agg(r || '. Score: ' || printf('%.3f', coalesce(value, 0)) || ', Category: ' || event_type || ', Description: event | ' || props, chr(10) ORDER BY r) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id) AS r FROM events) GROUP BY 1""")
def context_by_score(t: Tables) -> DataFrame:
    return context.by_score(_timeline(t))


@query("""SELECT user_id AS query_id, 'Admission: ' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || chr(10) || string_agg(r || '. ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' | ' || props, chr(10) ORDER BY r) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1""")
def context_by_absolute_time(t: Tables) -> DataFrame:
    return context.by_absolute_time(_timeline(t))


@query("""SELECT user_id AS query_id, string_agg(r || '. ' || CAST(floor(s / 86400) AS BIGINT) || ' days ' || CAST(floor((s % 86400) / 3600) AS BIGINT) || ' hours before the end, ' || event_type || ' | ' || props, chr(10) ORDER BY r) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CAST(floor(epoch(max(ts) OVER (PARTITION BY user_id))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) GROUP BY 1""")
def context_by_relative_time(t: Tables) -> DataFrame:
    return context.by_relative_time(_timeline(t))


# ------------------------------------------------------------------ embeddings


@query("SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 9) + 0.0 AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def embedding_mean_dense(t: Tables) -> DataFrame:
    means = retrieval.mean_dense(_facts(t), ["label"])
    return means.select("label", F.transform("mean", lambda x: rounded(x)).alias("mean"))


@query(r"SELECT lang, token, round(avg(1.0 / length(token)), 9) + 0.0 AS mean, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS token FROM documents) GROUP BY 1, 2")
def embedding_mean_sparse(t: Tables) -> DataFrame:
    maps = t.documents.select("lang", F.map_from_entries(F.transform(words("text"), lambda w: F.struct(w, F.lit(1.0) / F.length(w)))).alias("weights"))
    means = retrieval.mean_sparse(maps, ["lang"])
    counts = maps.select("lang", F.explode("weights").alias("token", "w")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return means.join(counts, ["lang", "token"]).select("lang", "token", rounded("mean").alias("mean"), "n")


# ------------------------------------------------------------------ decomposition


#: Turns in order, ties by role and text, nulls as empty.
TURNS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations))"


def _turns(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))


@query(f"SELECT conv_id, r, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS window_text FROM {TURNS}")
def sentence_windows(t: Tables) -> DataFrame:
    return decompose.sentence_windows(_turns(t), "conv_id", "r", "text").select("conv_id", "r", "window_text")


DISTANCES = """SELECT label, vec_id, d AS distance, quantile_cont(d, 0.9) OVER (PARTITION BY label) AS threshold FROM (SELECT label, vec_id, 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS d FROM
(SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings))"""
CHUNKED = f"SELECT *, CAST(coalesce(sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM ({DISTANCES})"


def _chunked(t: Tables) -> DataFrame:
    return decompose.breakpoints(t.embeddings, "label", "vec_id", "embedding")


@query(f"SELECT label, vec_id, round(distance, 9) + 0.0 AS distance, round(threshold, 9) + 0.0 AS threshold, chunk FROM ({CHUNKED})")
def semantic_breakpoints(t: Tables) -> DataFrame:
    return _chunked(t).select("label", "vec_id", rounded("distance").alias("distance"), rounded("threshold").alias("threshold"), "chunk")


@query(f"SELECT label, chunk, string_agg(CAST(vec_id AS VARCHAR) || ';', '' ORDER BY vec_id) AS chunk_text, count(*) AS n_rows FROM ({CHUNKED}) GROUP BY 1, 2")
def semantic_chunks_one_pass(t: Tables) -> DataFrame:
    rows = _chunked(t).withColumn("text", F.concat(F.col("vec_id").cast("string"), F.lit(";")))
    return decompose.chunks(rows, "label", "vec_id", "text")


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, s AS sentence, CAST(len(regexp_extract_all(s, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS n_tokens FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM
(SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS p FROM documents))""")
def sentence_split(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.posexplode(sentences("text")).alias("idx", "sentence"))
    return parts.select("doc_id", "idx", "sentence", F.regexp_count("sentence", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("long").alias("n_tokens"))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, strpos(text, s) - 1 AS start_idx, strpos(text, s) - 1 + length(s) AS end_idx FROM (SELECT doc_id, text, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)) WHERE length(s) > 0""")
def child_spans(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("idx", "s")).where("length(s) > 0")
    start, end = char_span("text", "s")
    return rows.select("doc_id", "idx", start.alias("start_idx"), end.alias("end_idx"))


@query(r"""WITH s AS (SELECT doc_id, text AS parent, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])(\s+)', '\1\2' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS p FROM documents)),
n AS (SELECT *, regexp_replace(md5(text || '-' || doc_id || '-' || i), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id FROM s)
SELECT doc_id AS source_document_id, CAST(i AS INTEGER) AS node_monotonic_idx, text, strpos(parent, text) - 1 AS start_char_idx, strpos(parent, text) - 1 + length(text) AS end_char_idx, id AS node_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, length(text) AS num_characters,
CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS num_tokens FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def sentence_node_links(t: Tables) -> DataFrame:
    return decompose.sentence_nodes(t.documents, "doc_id", "text")


@query(None)
def semantic_chunks_recursive(t: Tables) -> DataFrame:
    return decompose.semantic_chunks(t.documents, "doc_id", "text")


@query(r"""SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS claim_idx, unnest(c) AS claim FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, ';|, and '), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(regexp_extract_all(lower(s), '[\p{L}\p{N}]+')) >= 3) AS c FROM documents)""")
def claims_extract(t: Tables) -> DataFrame:
    return decompose.claims(t.documents, "doc_id", "text")


JUDGED = r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS token, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS n FROM benchmark),
s AS (SELECT item_id, n, doc_id, count(*) AS k FROM b JOIN (SELECT doc_id, unnest(w) AS token FROM d) USING (token) GROUP BY 1, 2, 3),
j AS (SELECT item_id, doc_id, k / n AS share, CASE WHEN k / n >= 0.8 THEN 'Supported' WHEN k / n <= 0.3 THEN 'Not Addressed' ELSE 'Not Supported' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, doc_id) AS r FROM s) WHERE r = 1)
"""


def _judged(t: Tables) -> DataFrame:
    """Each benchmark text judged against the document that shares most of its words."""
    q = t.benchmark.select("item_id", "text", F.explode(words("text")).alias("token"))
    d = t.documents.select("doc_id", F.explode(words("text")).alias("token"))
    shared = q.join(d, "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    best = retrieval.top_k(shared, 1, ["item_id"], "doc_id", "k")
    pairs = best.join(t.benchmark, "item_id").join(t.documents.select("doc_id", F.col("text").alias("reference")), "doc_id")
    return decompose.judge(pairs, "text", "reference")


@query(JUDGED + "SELECT item_id, doc_id, verdict FROM j")
def judge_verdicts(t: Tables) -> DataFrame:
    return _judged(t).select("item_id", "doc_id", "verdict")


@query(JUDGED + """SELECT item_id, doc_id, 'Verdict: ' || verdict || chr(10) || 'Reason: ' || printf('%.3f', share) || ' of the words occur in the reference' || chr(10) || 'Text: ' || b.text || chr(10) || 'Reference: ' || chr(10) || d.text AS report
FROM j JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)""")
def verdict_reports(t: Tables) -> DataFrame:
    return _judged(t).select("item_id", "doc_id", verdict_report("verdict", "reason", "text", "reference").alias("report"))


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents),
f AS (SELECT doc_id, coalesce(list_contains(string_split('add ask avoid call check continue do follow give go keep let make monitor note please see start stop take use', ' '), x[1]), false) AS imperative, ends_with(rtrim(text), '?') AS interrogative, len(x) < 3 AS incomplete,
coalesce(list_contains(string_split('it they this that he she these those', ' '), x[1]), false) AS vague, len(x) = 0 AS empty FROM w)
SELECT *, imperative OR interrogative OR incomplete OR vague AS invalid FROM f""")
def validity_checks(t: Tables) -> DataFrame:
    return decompose.validity_flags(t.documents, "text").select("doc_id", "invalid", "imperative", "interrogative", "incomplete", "vague", "empty")


@query(f"""WITH RECURSIVE s AS (SELECT conv_id, r, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS BIGINT) AS size FROM {TURNS}),
p AS (SELECT conv_id, r, size, CAST(0 AS BIGINT) AS pack, size AS used FROM s WHERE r = 1 UNION ALL
SELECT s.conv_id, s.r, s.size, CASE WHEN p.used = 0 OR p.used + s.size <= 200 THEN p.pack ELSE p.pack + 1 END, CASE WHEN p.used = 0 OR p.used + s.size <= 200 THEN p.used + s.size ELSE s.size END FROM p JOIN s ON s.conv_id = p.conv_id AND s.r = p.r + 1)
SELECT conv_id, r, size, pack FROM p""")
def repack_chunks(t: Tables) -> DataFrame:
    from veriloom.functions.columns import word_count

    return decompose.repacked(_turns(t).withColumn("size", word_count("text")), "conv_id", "r", "size", 200)


@query(None)
def iterative_writing(t: Tables) -> DataFrame:
    return decompose.written(_turns(t), "conv_id", "r", "text", 60)


@query(None)
def course_writing(t: Tables) -> DataFrame:
    """Turns summed up, packed, combined and folded into one text a conversation."""
    return decompose.course(_turns(t), "conv_id", "r", "text", 60, 200)


@query(None)
def verdict_explanations(t: Tables) -> DataFrame:
    """Reasons of the verdicts of each document against its own first line, summed up by language and verdict."""
    told = decompose.judge(t.documents.withColumn("reference", F.substring_index("text", "\n", 1)), "text", "reference")
    return decompose.explained(told, ["lang"])


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS i, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1),
g AS (SELECT doc_id, unnest(range(64)) AS i FROM documents), v AS (SELECT g.doc_id, g.i, round(coalesce(n / l, 0), 9) + 0.0 AS x FROM g LEFT JOIN c USING (doc_id, i) LEFT JOIN l USING (doc_id)),
s AS (SELECT doc_id, count(DISTINCT w) AS n_tokens, round(sum(DISTINCT_W), 9) + 0.0 AS weight FROM (SELECT doc_id, w, 1.0 / length(w) AS DISTINCT_W FROM w GROUP BY ALL) GROUP BY 1)
SELECT doc_id, list(x ORDER BY i) AS dense, coalesce(max(n_tokens), 0) AS n_tokens, coalesce(max(weight), 0.0) AS weight FROM v LEFT JOIN s USING (doc_id) GROUP BY 1""")
def embed_documents(t: Tables) -> DataFrame:
    """Dense vectors of whole texts; of the sparse ones how many tokens they have and their weights together."""
    out = decompose.embed(t.documents.select("doc_id", "text"), "text")
    weight = F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda s, x: s + x)
    return out.select("doc_id", F.transform("dense", lambda x: rounded(x)).alias("dense"), F.size("sparse").cast("long").alias("n_tokens"), rounded(weight).alias("weight"))


def _asked_and_facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as statements, documents as facts, with dense vectors."""
    facts = decompose.embed(t.documents.select("doc_id", "lang", "text"), "text", sparse=False).select(F.col("doc_id").alias("node_id"), F.col("dense").alias("v"), "text", F.col("lang").alias("category"), F.lit("document").alias("description"))
    return decompose.embed(t.benchmark, "text", sparse=False).select(F.col("item_id").alias("query_id"), F.col("dense").alias("q"), F.col("text").alias("query")), facts


@query(None)
def verify_propositions(t: Tables) -> DataFrame:
    """The whole run: embed, retrieve among all documents, format, judge."""
    return pipelines.evaluate(*_asked_and_facts(t), ["rerank"], [5], ["score"], []).drop("rater")


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.m AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(b.m, b.m))), 6) + 0.0 AS score FROM embeddings a JOIN (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) b USING (label)")
def centroid_cosine(t: Tables) -> DataFrame:
    means = retrieval.mean_dense(_facts(t), ["label"])
    return t.embeddings.join(means, "label").select("vec_id", rounded(cosine("embedding", "mean"), 6).alias("score"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS n_tokens FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", token_count("text").alias("n_tokens"))


# ------------------------------------------------------------------ shapes of nodes


def _nodes(t: Tables) -> DataFrame:
    """Documents as nodes with metadata; half of them with a category."""
    pairs = {"node_kind": F.lit("document"), "source_document_id": F.col("doc_id").cast("string"), "SUBJECT_ID": (F.col("doc_id") % 100).cast("string"), "HADM_ID": F.col("n_chars").cast("string"), "CHARTDATE": F.lit("2020-01-02 03:04:05"), "num_characters": F.col("n_chars").cast("string"), "CATEGORY": F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "source": F.col("source")}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items())), lambda e: e["value"].isNotNull())
    return t.documents.select(F.col("doc_id").cast("string").alias("node_id"), "text", F.map_from_entries(entries).alias("metadata"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") / 8.0).alias("score"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS node_id, 'document' AS node_kind, text AS "TEXT", CAST(doc_id AS VARCHAR) AS source_document_id, CAST(n_chars AS BIGINT) AS num_characters, CAST(doc_id % 100 AS BIGINT) AS "SUBJECT_ID", CAST(n_chars AS DOUBLE) AS "HADM_ID", TIMESTAMP '2020-01-02 03:04:05' AS "CHARTDATE", CASE WHEN doc_id % 2 = 0 THEN lang END AS "CATEGORY", CASE WHEN doc_id % 3 > 0 THEN doc_id / 8.0 ELSE 0.0 END AS score, 26 AS n_columns FROM documents""")
def flat_nodes(t: Tables) -> DataFrame:
    flat = payload.flat_nodes(_nodes(t))
    return flat.select("node_id", "node_kind", "TEXT", "source_document_id", "num_characters", "SUBJECT_ID", "HADM_ID", "CHARTDATE", "CATEGORY", "score", F.lit(len(flat.columns)).alias("n_columns"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS proposition_id, text, CAST(NULL AS VARCHAR) AS parent_text_chunk, CAST(doc_id % 100 AS BIGINT) AS subject_id, CAST(NULL AS BIGINT) AS row_id, CAST(n_chars AS DOUBLE) AS hadm_id FROM documents""")
def proposition_rows(t: Tables) -> DataFrame:
    return payload.propositions(payload.flat_nodes(_nodes(t)))


LINES = "CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN 'CATEGORY: ' || lang || chr(10) ELSE '' END || 'CHARTDATE: 2020-01-02 03:04:05' || chr(10) || 'HADM_ID: ' || n_chars || chr(10) || 'SUBJECT_ID: ' || doc_id % 100 || chr(10) || 'node_kind: document' || chr(10) || 'num_characters: ' || n_chars || chr(10) || 'source: ' || source || chr(10) || 'source_document_id: ' || doc_id"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS node_id, text, {LINES} AS lines FROM documents")
def payload_round_trip(t: Tables) -> DataFrame:
    """Nodes to payloads and back, their metadata shown as lines."""
    return payload.from_payload(payload.to_payload(_nodes(t))).select("node_id", "text", payload.metadata_text("metadata").alias("lines"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS node_id, {LINES} || chr(10) || chr(10) || text AS shown, CAST(doc_id AS VARCHAR) AS ref_doc_id FROM documents")
def metadata_round_trip(t: Tables) -> DataFrame:
    """Nodes to metadata maps and back, shown as a model would read them."""
    maps = payload.to_metadata(_nodes(t))
    back = payload.from_metadata(maps).select("node_id", payload.node_text("metadata", "text").alias("shown"))
    return back.join(maps.select("node_id", F.element_at("metadata", F.lit("ref_doc_id")).alias("ref_doc_id")), "node_id")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_in_words(t: Tables) -> DataFrame:
    """Objects that stand between other words, as models answer."""
    said = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Anything else?"))
    return t.events.select("event_id", payload.json_object(said, "k long")["k"].alias("k"))


# ------------------------------------------------------------------ whole runs


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 5 OFFSET 2")
def scroll_page(t: Tables) -> DataFrame:
    """A page of a filtered scan, as the scroll operator gives it."""
    return pipelines.scroll(t.documents.select("doc_id", "lang", "source"), F.col("source") == "src3", "doc_id", 5, 2).select("doc_id", "lang")


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(text, 'License') GROUP BY 1")
def filtered_counts(t: Tables) -> DataFrame:
    return pipelines.scroll(t.documents, F.col("text").contains("License")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, coalesce(strftime(ts, '%Y-%m-%d'), 'Unknown') || ' ' || coalesce(strftime(ts, '%H:%M:%S'), 'Unknown') || ', ' || event_type || ': ' || props AS line FROM events")
def note_headers(t: Tables) -> DataFrame:
    part = lambda f: F.coalesce(F.date_format("ts", f), F.lit("Unknown"))
    return t.events.select("event_id", F.concat(part("yyyy-MM-dd"), F.lit(" "), part("HH:mm:ss"), F.lit(", "), "event_type", F.lit(": "), "props").alias("line"))


@query(None)
def ingest_nodes(t: Tables) -> DataFrame:
    return pipelines.build_nodes(t.documents, "doc_id", "text").drop("dense", "sparse")


@query(None)
def evaluation_grid(t: Tables) -> DataFrame:
    """All four methods at two sizes, a part of the 192 settings; texts are embedded and searched once for all."""
    return pipelines.reports(pipelines.evaluate(*_asked_and_facts(t), ["dense", "sparse", "hybrid", "rerank"], [5, 10], ["score"], []))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(t: Tables) -> DataFrame:
    """The windowed counts of the event table read as a stream until it is drained."""
    from veriloom.streaming.ingest import drained, stream_files, windowed_counts

    # a watermark needs instants: the table's local times are read as UTC, and windows written as they were
    instants = F.expr("cast(convert_timezone('UTC', current_timezone(), cast(ts AS timestamp_ntz)) AS timestamp)")
    events = stream_files(t.spark, t.folder, t.events.schema, "events.parquet").withColumn("ts", instants)
    local = F.expr("convert_timezone(current_timezone(), 'UTC', cast(start AS timestamp_ntz))")
    return drained(windowed_counts(events).withColumn("start", local))
