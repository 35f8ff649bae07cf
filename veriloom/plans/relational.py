"""Catalogue: scans, filters, joins, set operations, statistics, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.columns import age_years, any_columns, config_map, config_string, content_uuid, day_window, node_digest, prefix_buckets, rater_name, rounded, text_match, title_case, whole_days, word_count
from veriloom.operators import cohort, retrieval, stats
from veriloom.plans.registry import Tables, query
from veriloom.sources.tables import not_yet_done, tagged_union, upsert

# ------------------------------------------------------------------ scans and filters


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_quantity < 20 AND l_discount <= 0.05 AND l_extendedprice > 1000 AND l_tax >= 0.02""")
def scan_filter_project(t: Tables) -> DataFrame:
    where = retrieval.build_filter(must=[("l_returnflag", "==", "R"), ("l_linestatus", "!=", "O"), ("l_quantity", "<", 20), ("l_discount", "<=", 0.05), ("l_extendedprice", ">", 1000), ("l_tax", ">=", 0.02)])
    return t.lineitem.where(where).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_totalprice > 50000 AND (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT o_custkey < 20""")
def filter_merged(t: Tables) -> DataFrame:
    f = retrieval.merge_filters({"must": [("o_totalprice", ">", 50000)]}, {"should": [("o_orderstatus", "==", "F")]}, {"should": [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])], "must_not": [("o_custkey", "<", 20)]})
    return t.orders.where(retrieval.build_filter(**f)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


WIDE = """SELECT l_orderkey AS item, max(CASE WHEN l_linenumber = 1 THEN v END) AS v1, max(CASE WHEN l_linenumber = 2 THEN v END) AS v2, max(CASE WHEN l_linenumber = 3 THEN v END) AS v3
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1"""


def ratings(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater")).agg(F.min("l_returnflag").alias("value"))


def wide(t: Tables) -> DataFrame:
    return ratings(t).groupBy("item").agg(*(F.max(F.when(F.col("rater") == i, F.col("value"))).alias(f"v{i}") for i in (1, 2, 3)))


@query(f"SELECT * FROM ({WIDE}) WHERE v1 = 'R' OR v2 = 'R' OR v3 = 'R'")
def filter_any_rater(t: Tables) -> DataFrame:
    return wide(t).where(F.array_contains(F.array_compact(F.array("v1", "v2", "v3")), "R"))


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS DISTINCT FROM 1")
def filter_null_aware_ne(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return cohort.without_errors(joined, "toxic")


@query(f"SELECT item FROM ({WIDE}) WHERE v1 IS NULL OR v2 IS NULL OR v3 IS NULL")
def filter_any_null(t: Tables) -> DataFrame:
    return wide(t).where(any_columns(F.isnull, "v1", "v2", "v3")).select("item")


@query(r"""SELECT doc_id FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS have FROM documents)
WHERE len(list_filter(['licen', 'gnu', 'work'], lambda w: len(list_filter(have, lambda h: starts_with(h, w))) > 0)) = 3""")
def filter_text_match(t: Tables) -> DataFrame:
    return t.documents.where(text_match("text", F.lit("Licen GNU work"))).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'License') AND NOT contains(source, '77')")
def filter_contains(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").contains("License") & ~F.col("source").contains("77")).select("doc_id", "source")


@query("""SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate BETWEEN date_trunc('day', o_orderdate) AND date_trunc('day', o_orderdate + INTERVAL 30 DAY) + INTERVAL 86399 SECOND""")
def filter_day_window(t: Tables) -> DataFrame:
    joined = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.where(day_window("l_shipdate", "o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))).select("o_orderkey", "l_linenumber", "l_shipdate")


# ------------------------------------------------------------------ joins


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner_dim(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("""WITH m AS (SELECT source, lang, round(avg(length(text)), 9) + 0.0 AS mean_chars FROM documents GROUP BY 1, 2)
SELECT d.doc_id, d.source, d.lang, m.mean_chars FROM documents d LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.lang IS NOT DISTINCT FROM m.lang""")
def join_left_composite(t: Tables) -> DataFrame:
    d = t.documents
    m = stats.context_lengths(d, ["source", "lang"]).select(F.col("source").alias("s"), F.col("lang").alias("g"), "mean_chars")
    return d.select("doc_id", "source", "lang").join(m, d["source"].eqNullSafe(m["s"]) & d["lang"].eqNullSafe(m["g"]), "left").select("doc_id", "source", "lang", "mean_chars")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT top_n, method FROM (VALUES (5), (10), (25)) a(top_n), (VALUES ('dense'), ('sparse'), ('hybrid')) b(method)")
def join_cross_grid(t: Tables) -> DataFrame:
    return stats.parameter_grid(t.spark, top_n=[5, 10, 25], method=["dense", "sparse", "hybrid"]).withColumn("top_n", F.col("top_n").cast("int"))


@query("""WITH r AS (SELECT l_orderkey AS item, l_linenumber AS k, min(l_returnflag) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.item, a.v = g.v AS first_right, b.v = g.v AS second_right, c.v = g.v AS third_right, a.v = g.v AND b.v = g.v AND c.v = g.v AS all_right
FROM r g JOIN r a ON a.item = g.item AND a.k = 2 JOIN r b ON b.item = g.item AND b.k = 3 JOIN r c ON c.item = g.item AND c.k = 4 WHERE g.k = 1""")
def join_aligned_raters(t: Tables) -> DataFrame:
    # one grouped pass instead of four joins
    cell = lambda i: F.max(F.when(F.col("rater") == i, F.col("value")))
    rows = ratings(t).where("rater <= 4").groupBy("item").agg(*(cell(i).alias(f"v{i}") for i in range(1, 5)))
    rows = rows.where("v1 is not null and v2 is not null and v3 is not null and v4 is not null")
    right = [F.col(f"v{i}") == F.col("v1") for i in (2, 3, 4)]
    return rows.select("item", right[0].alias("first_right"), right[1].alias("second_right"), right[2].alias("third_right"), (right[0] & right[1] & right[2]).alias("all_right"))


# ------------------------------------------------------------------ sets


@query("SELECT o_orderkey AS id, 'orders' AS model FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'lineitem' FROM lineitem")
def union_tagged(t: Tables) -> DataFrame:
    return tagged_union({"orders": t.orders.select(F.col("o_orderkey").alias("id")), "lineitem": t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()})


@query("SELECT o_orderkey AS id FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def intersect_ids(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id")).intersect(t.lineitem.select("l_orderkey"))


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id")).exceptAll(t.labels.select("doc_id"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_ids(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("""SELECT l_orderkey, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS within, len(list_intersect(a, b)) = 0 AS apart
FROM (SELECT l_orderkey, list_distinct(list(l_suppkey) FILTER (l_linenumber <= 3)) AS a, list_distinct(list(l_suppkey) FILTER (l_linenumber > 3)) AS b FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def array_set_algebra(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("l_suppkey"))).alias("b"))
    sets = sets.where((F.size("a") > 0) & (F.size("b") > 0))
    return sets.select("l_orderkey", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_except("a", "b")).alias("only_a"), F.array_sort(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))).alias("either"), (F.size(F.array_except("a", "b")) == 0).alias("within"), (~F.arrays_overlap("a", "b")).alias("apart"))


# ------------------------------------------------------------------ statistics


@query("SELECT source, count(*) AS n, round(avg(n_chars), 9) + 0.0 AS mean, round(stddev_samp(n_chars), 9) + 0.0 AS std, CAST(min(n_chars) AS DOUBLE) AS min, round(quantile_cont(n_chars, 0.25), 9) + 0.0 AS q25, round(quantile_cont(n_chars, 0.5), 9) + 0.0 AS q50, round(quantile_cont(n_chars, 0.75), 9) + 0.0 AS q75, CAST(max(n_chars) AS DOUBLE) AS max FROM documents GROUP BY 1")
def describe_stats(t: Tables) -> DataFrame:
    return stats.describe(t.documents, "n_chars", ["source"])


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) + 0.0 AS share FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_counts_norm(t: Tables) -> DataFrame:
    return stats.value_shares(t.orders, "o_orderpriority")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_distinct FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def nunique_per_group(t: Tables) -> DataFrame:
    return stats.distinct_values(t.orders, "o_custkey", "o_orderstatus")


@query("SELECT toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1")
def group_sizes(t: Tables) -> DataFrame:
    return stats.group_sizes(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "toxic")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS n_words FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", word_count("text").alias("n_words"))


@query(r"SELECT source, lang, round(avg(len(regexp_extract_all(text, '[^\s]+'))), 9) + 0.0 AS mean_words, round(avg(length(text)), 9) + 0.0 AS mean_chars FROM documents GROUP BY 1, 2")
def context_lengths(t: Tables) -> DataFrame:
    return stats.context_lengths(t.documents, ["source", "lang"])


@query("""SELECT o_orderkey, CASE WHEN date_diff('day', CAST(TIMESTAMP '1905-06-01' + CAST(o_custkey AS INTEGER) * INTERVAL 30 DAY AS DATE), CAST(o_orderdate AS DATE)) / 365.0 > 89 THEN 90 ELSE CAST(trunc(date_diff('day', CAST(TIMESTAMP '1905-06-01' + CAST(o_custkey AS INTEGER) * INTERVAL 30 DAY AS DATE), CAST(o_orderdate AS DATE)) / 365.0) AS INTEGER) END AS age,
CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT) AS stay,
CASE WHEN starts_with(c_mktsegment, 'AUTO') THEN 'vehicles' WHEN starts_with(c_mktsegment, 'BUILD') THEN 'buildings' ELSE c_mktsegment END AS segment
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""")
def age_los_ethnicity(t: Tables) -> DataFrame:
    born = F.timestamp_add("DAY", (F.col("o_custkey") * 30).cast("int"), F.lit("1905-06-01").cast("timestamp"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_orderkey", age_years(born, "o_orderdate").alias("age"), whole_days("o_orderdate", "l_shipdate").alias("stay"), prefix_buckets("c_mktsegment", [("AUTO", "vehicles"), ("BUILD", "buildings")]).alias("segment"))


@query("""WITH k AS (SELECT doc_id, lang, quality = 1 AS good, toxic = 1 AS bad FROM documents JOIN labels USING (doc_id)),
u AS (SELECT lang, 'good' AS flag, CAST(good AS INTEGER) AS x FROM k UNION ALL SELECT lang, 'bad', CAST(bad AS INTEGER) FROM k)
SELECT flag, lang, CAST(coalesce(sum(x), 0) AS BIGINT) AS n, round(coalesce(avg(x), 0), 9) + 0.0 AS share FROM u GROUP BY 1, 2""")
def validity_contingency(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select("lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    return stats.flag_table(k, ["good", "bad"], "lang")


@query("""WITH g AS (SELECT f AS flag, s AS status_, e AS expected FROM (VALUES ('R', 400), ('A', 800), ('N', 1000000)) a(f, e), (VALUES ('F'), ('O'), ('X')) b(s)),
c AS (SELECT l_returnflag AS flag, l_linestatus AS status_, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_items FROM lineitem GROUP BY 1, 2)
SELECT flag, status_, CAST(expected AS BIGINT) AS expected, coalesce(n_rows, 0) AS n_rows, coalesce(n_items, 0) AS n_items, expected - coalesce(n_items, 0) AS missing,
CASE WHEN coalesce(n_items, 0) = 0 THEN 'not started' WHEN expected > coalesce(n_items, 0) THEN 'incomplete' WHEN expected < coalesce(n_items, 0) THEN 'more than expected' ELSE 'complete' END AS status
FROM g LEFT JOIN c USING (flag, status_)""")
def completeness_grid(t: Tables) -> DataFrame:
    grid = t.spark.createDataFrame([(f, s, e) for f, e in (("R", 400), ("A", 800), ("N", 1000000)) for s in "FOX"], "flag string, status_ string, expected long")
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status_"), "l_orderkey")
    return stats.completeness(rows, grid, ["flag", "status_"], "l_orderkey")


@query("""SELECT 'flag=' || l_returnflag || ',status=' || l_linestatus AS stratum, count(*) AS n FROM lineitem GROUP BY 1""")
def stratify_counts(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return stats.with_stratum(rows, ["flag", "status"]).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN grouping(l_returnflag, l_linestatus) = 0 THEN 'stratum' ELSE 'all' END AS scope FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag, l_linestatus))")
def grouping_sets_strata(t: Tables) -> DataFrame:
    return stats.total_and_strata(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, c_custkey")
def subjects_by_notes(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c_custkey")


# ------------------------------------------------------------------ cohorts


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def cohort_latest_version(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("day", F.to_date("o_orderdate"))
    return cohort.latest_version(rows, ["o_custkey", "day"], [F.col("o_orderkey").desc()]).select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


LAST = "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"


def last_order(t: Tables) -> DataFrame:
    return cohort.last_per_group(t.orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderdate")


@query(LAST)
def cohort_last_admission(t: Tables) -> DataFrame:
    return last_order(t)


MINIMUM = f"SELECT l.o_custkey, count(*) AS n FROM ({LAST}) l JOIN (SELECT o_custkey, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') x ON x.o_custkey = l.o_custkey AND x.l_shipdate <= l.o_orderdate GROUP BY 1 HAVING count(*) >= 3"


def minimum(t: Tables) -> DataFrame:
    notes = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_shipdate", "l_returnflag")
    return cohort.with_minimum(notes, last_order(t), "o_custkey", "l_shipdate", "o_orderdate", 3, ("l_returnflag", "R"))


@query(MINIMUM)
def cohort_min_counts(t: Tables) -> DataFrame:
    return minimum(t)


@query(f"""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({MINIMUM})) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""")
def cohort_final(t: Tables) -> DataFrame:
    excluded = t.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    ids = minimum(t).select(F.col("o_custkey").alias("c_custkey"))
    return not_yet_done(t.customer.join(ids, "c_custkey", "left_semi").join(done, "c_custkey", "left_semi"), excluded, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT o_orderkey AS id, 'new' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderstatus <> 'F'")
def upsert_by_key(t: Tables) -> DataFrame:
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("old").alias("origin"))
    return upsert(old, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("origin")), "id")


# ------------------------------------------------------------------ ids, strings, payloads


@query(r"SELECT doc_id, regexp_replace(md5(text || '-' || source || '-' || coalesce(lang, '')), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id FROM documents")
def content_uuids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content_uuid("text", "source", "lang").alias("id"))


@query("SELECT doc_id, sha256(text || '|' || source) AS digest FROM documents")
def node_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", node_digest("text", "source").alias("digest"))


@query("""SELECT o_orderkey, 'subject=' || o_custkey || ',author_type=llm,priority=' || replace(o_orderpriority, ' ', '_') || ',reference_format=absolute_time' AS config, 'absolute time' AS reference_format, replace(replace(o_orderpriority, ' ', '_'), '_', ' ') AS priority, 'reference_format=absolute_time' AS rater FROM orders""")
def config_string_roundtrip(t: Tables) -> DataFrame:
    made = t.orders.select("o_orderkey", config_string({"subject": "o_custkey", "author_type": F.lit("llm"), "priority": "o_orderpriority", "reference_format": F.lit("absolute time")}).alias("config"))
    back = config_map("config")
    return made.select("o_orderkey", "config", back["reference_format"].alias("reference_format"), back["priority"].alias("priority"), rater_name("config").alias("rater"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(event_type || '/' || CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS label FROM events")
def payload_json_roundtrip(t: Tables) -> DataFrame:
    node = t.events.select("event_id", F.to_json(F.struct("event_type", F.from_json("props", "k long").alias("props"))).alias("payload"))
    back = F.from_json("payload", "event_type string, props struct<k: long>")
    return node.select("event_id", back.alias("b")).select("event_id", "b.event_type", F.col("b.props.k").alias("k"), F.concat_ws("/", "b.event_type", "b.props.k").alias("label"))


@query("""SELECT page_id, CASE WHEN strpos(html, '<title>') > 0 AND strpos(substr(html, strpos(html, '<title>') + 7), '</title>') > 0 THEN trim(substr(html, strpos(html, '<title>') + 7, strpos(substr(html, strpos(html, '<title>') + 7), '</title>') - 1)) ELSE '' END AS section FROM pages""")
def extract_section(t: Tables) -> DataFrame:
    from veriloom.functions.columns import between_markers

    return t.pages.select("page_id", between_markers("html", "<title>", "</title>").alias("section"))


@query("SELECT event_id, array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS kind, CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END AS high FROM events WHERE value IS NOT NULL")
def categorical_labels(t: Tables) -> DataFrame:
    from veriloom.functions.columns import yes_no

    return t.events.where("value is not null").select("event_id", title_case("event_type").alias("kind"), yes_no(F.col("value") > 50).alias("high"))


@query("SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def node_index_prev_next(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.conversations.select("conv_id", "turn", (F.row_number().over(w) - 1).cast("int").alias("idx"), F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(t: Tables) -> DataFrame:
    from veriloom.streaming.ingest import windowed_counts

    return windowed_counts(t.events)


@query("SELECT o_orderstatus, round(avg(o_totalprice), 9) + 0.0 AS mean FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def pruned_mean(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(rounded(F.avg("o_totalprice")).alias("mean"))
