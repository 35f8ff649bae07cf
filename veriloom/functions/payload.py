"""Shapes of nodes: flat proposition rows, store payloads and metadata maps, and the ways back. Column expressions only.

A node has node_id, text, relationships (map of strings), metadata (map of strings) and, once
retrieved, score. What a frame lacks of these is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.columns import col

# The columns of a flat node, with the types that its metadata text is read as.
PARSED = {"node_monotonic_idx": "bigint", "node_kind": "string", "parent_text": "string", "parent_chunk_id": "string", "source_document_id": "string", "num_characters": "bigint", "num_tokens": "bigint", "num_sentences": "bigint"}
SOURCE = {"ROW_ID": "bigint", "SUBJECT_ID": "bigint", "HADM_ID": "double", "CHARTDATE": "timestamp_ntz", "CHARTTIME": "timestamp_ntz", "STORETIME": "timestamp_ntz", "CATEGORY": "string", "DESCRIPTION": "string", "CGID": "bigint"}
SCORES = ("dense_score", "dense_normalized_score", "sparse_score", "sparse_normalized_score", "fusion_score")
PROPOSITION = {"node_id": "proposition_id", "TEXT": "text", "parent_text": "parent_text_chunk", "SUBJECT_ID": "subject_id", "ROW_ID": "row_id", "HADM_ID": "hadm_id"}
TOP = ("node_monotonic_idx", "node_kind", "created_at", "parent_chunk_id", "source_document_id", "parent_text", *SOURCE)


def _have(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _metadata(df: DataFrame) -> Column:
    return F.coalesce(_have(df, "metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """The 26 columns of a flat node. A scored node without a score has 0.0; what isn't a number or time where one belongs is null."""
    m = _metadata(nodes)
    typed = lambda names: [F.element_at(m, F.lit(k)).try_cast(kind).alias(k) for k, kind in names.items()]
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in nodes.columns else F.lit(None).cast("double")
    parsed = typed(PARSED)
    return nodes.select(
        "node_id",
        *parsed[:2],
        F.col("text").alias("TEXT"),
        *parsed[2:],
        _have(nodes, "relationships", "map<string,string>").alias("relationships"),
        *typed(SOURCE),
        score.alias("score"),
        *typed(dict.fromkeys(SCORES, "double")),
    )


def propositions(flat: DataFrame) -> DataFrame:
    """The six columns that a proposition keeps of a flat node, renamed."""
    return flat.select(*(F.col(a).alias(b) for a, b in PROPOSITION.items()))


def to_payload(nodes: DataFrame, kind: str = "TextNode") -> DataFrame:
    """Known metadata keys at the top level, the others as a map, and the whole rest as JSON."""
    m = _metadata(nodes)
    rest = without_keys(m, TOP)
    relations = F.coalesce(_have(nodes, "relationships", "map<string,string>"), F.create_map().cast("map<string,string>"))
    content = F.to_json(F.struct(F.lit(None).cast("string").alias("embedding"), rest.alias("metadata")), {"ignoreNullFields": "false"})
    return nodes.select("node_id", "text", relations.alias("relationships"), *(F.element_at(m, F.lit(k)).alias(k) for k in TOP), rest.alias("metadata"), content.alias("_node_content"), F.lit(kind).alias("_node_type"))


def from_payload(payload: DataFrame) -> DataFrame:
    """The inverse: top-level keys that aren't null go back into the metadata."""
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in TOP)), lambda e: e["value"].isNotNull())
    return payload.select("node_id", "text", "relationships", merged(F.map_from_entries(pairs), F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("metadata"))


def to_metadata(nodes: DataFrame, remove_text: bool = False, kind: str = "TextNode") -> DataFrame:
    """node_id and the metadata map with the node as JSON and the source's id under the names that stores filter by."""
    m = _metadata(nodes)
    text = F.lit("") if remove_text else F.col("text")
    content = F.to_json(F.struct(F.col("node_id").alias("id_"), text.alias("text"), m.alias("metadata"), _have(nodes, "relationships", "map<string,string>").alias("relationships")))
    source = F.coalesce(F.element_at(m, F.lit("source_document_id")), F.lit("None"))
    more = F.create_map(*(x for k, v in (("_node_content", content), ("_node_type", F.lit(kind)), ("document_id", source), ("doc_id", source), ("ref_doc_id", source), ("text", F.col("text"))) for x in (F.lit(k), v)))
    return nodes.select("node_id", merged(m, more).alias("metadata"))


def from_metadata(rows: DataFrame, text: str | None = None) -> DataFrame:
    """Nodes of the JSON in such maps; text: a column that replaces the node's own. Maps without a node give null fields."""
    node = F.from_json(F.element_at("metadata", F.lit("_node_content")), "id_ string, text string, metadata map<string,string>, relationships map<string,string>")
    back = rows.withColumn("__n", node)
    own = F.col("__n.text") if text is None else F.coalesce(F.col(text), F.col("__n.text"))
    return back.select(F.col("__n.id_").alias("node_id"), own.alias("text"), F.col("__n.relationships").alias("relationships"), F.col("__n.metadata").alias("metadata"))


def metadata_text(metadata: str | Column, excluded: tuple[str, ...] = (), line: str = "%s: %s", separator: str = "\n") -> Column:
    """A map as lines in order of keys, without the excluded ones."""
    entries = F.array_sort(F.map_entries(without_keys(col(metadata), excluded)))
    return F.array_join(F.transform(entries, lambda e: F.format_string(line, e["key"], e["value"])), separator)


def node_text(metadata: str | Column, text: str | Column, excluded: tuple[str, ...] = (), template: str = "%s\n\n%s") -> Column:
    """Metadata lines above the text; the text alone if there are none."""
    head = metadata_text(metadata, excluded)
    return F.when(F.coalesce(F.length(head), F.lit(0)) > 0, F.format_string(template, head, col(text))).otherwise(col(text))


# maps and JSON


def without_keys(m: str | Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(col(m), lambda k, v: ~k.isin(*keys)) if keys else col(m)


def merged(*maps: str | Column) -> Column:
    """One map of several; of equal keys the last one's value counts."""
    kept = [without_others(m, maps[i + 1 :]) for i, m in enumerate(maps)]
    return F.map_concat(*kept)


def without_others(m: str | Column, later) -> Column:
    if not later:
        return col(m)
    keys = F.flatten(F.array(*(F.map_keys(col(x)) for x in later)))
    return F.map_filter(col(m), lambda k, v: ~F.array_contains(keys, k))


def json_object(text: str | Column, schema: str) -> Column:
    """The object between the first { and the last }, as models wrap it in words; null if there is none or it doesn't parse."""
    cut = F.regexp_extract(col(text), r"(?s)\{.*\}", 0)
    return F.when(F.length(cut) > 0, F.from_json(cut, schema, {"mode": "PERMISSIVE"}))
