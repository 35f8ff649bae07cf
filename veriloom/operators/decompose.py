"""Text into sentences, semantic chunks and claims; packing and summarising of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import backends
from veriloom.functions.columns import char_span, content_uuid, cosine, sentences, token_count
from veriloom.functions.session import small_batches


def sentence_nodes(docs: DataFrame, key: str, text: str, splitter=None) -> DataFrame:
    """A row a sentence: id, links, place and span in the parent, sizes. splitter: Column to array of strings."""
    parts = docs.select(F.col(key).alias("source_document_id"), F.col(text).alias("__parent"), F.posexplode((splitter or sentences)(text)).alias("node_monotonic_idx", "text"))
    start, end = char_span("__parent", "text")
    by = Window.partitionBy("source_document_id").orderBy("node_monotonic_idx")
    nodes = parts.withColumns({"start_char_idx": start, "end_char_idx": end, "node_id": content_uuid("text", "source_document_id", "node_monotonic_idx")}).drop("__parent")
    return nodes.withColumns({"prev_id": F.lag("node_id").over(by), "next_id": F.lead("node_id").over(by), "num_characters": F.length("text").cast("long"), "num_tokens": token_count("text")})


def sentence_windows(rows: DataFrame, doc: str, order: str | list, text: str, buffer: int = 3) -> DataFrame:
    """Each sentence with so many before and after it."""
    near = Window.partitionBy(doc).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(-buffer, buffer)
    return rows.withColumn("window_text", F.array_join(F.collect_list(text).over(near), ""))


def breakpoints(rows: DataFrame, doc: str, order: str, vector: str, percentile: float = 0.9) -> DataFrame:
    """Distance to the next row and chunk numbers, cut where the distance is above the document's percentile."""
    along, whole = Window.partitionBy(doc).orderBy(order), Window.partitionBy(doc)
    d = rows.withColumn("distance", 1 - cosine(vector, F.lead(vector).over(along)))
    d = d.withColumn("threshold", F.percentile("distance", percentile).over(whole))
    cut = F.when(F.col("distance") > F.col("threshold"), 1).otherwise(0)
    return d.withColumn("chunk", F.coalesce(F.sum(cut).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def chunks(rows: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Joins the rows of each (doc, chunk) in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda e: e[text])
    return rows.groupBy(doc, "chunk").agg(F.array_join(parts, "").alias("chunk_text"), F.count(F.lit(1)).alias("n_rows"))


def packed(pieces: list[str], most: int, size) -> list[str]:
    """The backup: pieces packed in order up to the limit; a piece beyond it is cut between words, and a word beyond it stays whole."""
    parts = [p for piece in pieces for p in ([piece] if size(piece) <= most else re.findall(r"\s*\S+\s*", piece) or [piece])]
    out, held = [], ""
    for part in parts:
        if held and size(held + part) > most:
            out.append(held)
            held = ""
        held += part
    return [*out, held] if held else out


class _Windows:
    """Windows of neighbouring pieces as vectors, and sizes of runs of pieces. Embedders that can count a piece's words do so once; windows are then sums."""

    def __init__(self, pieces: list[str], embed, size, buffer: int):
        self.pieces, self.embed, self.size, self.buffer = pieces, embed, size, buffer
        self.sums = None
        if isinstance(getattr(embed, "__self__", None), backends.HashedWords):
            counts, n = embed.__self__.counts(pieces)
            self.sums = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)])
            self.words = np.concatenate([[0], np.cumsum(n)])

    def length(self, a: int, b: int) -> int:
        return int(self.words[b] - self.words[a]) if self.sums is not None and self.size is None else (self.size or backends.count_words)("".join(self.pieces[a:b]))

    def distances(self, a: int, b: int) -> np.ndarray:
        """One less the cosine, of each window of the pieces a..b with the next."""
        at = np.arange(a, b)
        low, high = np.maximum(a, at - self.buffer), np.minimum(b, at + self.buffer + 1)
        if self.sums is not None:
            v = self.sums[high] - self.sums[low]
            v = v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None]
        else:
            v = np.array([e for e, _ in self.embed(["".join(self.pieces[i:j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)])])
        return 1 - (v[:-1] * v[1:]).sum(axis=1)


def semantic_split(pieces: list[str], most: int, embed, size=None, percentile: float = 90, buffer: int = 3, shrink: float = 0.75, force: bool = False) -> list[str]:
    """Chunks below the limit: cut at large distances of neighbouring windows, again within chunks that reach the limit.

    A chunk that isn't smaller than shrink of what it was cut from goes to the backup, packed(), and if that leaves it
    whole, again with half the limit. A text up to the limit is one chunk unless forced. size: tokens of a text, else words."""
    if not pieces:
        return []
    w = _Windows(pieces, embed, size, buffer)
    if w.length(0, len(pieces)) <= most and not force:
        return ["".join(pieces)]
    count, out, todo = size or backends.count_words, [], [(0, len(pieces))]
    while todo:  # in order: the next run to cut is the last of the list
        a, b = todo.pop()
        cuts = [a, b]
        if b - a > 1:
            far = w.distances(a, b)
            cuts = [a, *(np.flatnonzero(far > np.percentile(far, percentile)) + a + 1).tolist(), b]
        found, again = [], []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if w.length(i, j) < most:
                found.append((i, j, "".join(pieces[i:j])))
            elif w.length(i, j) < shrink * w.length(a, b):
                again.append((i, j))
                found.append((i, j, None))
            else:
                parts = packed(pieces[i:j], most, count)
                parts = packed(pieces[i:j], max(1, most // 2), count) if len(parts) == 1 else parts
                found += [(i, j, p) for p in parts]
        out.append(found)
        todo += again[::-1]
    whole = {}
    for found in reversed(out):  # a run cut further stands for its parts
        made = []
        for i, j, text in found:
            made += [text] if text is not None else whole.pop((i, j))
        whole[found[0][0], found[-1][1]] = made
    return whole[0, len(pieces)]


def semantic_chunks(docs: DataFrame, key: str, text: str, most: int = 128, embedder: backends.Embedder | None = None, size=None, force: bool = False) -> DataFrame:
    """key, chunk number and text; a document is split within its task, one at a time."""
    model = embedder or backends.HashedWords()
    cut = docs.select(F.col(key).cast("long").alias("doc"), sentences(F.coalesce(F.col(text), F.lit(""))).alias("pieces"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, i, c) for doc, pieces in zip(frame["doc"], frame["pieces"], strict=True) if len(pieces) for i, c in enumerate(semantic_split(list(pieces), most, model.embed, size, force=force))]
            yield pd.DataFrame(rows, columns=["doc", "chunk", "chunk_text"])

    return cut.mapInPandas(run, "doc long, chunk long, chunk_text string")


def claims(docs: DataFrame, key: str, text: str, finder: backends.ClaimFinder | None = None) -> DataFrame:
    """key, claim number and claim; texts without a claim have no rows."""
    model = finder or backends.RuleClaims()

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(model.claims(t.tolist()))

    return docs.select(key, F.posexplode(found(text)).alias("claim_idx", "claim"))


def embed(df: DataFrame, text: str, embedder: backends.Embedder | None = None, sparse: bool = True) -> DataFrame:
    """Adds dense and sparse embeddings, or the dense ones alone: a map of all words is larger than its text."""
    model = embedder or backends.HashedWords()
    small_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            texts = [x or "" for x in t]
            yield pd.Series(model.dense(texts) if hasattr(model, "dense") else [v for v, _ in model.embed(texts)], dtype=object)

    if not sparse:
        return df.withColumn("dense", vectors(text))

    @F.pandas_udf("struct<dense: array<double>, sparse: map<string, double>>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame(model.embed([x or "" for x in t]), columns=["dense", "sparse"])

    return df.withColumn("__e", made(text)).withColumns({"dense": F.col("__e.dense"), "sparse": F.col("__e.sparse")}).drop("__e")


def judge(df: DataFrame, text: str, reference: str, backend: backends.Judge | None = None) -> DataFrame:
    """Adds verdict and reason; labels outside the three become null, for a second try or quarantine."""
    from veriloom.functions.columns import valid_verdict

    model = backend or backends.LexicalJudge()
    small_batches(df.sparkSession)

    @F.pandas_udf("struct<verdict: string, reason: string>")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, r in batches:
            yield pd.DataFrame(model.judge([x or "" for x in t], [x or "" for x in r]), columns=["verdict", "reason"])

    return df.withColumn("__v", told(text, reference)).withColumns({"verdict": valid_verdict("__v.verdict"), "reason": F.col("__v.reason")}).drop("__v")


def validity_flags(df: DataFrame, text: str, backend: object | None = None) -> DataFrame:
    """Adds six flags of a statement: by rules as columns, or by a backend with flags() in batches."""
    if backend is None:
        return df.withColumns(backends.validity_columns(text))
    names = list(backends.validity_columns(text))

    @F.pandas_udf(", ".join(f"{n} boolean" for n in names))
    def flags(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame(backend.flags([x or "" for x in t]), columns=names).astype(object)

    return df.withColumn("__f", flags(text)).select(*df.columns, *(F.col(f"__f.{n}").alias(n) for n in names))


def explained(verdicts: DataFrame, by: list[str], backend: backends.Explainer | None = None, together: int = 50) -> DataFrame:
    """by, verdict, explanation: the reasons of each verdict summed up, so many at a time, and then the sums alike. rows: by, verdict, reason."""
    model, keys = backend or backends.CommonReasons(), [*by, "verdict"]
    rows = verdicts.where("verdict is not null").select(*keys, F.coalesce("reason", F.lit("")).alias("explanation"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", explanation string"

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        reasons = sorted(pdf["explanation"])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "explanation": [model.explain(str(pdf["verdict"].iloc[0]), reasons)]})

    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:  # each round leaves one row where there were about `together`
        groups = max(1, -(-most // together))
        rows = rows.withColumn("__g", F.pmod(F.xxhash64("explanation"), F.lit(groups))).groupBy(*keys, "__g").applyInPandas(some, ddl)
        if groups == 1:
            return rows
        most = groups


def repacked(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Greedy packing in order: a part that no longer fits begins the next pack; oversized parts stand alone. Adds pack (from 0)."""
    items = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(size).cast("long").alias("size")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, item):
        fits = (acc["used"] == 0) | (acc["used"] + item["size"] <= most)
        pack = F.when(fits, acc["pack"]).otherwise(acc["pack"] + 1)
        used = F.when(fits, acc["used"] + item["size"]).otherwise(item["size"])
        return F.struct(pack.alias("pack"), used.alias("used"), F.concat(acc["out"], F.array(pack)).alias("out"))

    packs = F.aggregate("items", start, step)["out"]
    return items.select(group, F.explode(F.arrays_zip(F.col("items"), packs.alias("pack"))).alias("e")).select(group, F.col(f"e.items.{order}").alias(order), F.col("e.items.size").alias("size"), F.col("e.pack").alias("pack"))


def written(df: DataFrame, group: str, order: str, text: str, limit: int = 200, writer: backends.Writer | None = None) -> DataFrame:
    """Summaries folded in order: each text is compacted with what was written before. Ties in order go by text.

    Groups lie together and sorted, and are streamed, so only what is written so far is held."""
    model, kind = writer or backends.FirstSentences(), dict(df.dtypes)[group]
    lying = df.select(group, order, F.coalesce(text, F.lit("")).alias("__t")).repartition(group).sortWithinPartitions(group, order, "__t")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out, some = None, "", False
        for frame in frames:
            done = []
            for g, t in zip(frame[group], frame["__t"], strict=True):
                if some and g != at and not (pd.isna(g) and pd.isna(at)):
                    done.append((at, out))
                    out = ""
                at, some = g, True
                out = model.write([out, t] if out else [t], limit)
            yield pd.DataFrame(done, columns=[group, "written"])
        if some:
            yield pd.DataFrame([(at, out)], columns=[group, "written"])

    return lying.mapInPandas(fold, f"{group} {kind}, written string")


def course(df: DataFrame, group: str, order: str, text: str, limit: int = 200, pack: int = 1000, writer: backends.Writer | None = None) -> DataFrame:
    """Each text summed up, the summaries packed in order up to so many words, each pack combined, and the packs folded."""
    model = writer or backends.FirstSentences()

    @F.pandas_udf("string")
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([model.write([x], limit) if x else "" for x in t])

    summed = df.select(group, order, short(F.coalesce(text, F.lit(""))).alias("summary")).where(F.length("summary") > 0).withColumn("size", F.size(F.split(F.trim("summary"), r"\s+")))
    packs = repacked(summed, group, order, "size", pack).join(summed.select(group, order, "summary"), [group, order])
    joined = packs.groupBy(group, "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "summary"))), lambda e: e["summary"]), "\n\n").alias("text"))
    return written(joined.withColumn("text", short("text")), group, "pack", "text", limit, model)
