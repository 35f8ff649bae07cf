"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed whole with either dictionary. The difference of the sizes, for each byte
of text, says which dictionary knows it better; a logistic curve in that difference and in the
size itself, fitted on labelled rows that the dictionaries haven't seen and moved to the share
of good labels in the learning fold, makes it a probability.

Learning takes at most SAMPLE rows of each label, those of least id hash, and whole texts of at most
SAMPLE_BYTES in all (a text that would go beyond is passed over); scoring covers all.
Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts get the curve's value at no bytes; without labelled rows of
both kinds every score is the share of good labels, or 0.5 if there are none; repeated rows are kept;
rows with null labels teach nothing; empty tables give no rows; other columns are not looked at.
Memory: one batch of texts; the model is below 1 MB.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import arrow_map, arrow_schema, fold, keep_rows, least_hashed, small_batches, tools, within_bytes

#: Labelled rows of each kind that are learnt from, at most; half for the dictionary, half for the curve.
SAMPLE, SAMPLE_BYTES = 1200, 64 << 20
DICTIONARY_BYTES, LEVEL, PART = 65_536, 3, 2_000
LEARN_MODULUS, HELD_OUT = 3, 1
#: Least score of a text that the classifier takes for good.
DECISION = 0.5


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes]  # bad, good; empty if untrained
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells models apart in workers

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(curve((features - self.middle) / self.spread) @ self.weights, -35, 35)
        return 1 / (1 + np.exp(-z))


def measured(texts: list[str], compressors) -> np.ndarray:
    """Size difference and size with the good dictionary, both for each byte of text."""
    out = np.zeros((len(texts), 2))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        bad, good = (len(c.compress(raw)) for c in compressors)
        out[i] = (bad - good) / (len(raw) + 1), good / (len(raw) + 1)
    return out


def curve(x: np.ndarray) -> np.ndarray:
    a, b = np.clip(x, -6, 6).T
    return np.stack([np.ones_like(a), a, b, a * b, a * a, b * b], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[str]) -> bytes:
    parts = [raw[i : i + PART] for raw in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(raw), PART)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(parts)[-DICTIONARY_BYTES:]


def fit(bad: list[str], good: list[str], share_good: float) -> Model:
    none = Model((b"", b""), np.zeros(6), np.zeros(2), np.ones(2))
    prior = np.log(np.clip(share_good, 1e-3, 1 - 1e-3) / np.clip(1 - share_good, 1e-3, 1 - 1e-3))
    if len(bad) < 2 or len(good) < 2:
        none.weights[0] = prior
        return none
    model = Model((dictionary(bad[::2]), dictionary(good[::2])), none.weights, none.middle, none.spread)
    rest = [*bad[1::2], *good[1::2]]
    y = np.array([0.0] * len(bad[1::2]) + [1.0] * len(good[1::2]))
    x = measured(rest, model.compressors())
    model.middle, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic(curve((x - model.middle) / model.spread), y)
    model.weights[0] += prior - np.log(y.sum() / (len(y) - y.sum()))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from labelled rows outside the held-out fold. Only the chosen rows come to the driver."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, LEARN_MODULUS) != HELD_OUT)).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    known = known.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = least_hashed(known.select("k", F.col("y").alias("g")), sample)
    chosen = {k: y for y, keys in least.items() for k in within_bytes(docs, keys, SAMPLE_BYTES // 2, key, text)}
    found = docs.where(F.col(key).isin(list(chosen))).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().collect() if chosen else []
    place = {k: i for i, k in enumerate(chosen)}
    texts = {0: [], 1: []}
    for k, t in sorted({(r["k"], r["t"]) for r in found}, key=lambda r: (place[r[0]], r[1])):
        texts[chosen[k]].append(t)
    return fit(texts[0], texts[1], n.get(1, 0) / sum(n.values()) if n else 0.5)


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    return tools(f"quality {model.token}", model.compressors)


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    small_batches(docs.sparkSession)

    def rows(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        s = model.scores(measured([t or "" for t in texts], _compressors(model)))
        return {"doc_id": ids, "score": s.tolist(), "predicted": (s >= DECISION).astype(int).tolist()}

    return arrow_map(docs.select(key, text), rows, arrow_schema(SCORED), SCORED)


def keep(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """Rows of at least this score."""
    small_batches(docs.sparkSession)

    def good(texts):
        return (model.scores(measured([t or "" for t in texts], _compressors(model))) >= least).tolist()

    return keep_rows(docs, text, good)
