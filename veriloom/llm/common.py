"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.session import ARROW, checkpointed, shared_folder, small_batches  # noqa: F401  (for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_TOOLS: dict[str, Any] = {}


def tools(name: str, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a worker process from task to task. Only one operator's is kept: when the next one asks, it goes."""
    if name not in _TOOLS:
        if _TOOLS:
            _TOOLS.clear()
            give_back()
        _TOOLS[name] = make()
    return _TOOLS[name]


def give_back() -> None:
    """Memory that is no longer used goes back to the system."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class Remembered(dict):
    """A dict that counts the bytes of what it is told of, and forgets all in trim() once there are too many.

    Test its keys with `in`: set.difference() walks through all of a mapping that is not a plain dict."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.bytes = most, 0

    def told(self, keys: Iterable[Any], each: int = 0) -> None:
        """New keys, with so many bytes of values each besides those in the dict."""
        self.bytes += sum(sys.getsizeof(k) + sys.getsizeof(self[k]) + 100 + each for k in keys)

    def trim(self) -> bool:
        if self.bytes <= self.most:
            return False
        self.clear()
        self.bytes = 0
        return True


def least_hashed(rows: DataFrame, sample: int) -> dict[Any, list[Any]]:
    """For each group of rows (k, g) its distinct keys of least hash, at most so many, in that order.

    Rows under a hash threshold that holds somewhat more than enough keys come to the driver; none is ranked in a
    window, so a group of any size is read where it lies."""
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    found: dict[Any, list[Any]] = {g: [] for g in counts}
    open_, share = dict(counts), {g: min(1.0, (sample + 8 * sample**0.5 + 64) / n) for g, n in counts.items()}
    while open_:
        least = F.lit(False)
        for g in open_:  # one term for each group
            top = (1 << 63) - 1 if share[g] >= 1 else int(share[g] * (1 << 64)) - (1 << 63)
            least = F.when(F.col("g") == g, F.xxhash64("k") <= F.lit(top)).otherwise(least)
        got: dict[Any, list[Any]] = {g: [] for g in open_}
        for r in rows.where(least).select("k", "g", F.xxhash64("k").alias("h")).distinct().collect():
            got[r["g"]].append((r["h"], r["k"]))
        for g, keys in got.items():
            if len(keys) >= sample or share[g] >= 1:
                found[g] = [k for _, k in sorted(keys)[:sample]]
                del open_[g]
            share[g] = min(1.0, 4 * share[g])  # keys that come in many rows: look further
    return found


def within_bytes(docs: DataFrame, keys: list[Any], most: int, key: str, text: str) -> list[Any]:
    """The first of the keys whose texts have no more than so many bytes together; a text that doesn't fit is passed over."""
    if not keys:
        return []
    rows = docs.where(F.col(key).isin(keys)).groupBy(F.col(key).alias("k")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("n")).collect()
    size, out = {r["k"]: r["n"] for r in rows}, []
    for k in keys:
        if k in size and size[k] <= most:
            most -= size[k]
            out.append(k)
    return out


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A checkpointed frame in no more partitions than its rows need, so that small ones don't write many small shuffle files."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def keep_rows(df: DataFrame, text: str, good: Callable[[list[str | None]], list[bool]], gather: int = 0) -> DataFrame:
    """Rows of df, all columns, whose texts are good."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, gather) if gather else batches:
            if batch.num_rows:
                yield batch.filter(pa.array(good(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Joins batches until they hold so many bytes, so what a batch's texts share is worked out once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, list]], schema: pa.Schema, ddl: str, gather: int = 0) -> DataFrame:
    """Apply a batch function that returns columns as lists; gather: bytes of input to join before a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, gather) if gather else batches:
            if batch.num_rows:
                out = rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in map(str.strip, ddl.split(", "))])


def fold(key: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo: the fixed folds of the labelled queries."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus
