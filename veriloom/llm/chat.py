r"""Chat formatting: records of many layouts become canonical turns, then one template.

A record's (or a table's) nested field paths are hashed to a fingerprint, and the fingerprint
selects a declarative mapping that says where turns, roles and texts lie. Paths outside the
vocabulary of all mappings don't count, so extra columns don't matter; if clashing names spoil
the fingerprint, the first mapping in the list whose paths are all there is taken.

Template, one segment a turn:  ``### <role>: <text> </turn>\n``.  In texts a backslash goes
before every backslash, ``###`` and ``</turn>``; in roles before backslashes, colons, ``#``
and ``<``. A backslash always stands for the character after it, so reading back is exact.
The loss mask covers the texts of assistant turns.

Defined results: null roles and texts are empty; turns go by (turn, role, text) with nulls
first, so ties and repeated rows have one order and each counts; a null conversation id is a
conversation of its own; an empty table gives no rows. A conversation is never gathered:
its turns are sorted within a partition (Spark's sort spills) and streamed one by one, so a
conversation with a third of all rows needs no more memory than any other.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.common import arrow_map, arrow_schema


@dataclass(frozen=True)
class Mapping:
    """turns: path of the array of turns with role and text fields below it; pairs: (role, path) of single fields."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    pairs: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("turn rows", ("role", "text", "turn"), role="role", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("message texts", ("messages[].role", "messages[].text"), "messages", "role", "text"),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("instruction with input", ("input", "instruction", "output"), pairs=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", ("instruction", "output"), pairs=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system, prompt, response", ("prompt", "response", "system"), pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and response", ("prompt", "response"), pairs=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", ("completion", "prompt"), pairs=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question and answer", ("answer", "question"), pairs=(("user", "question"), ("assistant", "answer"))),
)
#: Other names that data sets give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(KNOWN & set(paths))).encode()).hexdigest()


BY_PRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def mapping_for(paths) -> Mapping | None:
    found = set(paths)
    return BY_PRINT.get(fingerprint(found)) or next((m for m in MAPPINGS if found.issuperset(m.paths)), None)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Leaf paths of a table's schema; [] marks an array."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def value_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a parsed JSON record."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")}
    return {at}


def _string(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def record_turns(record) -> list[tuple[str, str]] | None:
    """(role, text) of a parsed record; None if no mapping fits."""
    m = mapping_for(value_paths(record)) if isinstance(record, dict) else None
    if m is None:
        return None
    if m.turns:
        found = [(_string(t.get(m.role)), _string(t.get(m.text))) for t in record[m.turns] if isinstance(t, dict)]
        return [(ROLES.get(r, r), t) for r, t in found]
    if m.pairs:
        return [(r, _string(record[p])) for r, p in m.pairs if p != "input" or record[p]]
    return [(_string(record[m.role]), _string(record[m.text]))]


TURNS = "conv_id long, turn long, role string, text string"


def turns_of_table(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns of a table whose schema fits a mapping; built of DataFrame functions."""
    m = mapping_for(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for the fields {sorted(schema_paths(df.schema))}")
    key = F.col(conv_id).cast("long").alias("conv_id")
    if not m.turns and not m.pairs:
        return df.select(key, F.col("turn").cast("long"), F.col(m.role).alias("role"), F.col(m.text).alias("text"))
    if m.turns:
        rows = df.select(key, F.posexplode(m.turns).alias("turn", "t"))
        role = F.col(f"t.{m.role}")
        names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
        return rows.select("conv_id", F.col("turn").cast("long"), F.coalesce(names[role], role).alias("role"), F.col(f"t.{m.text}").alias("text"))
    pairs = F.array(*(F.struct(F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for r, p in m.pairs))
    kept = F.filter(pairs, lambda t: F.lit(True)) if "input" not in m.paths else F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.array(pairs[0], pairs[2])).otherwise(pairs)
    return df.select(key, F.posexplode(kept).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def turns_of_json(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of JSON texts, each record by its own fingerprint. What isn't JSON or fits no mapping: one turn with a null role."""

    def rows(batch):
        out = {"conv_id": [], "turn": [], "role": [], "text": []}
        for conv, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                turns = record_turns(json.loads(raw or ""))
            except ValueError:
                turns = None
            for i, (role, text) in enumerate([(None, raw)] if turns is None else turns):
                for k, v in zip(out, (conv, i, role, text), strict=True):
                    out[k].append(v)
        return out

    return arrow_map(df.select(F.col(conv_id).cast("long").alias("conv_id"), record), rows, arrow_schema(TURNS), TURNS)


_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"[\\:#<]")
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The segment and the span of its text in code points."""
    head = "### " + _ROLE.sub(r"\\\g<0>", role or "") + ": "
    body = _TEXT.sub(r"\\\g<0>", text or "")
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def read_segments(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; ValueError if something else stands between."""
    at, out = 0, []
    while at < len(formatted):
        if not (m := _SEGMENT.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((_BACK.sub(r"\1", m[1]), _BACK.sub(r"\1", m[2])))
        at = m.end()
    return out


SEGMENTS = "conv_id long, position long, segment string, loss_from long, loss_to long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_chat(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """A row a turn, in order within the partition: its segment, and the loss span in it (equal ends: none)."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, position = arrow_schema(SEGMENTS), object(), 0
        for batch in batches:
            out = {c.split()[0]: [] for c in SEGMENTS.split(", ")}
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                position = position + 1 if conv == last else 0
                last = conv
                segment, a, b = format_turn(role, text)
                span = (a, b) if role == assistant else (0, 0)
                for k, v in zip(out, (conv, position, segment, *span), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def chat_digest(segments: DataFrame) -> DataFrame:
    """Reads the formatted conversations back, turn by turn as they come, and sums each up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now = arrow_schema(DIGEST), None
        for batch in batches:
            done = []
            for conv, position, segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_segments(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = _BACK.sub(r"\1", segment[a:b])
                now[3] += len(masked)
                now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(segment)
            yield _summed(done, schema)
        if now:
            yield _summed([now], schema)

    return segments.mapInArrow(run, DIGEST)


def _summed(done: list[list], schema: pa.Schema) -> pa.RecordBatch:
    values = [[c, n, t.hexdigest(), k, s.hexdigest(), f] for c, n, t, k, s, f in done]
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for f, x in zip(schema, zip(*values, strict=True) if values else [[]] * len(schema), strict=True)], schema=schema)
