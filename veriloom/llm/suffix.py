"""Exact repeated substrings by suffix sorting with a difference cover.

Every byte covered by a 100-byte string that also starts earlier (a smaller doc_id, or earlier in
the same document) goes. Sorting the suffixes of all text at once would move the corpus several
times; the sort is dealt out instead, so that equal 100-byte strings always meet:

1. Each 100-byte string belongs to the least-hashed 32-byte piece within it (its anchor), which
   its content alone fixes. Runs of starts with one anchor are fragments. Within a task, only the
   earliest of equal fragments goes on, the others are repeats already; the rest are dealt by anchor,
   where later copies of equal fragments are repeats, and different fragments of one anchor remain.
   Anchors of at least SHARE of all fragments (a common line in varied surroundings) are dealt by anchor
   and content instead: a first pass counts them, and there are no more than 2 / SHARE of them.
2. What remains is cut in two around 66 bytes that its strings share, read from the texts, and dealt
   by those. A task sorts the suffixes of many such groups at once by the difference-cover method:
   sort sampled triples, recurse on their names, place the others by one symbol and a sampled rank,
   merge, and compare adjacent 100-byte prefixes. Fragments of the common anchors go string by string,
   combined before the shuffle, so that no task gets more than one copy of a string from any other.
   A group of more than GROUP fragments is left to an exact count of its 100-byte strings.

Equal fragments are told by two 64-bit hashes, of the anchor and of the content; the suffix sort compares bytes.

Defined results: null and empty texts are empty documents; rows of one id count as one document, so a
string isn't a repeat of the one at the same place in another row of its id, and they share what is
removed; null ids are one id, before all others; an empty table gives no rows; other columns are not
looked at. Memory: some megabytes of text, or one document with its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.common import arrow_map, arrow_schema, checkpointed, gathered, small_batches, tools, unused

LENGTH = 100
#: Bytes of an anchor; starts that share one at most; bytes beside the anchor that the second cut adds.
PIECE = 32
WINDOW = LENGTH - PIECE + 1
BESIDE = (LENGTH - PIECE) // 2
#: Bytes hashed at once, texts gathered for one round of combining, text sorted at once, fragments of a group.
CHUNK, GATHER, SORTED, GROUP = 1 << 19, 16 << 20, 2 << 20, 8_192
#: Least share of all fragments that a common anchor has; compressed text whose common strings are combined at once.
SHARE, TOGETHER = 1e-3, 1 << 20


# ---------------------------------------------------------------- suffix sorting


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Names 1, 2, ... in order of the keys."""
    values, names = np.unique(keys, return_inverse=True)
    return names.astype(np.int64) + 1, len(values)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts in the order of the suffixes of s (positive integers), by a difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    top = int(padded.max()) + 1
    pair, pairs = _dense(padded[: n + 2] * top + padded[1 : n + 3])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, different = _dense(pair[sample] * top + padded[sample + 2])
    if different < len(sample):
        # a zero after the first half keeps its last name from running into the second half
        between = np.concatenate([names[: len(ones)], [0], names[len(ones) :]]) + 1
        order = suffix_array(between)
        order = order[order != len(ones)]
        order = np.where(order > len(ones), order - 1, order)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    base = len(sample) + 2
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(padded[zeros] * base + rank[zeros + 1], kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(padded[first] * base + rank[first + 1], padded[zeros] * base + rank[zeros + 1])
    before += np.searchsorted(pair[second] * base + rank[second + 2], pair[zeros] * base + rank[zeros + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + before
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sampled
    return out


def repeats(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each start in text, whether the LENGTH bytes there also stand at another of them with less (doc, place)."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[wanted[order]]
    views = sliding_window_view(text, LENGTH)
    equal = np.zeros(len(order), bool)
    for i in range(1, len(order), 65_536):
        part = order[i : i + 65_536]
        equal[i : i + len(part)] = (views[part] == views[order[i - 1 : i - 1 + len(part)]]).all(axis=1)
    where = np.empty(len(text), np.int64)
    where[starts] = np.arange(len(starts))
    run = np.cumsum(~equal)
    i = where[order]
    o = np.lexsort((place[i], doc[i], run))
    i, run = i[o], run[o]
    head = _heads(np.concatenate([[False], run[1:] == run[:-1]]))
    out = np.zeros(len(starts), bool)
    out[i] = (doc[i] != doc[i[head]]) | (place[i] != place[i[head]])
    return out


def _heads(again: np.ndarray) -> np.ndarray:
    """Of each row of a sorted run the place of the run's first."""
    return np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))


# ---------------------------------------------------------------- fragments

_RANDOM = np.random.default_rng(23)
_BYTES = _RANDOM.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum over windows of n."""
    done = 1
    while 2 * done <= n:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (n - done)], v[n - done :]) if done < n else v


def fragments(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor in a run of at most CHUNK bytes (more would not fit the positions' bits)."""
    h = {1: _BYTES[raw]}
    n = 1
    while n < 64:
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
        n *= 2
    m = len(raw) - LENGTH + 1
    whole = h[64][:m] * _power(36) + h[32][64 : 64 + m] * _power(4) + h[4][96 : 96 + m]
    piece = _mixed(h[32])
    keyed = (piece & np.uint64(_MASK - (1 << 20) + 1)) | np.arange(len(piece), dtype=np.uint64)
    anchor = (_least(keyed, WINDOW) & np.uint64((1 << 20) - 1)).astype(np.int64)
    return {"whole": whole, "piece": piece, "anchor": anchor}


def rows_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Fragments of whole texts: text number, first and last start, anchor's place, hash of anchor and of content."""
    out = {k: [] for k in ("text", "first", "last", "at", "anchor", "content")}

    def add(raw: np.ndarray, number: np.ndarray, offset: np.ndarray, ok: np.ndarray) -> None:
        f = fragments(raw)
        a, t = f["anchor"], number[: len(ok)]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | ~ok[:-1] | (t[1:] != t[:-1])
        first = np.flatnonzero(fresh & ok)
        ends = np.append(np.flatnonzero(fresh | ~ok), len(a))
        last = ends[np.searchsorted(ends, first, side="right")] - 1
        at, o = a[first], offset[first]
        out["text"].append(t[first])
        out["first"].append(first + o)
        out["last"].append(last + o)
        out["at"].append(at + o)
        out["anchor"].append(f["piece"][at])
        out["content"].append(_mixed(_mixed(f["whole"][first]) * np.uint64(3) + f["whole"][last] * np.uint64(5) + (last - first).astype(np.uint64)))

    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            lengths = np.array([len(p) for _, _, p in held])
            begin = np.cumsum(lengths) - lengths
            number = np.repeat([i for i, _, _ in held], lengths)
            offset = np.repeat(np.array([o for _, o, _ in held]) - begin, lengths)
            m = int(lengths.sum()) - LENGTH + 1
            left = np.repeat(begin + lengths, lengths)[:m] - np.arange(m)
            add(np.frombuffer(b"".join(p for _, _, p in held), np.uint8), number, offset, left >= LENGTH)
        held, size = [], 0

    for i, raw in enumerate(texts):
        step = CHUNK - LENGTH + 1
        for o in range(0, len(raw) - LENGTH + 1, step):
            part = raw[o : o + CHUNK]
            if size + len(part) > CHUNK:
                flush()
            held.append((i, o, part))
            size += len(part)
    flush()
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("anchor", "content") else np.int64) for k, v in out.items()}


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each doc that touch or overlap."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = np.cumsum(new_doc) * (int(end.max()) + 1)  # so the running maximum of ends starts anew with each doc
    reach = np.maximum.accumulate(end + shift) - shift
    fresh = new_doc.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


# kinds of rows
SPAN, STRING = 0, 2
#: place of a fragment: first start, then 8 bits each of last - first and of the anchor's place - first; of a span: -1 - first, with its end in content.
SEEN = "anchor long, content long, doc long, place long"


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Documents and bytes of texts, in order of the documents."""
    tools("suffix", dict)
    docs = batch.column(0).to_numpy()
    order = np.argsort(docs, kind="stable")
    texts = batch.column(1).to_pylist()
    return docs[order], [texts[i].encode("utf-8", "surrogatepass") for i in order]


def common_anchors(long: DataFrame) -> np.ndarray:
    """All anchors of at least SHARE of the fragments, and none of less than half of that, so no more than 2 / SHARE.

    Each batch tells of anchors that have half of SHARE in it: what is kept back of an anchor is less than half of SHARE
    of all fragments."""
    ddl = "anchor long, n long, of long"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER):
            found, n = np.unique(rows_of(_texts(batch)[1])["anchor"].view(np.int64), return_counts=True)
            of, many = int(n.sum()), n >= SHARE / 2 * n.sum()
            of_each = np.zeros(int(many.sum()) + 1, np.int64)
            of_each[-1] = of  # the last row has the batch's count alone
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[many], 0)), pa.array(np.append(n[many], 0)), pa.array(of_each)], schema=arrow_schema(ddl))

    told = checkpointed(long.mapInArrow(counts, ddl).groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("of").alias("of")))
    of = told.agg(F.sum("of")).first()[0] or 0
    return np.array([r["anchor"] for r in told.where(F.col("n") >= max(2.0, SHARE / 2 * of)).select("anchor").collect()], np.int64)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the earliest of equal fragments, and to the spans of the others. doc is the number of the text's class."""
    schema = arrow_schema(SEEN)
    for batch in gathered(batches, GATHER):
        docs, texts = _texts(batch)
        f = rows_of(texts)
        doc = docs[f["text"]]
        o = np.lexsort((f["first"], doc, f["content"], f["anchor"]))
        again = np.zeros(len(o), bool)
        again[1:] = (f["anchor"][o[1:]] == f["anchor"][o[:-1]]) & (f["content"][o[1:]] == f["content"][o[:-1]])
        head = o[_heads(again)] if len(o) else o
        gone, kept = o[(doc[o] != doc[head]) | (f["first"][o] != f["first"][head])], o[~again]
        spans = merged_spans(doc[gone], f["first"][gone], f["last"][gone] + LENGTH)
        # spans ride along to the next step; their anchor only deals them out
        place = (f["first"][kept] << 16) | ((f["last"] - f["first"])[kept] << 8) | (f["at"] - f["first"])[kept]
        columns = ((_mixed(spans[0].astype(np.uint64) + spans[1].astype(np.uint64)), f["anchor"][kept]), (spans[2].astype(np.uint64), f["content"][kept]), (spans[0], doc[kept]), (-1 - spans[1], place))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in columns], schema=schema)


def _met(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by all their columns: later copies become spans; the earliest stay if their anchor has other contents, or is common and may have them elsewhere."""
    schema = arrow_schema(SEEN)
    held: np.ndarray | None = None  # the first fragment of the last anchor, if it may turn out to be its only one
    last = head = None  # the last fragment, and the earliest of its content

    for batch in gathered(batches, 4 << 20):
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        is_span = rows[:, 3] < 0
        emit, f = [rows[is_span]], rows[~is_span]
        if len(f):
            before = np.concatenate([[f[0] if last is None else last], f[:-1]])
            same = f[:, 0] == before[:, 0]
            copy = same & (f[:, 1] == before[:, 1])
            if last is None:
                same[0] = copy[0] = False
            heads = f[_heads(copy)]
            if copy[0]:
                heads[: len(copy) if copy.all() else int(copy.argmin())] = head
            head, last = heads[-1], f[-1]
            gone = f[copy & ((f[:, 2] != heads[:, 2]) | (f[:, 3] >> 16 != heads[:, 3] >> 16))]
            start = gone[:, 3] >> 16
            doc, start, end = merged_spans(gone[:, 2], start, start + (gone[:, 3] >> 8 & 255) + LENGTH)
            emit.append(np.stack([np.zeros(len(doc), np.int64), end, doc, -1 - start], axis=1))
            g, tied = f[~copy], same[~copy]  # tied: not the first content of its anchor
            if held is not None:
                g, tied = np.concatenate([held[None], g]), np.concatenate([[False], tied])
            if len(g):
                stays = tied | np.isin(g[:, 0], common)
                stays[:-1] |= tied[1:]
                held = g[-1] if not stays[-1] else None
                emit.append(g[stays])
        found = np.concatenate(emit)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(4)], schema=schema)


def squeezed(df: DataFrame, text: str) -> DataFrame:
    """df with a text column as zstandard frames of its bytes: whole texts cross the network twice, so they cross it small."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            frames = pa.array([None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([frames if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in df.schema]))


_EXPAND = zstandard.ZstdDecompressor()


def _digest(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16).digest()


def _cut(batch: pa.RecordBatch) -> dict[str, list]:
    """Fragments of a text in two, by the 66 bytes from the anchor on and those up to its end: (key, doc, first, bytes).

    Of common anchors, strings: the earliest in this batch as a digest, the others as spans, without bytes."""
    out = {"key": [], "doc": [], "first": [], "raw": []}

    def put(key: int, doc: int, first: int, raw: bytes | None) -> None:
        for c, v in zip(out.values(), (key, doc, first, raw), strict=True):
            c.append(v)

    earliest: dict[bytes, tuple[int, int]] = {}
    for doc, frame, found, common in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
        raw = _EXPAND.decompress(frame)
        for f in found:
            first = f >> 16
            last, at = first + (f >> 8 & 255), first + (f & 255)
            border = at - BESIDE  # starts up to here have BESIDE bytes before the anchor, later ones as many behind it
            for a, b, side, x in ((first, min(last, border), 1, border), (max(first, border + 1), last, 2, at)):
                if a <= b:
                    put(xxhash.xxh3_64_intdigest(raw[x : x + PIECE + BESIDE], side) - (1 << 63), doc, a, raw[a : b + LENGTH])
        for f in sorted(common):
            for a in range(f >> 16, (f >> 16) + (f >> 8 & 255) + 1):
                string, here = raw[a : a + LENGTH], (doc, a)
                before = earliest.setdefault(string, here)
                if before != here:
                    later = max(before, here)
                    earliest[string] = min(before, here)
                    put(xxhash.xxh3_64_intdigest(string, later[0] & _MASK) - (1 << 63), *later, None)
    for string, (doc, a) in earliest.items():
        put(xxhash.xxh3_64_intdigest(string) - (1 << 63), doc, a, _digest(string))
    return out


STRINGS = "kind int, doc long, first long, last long, string binary"


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, doc, first: suffix-sorts groups, many at once; the strings of groups too large go on as digests.
    Of equal digests all but the first become spans; rows without bytes are spans already."""
    schema = arrow_schema(STRINGS)
    ready: list[tuple[int, int, bytes]] = []
    group: list[tuple[int, int, bytes]] = []
    size, key, huge = 0, None, False

    def spans(rows) -> pa.RecordBatch:
        lengths = np.array([len(r[2]) for r in rows])
        begin = np.cumsum(lengths) - lengths
        many = lengths - LENGTH + 1
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(begin, many) + inner
        doc, place = (np.repeat(np.array([r[k] for r in rows], np.int64), many) for k in (0, 1))
        place = place + inner
        gone = repeats(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), starts, doc, place)
        d, a, b = merged_spans(doc[gone], place[gone], place[gone] + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), SPAN, np.int32)), pa.array(d), pa.array(a), pa.array(b), pa.nulls(len(d), pa.binary())], schema=schema)

    def strings(rows) -> pa.RecordBatch:
        doc, place, digest = [], [], []
        for d, first, raw in rows:
            for i in range(len(raw) - LENGTH + 1):
                doc.append(d)
                place.append(first + i)
                digest.append(_digest(raw[i : i + LENGTH]))
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, STRING, np.int32)), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array([p + LENGTH for p in place], pa.int64()), pa.array(digest, pa.binary())], schema=schema)

    first_of: dict[bytes, tuple[int, int]] = {}
    common_key = None
    for batch in batches:
        size_of = pc.fill_null(pc.binary_length(batch.column(3)), 0)
        later = batch.filter(pc.equal(size_of, 0))
        docs, firsts = (later.column(k).to_pylist() for k in (1, 2))
        for k, d, f, raw in zip(*(c.to_pylist() for c in batch.filter(pc.and_(pc.greater(size_of, 0), pc.less(size_of, LENGTH))).columns), strict=True):
            if k != common_key:
                first_of, common_key = {}, k
            if first_of.setdefault(raw, (d, f)) != (d, f):
                docs.append(d)
                firsts.append(f)
        if docs:
            first = np.array(firsts, np.int64)
            d, a, b = merged_spans(np.array(docs, np.int64), first, first + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), SPAN, np.int32)), pa.array(d), pa.array(a), pa.array(b), pa.nulls(len(d), pa.binary())], schema=schema)
        for k, *row in zip(*(c.to_pylist() for c in batch.filter(pc.greater_equal(size_of, LENGTH)).columns), strict=True):
            if k != key:
                if len(group) > 1 and not huge:
                    ready += group
                    size += sum(len(r[2]) for r in group)
                    if size >= SORTED:
                        yield spans(ready)
                        ready, size = [], 0
                elif huge and group:
                    yield strings(group)
                group, key, huge = [], k, False
            group.append(tuple(row))
            if len(group) > GROUP:
                yield strings(group)
                group, huge = [], True
    if huge and group:
        yield strings(group)
    elif len(group) > 1:
        ready += group
    if ready:
        yield spans(ready)


def _cleaned(frame: bytes | None, found: list[dict] | None) -> tuple[int, int, bytes]:
    """Bytes of the squeezed text, maximal removed runs, and the bytes left."""
    raw = _EXPAND.decompress(frame) if frame else b""
    first, last = (np.minimum(np.array([f[k] for f in found or ()], np.int64), len(raw)) for k in ("first", "last"))
    some = first < last
    _, start, end = merged_spans(np.zeros(int(some.sum()), np.int64), first[some], last[some])
    edges = [0, *(x for s, e in zip(start.tolist(), end.tolist(), strict=True) for x in (s, e)), len(raw)]
    return len(raw), len(start), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _spans(rows: DataFrame) -> DataFrame:
    """doc, first, last (exclusive) of repeats. rows: doc, text."""
    small_batches(rows.sparkSession)
    long = rows.where(F.octet_length("text") >= LENGTH)
    common = common_anchors(long)
    is_common = F.col("anchor").isin(common.tolist()) if len(common) else F.lit(False)
    dealt = long.mapInArrow(_seen, SEEN).repartition(F.when(is_common, F.xxhash64("anchor", "content")).otherwise(F.col("anchor")))
    met = checkpointed(dealt.sortWithinPartitions("anchor", "content", "doc", "place").mapInArrow(lambda batches: _met(batches, common), SEEN))
    listed = met.where("place >= 0").groupBy("doc").agg(F.collect_list(F.when(~is_common, F.col("place"))).alias("found"), F.collect_list(F.when(is_common, F.col("place"))).alias("common"))
    ddl = "key long, doc long, first long, raw binary"
    parts = arrow_map(squeezed(long, "text").join(listed, "doc").select("doc", "text", "found", "common"), _cut, arrow_schema(ddl), ddl, gather=TOGETHER)
    out = checkpointed(parts.repartition("key").sortWithinPartitions("key", "doc", "first").mapInArrow(_sorted_out, STRINGS))
    spans = met.where("place < 0").select("doc", (-1 - F.col("place")).alias("first"), F.col("content").alias("last")).union(out.where(F.col("kind") == SPAN).select("doc", "first", "last"))
    strings = out.where(F.col("kind") == STRING)
    if strings.limit(1).count():
        earliest = strings.groupBy("string").agg(F.min(F.struct("doc", "first")).alias("e"))
        later = strings.join(earliest, "string").where((F.col("e.doc") != F.col("doc")) | (F.col("e.first") != F.col("first")))
        spans = spans.union(later.select("doc", "first", "last"))
    return spans


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _with_spans(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with squeezed texts and the spans of each in one more column, whose name it returns."""
    least = F.lit(-(1 << 63) + 1).cast("long")
    doc, full = F.coalesce(F.col(key).cast("long"), least), F.coalesce(F.col(text), F.lit(""))
    found, number = unused(docs, "found"), unused(docs, "number")
    spans = _spans(docs.select(doc.alias("doc"), full.alias("text"))).groupBy(F.col("doc").alias(number)).agg(F.collect_list(F.struct("first", "last")).alias(found))
    return squeezed(docs.withColumn(number, doc), text).join(spans, number, "left").drop(number), found


def repeats_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row for every row of docs."""

    def rows(batch):
        out = {c.split()[0]: [] for c in RESULT.split(", ")}
        for doc, t, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size, runs, left = _cleaned(t, found)
            for k, v in zip(out, (doc, size, size - len(left), runs, hashlib.sha256(left).hexdigest()), strict=True):
                out[k].append(v)
        return out

    joined, found = _with_spans(docs.select(F.col(key).cast("long").alias(key), text), key, text)
    return arrow_map(joined.select(key, text, found), rows, arrow_schema(RESULT), RESULT)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with what is left of each text; bytes of characters that a removal cuts in two go as well."""
    names = docs.columns
    joined, found = _with_spans(docs, key, text)
    joined = joined.select(*(F.col(f"`{c}`") for c in (*names, found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index(text)
            pairs = zip(batch.column(i).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            left = [None if t is None else _cleaned(t, found)[2].decode("utf-8", "ignore") for t, found in pairs]
            columns = [pa.array(left, pa.string()) if k == i else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
