"""Best-fit packing of tokenized documents into sequences, by bin completion.

Every document becomes its ids and one end id; what is longer than a sequence is cut. Lengths
are whole numbers up to the capacity, so the packing needs their counts only, at most as many
as the capacity, however large the table: the driver solves that, and no piece leaves the
executors. Bin completion: around the largest length left, enumerate the fillings that none other
dominates, lazily, least waste first (the next waste is looked at only when all fillings of the
one before are used up); apply one as often as the counts allow, then once less often, and so on,
depth first; a branch ends when its waste can't beat the incumbent. The first incumbent is best-fit
decreasing. Nothing but STEPS bounds the search, the same for all inputs; what is best by then is
the result, a list of patterns with multiplicities that packs every piece. A piece
finds its place from its rank among the pieces of its length, counted in salted buckets, so a
length that a third of all pieces share is spread over many tasks.

Defined results: null is the empty text, which is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are not looked at. Pieces of
one length are exchangeable: which of them goes where follows a hash of doc_id and piece.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.bpe import UNSURE, printable_bytes
from veriloom.llm.common import Remembered, arrow_map, arrow_schema, checkpointed, small_batches, tools

CAPACITY, END = 2048, 0
#: Buckets that the pieces of one length are dealt to for ranking.
BUCKETS = 256
#: Steps of the search: a node counts NODE, a step of the enumeration 1. Levels whose enumeration is held.
STEPS, NODE, HELD = 1_000_000, 20, 32
#: Bytes of chunks remembered by a worker, and of words within them; of an entry besides its text and ids; bytes of text worked on at once.
CHUNKS, WORDS, ENTRY, GATHER = 128 << 20, 48 << 20, 200, 4 << 20


class WordIds:
    """Ids of a tokenizers file that lower-cases and drops white space; chunks between white space are worked out once."""

    def __init__(self, path: str):
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # fixed value: the vocabulary's word pattern
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.letter = {b: c for c, b in printable_bytes().items()}
        self.chunks: dict[str, bytes] = Remembered(CHUNKS)
        self.coded: dict[str, bytes] = Remembered(WORDS)

    def ids(self, w: str) -> bytes:
        shown = w if w.isascii() and w.isprintable() else "".join(map(self.letter.__getitem__, w.encode("utf-8", "surrogatepass")))
        found = array("I", [t.id for t in self.whole.model.tokenize(shown)])
        return found.tobytes() if sys.byteorder == "little" else np.array(found, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        """A word of a chunk; words that are chunks themselves are remembered there alone."""
        if (known := self.chunks.get(w) or self.coded.get(w)) is None:
            known = self.coded[w] = self.ids(w)
            self.coded.bytes += ENTRY + len(w) + len(known)
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks.trim()
        self.coded.trim()
        cut = []
        for t in texts:
            if any(s in t for s in self.special) or any(c in t for c in "\x1c\x1d\x1e\x1f") or not t.isascii() and UNSURE.search(t):
                cut.append(None)  # special tokens, controls that Python alone takes for white space, and letters of some Unicode versions only
                continue
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")  # the library lower-cases letter by letter
            cut.append(t.lower().split())
        new: set[str] = set()
        for c in cut:
            new.update(c or ())
        new = {c for c in new if c not in self.chunks}
        chunks, word, words = self.chunks, self.word, self.words.findall
        size = 0
        for c in new:
            if c.isalpha():  # one word of letters
                known = self.coded.get(c) or self.ids(c)
            else:
                known = b"".join(map(word, words(c)))
            chunks[c] = known
            size += len(c) + len(known)
        chunks.bytes += size + ENTRY * len(new)
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if c is None else b"".join(map(chunks.__getitem__, c)) for c, t in zip(cut, texts, strict=True)]


def coder(path: str) -> WordIds:
    return tools(f"packing {path}", lambda: WordIds(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row a piece; with keep_ids also its ids, as little-endian unsigned 32-bit integers."""
    small_batches(df.sparkSession)
    ddl = PIECES + ", ids binary" * keep_ids
    end = np.array([END], "<u4").tobytes()

    def rows(batch):
        out = {c.split()[0]: [] for c in ddl.split(", ")}
        docs, texts = (c.to_pylist() for c in batch.columns)
        for doc, ids in zip(docs, coder(path).encode([t or "" for t in texts]), strict=True):
            ids += end
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for k, v in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                    out[k].append(v)
        return out

    return arrow_map(df.select(key, text), rows, arrow_schema(ddl), ddl, gather=GATHER)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed: by total length, and by what can't share a bin with pieces over half of it."""
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in size], np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for k in [*size[size <= capacity // 2].tolist(), 0]:
        alone = size > capacity - k
        large = ~alone & (2 * size > capacity)
        small = ~alone & ~large & (size >= k)
        room = int((n * (capacity - size))[large].sum())
        best = max(best, int(n[alone | large].sum()) + max(0, -(-(int((n * size)[small].sum()) - room) // capacity)))
    return best


class _Spent(Exception):
    """The search has used up its steps."""


class _Steps:
    def __init__(self, most: int):
        self.left = most

    def take(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise _Spent


def _times(reach: int, size: int, count: int, mask: int) -> int:
    """The sums (bits) that up to count more of a size can make of the sums in reach."""
    step = 1
    while count > 0 and size <= mask.bit_length():
        step = min(step, count)
        reach |= (reach << size * step) & mask
        count -= step
        step *= 2
    return reach


def fillings(counts: dict[int, int], room: int, waste: int | None = None, steps: _Steps | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated sets of lengths for the room, lazily: least waste first (none above the given), then larger lengths.

    A filling is dominated if some of its lengths (or none) could be taken out for one unused length at least as large as
    they are together, and it still fits. Within a waste, the search goes from large lengths to small ones over the sums
    that the rest can make, and leaves a branch as soon as such an exchange is sure."""
    steps = steps or _Steps(1 << 62)
    sizes = sorted((s for s, n in counts.items() if n > 0 and s <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # reach[-1 - i]: sums that the i smallest sizes can make
    for s in reversed(sizes):
        reach.append(_times(reach[-1], s, min(counts[s], room // s), mask))
    reach.reverse()
    unused_all = sum(1 << s for s in sizes)

    def swaps(sums: int, unused: int, slack: int) -> bool:
        """Whether an unused length lies at most slack above one of the sums, or on it."""
        return bool(_times(sums, 1, slack, mask) & unused)

    def below(i: int, left: int, slack: int, chosen: tuple[int, ...], sums: int, unused: int) -> Iterator[tuple[int, ...]]:
        if not left:
            steps.take()
            if not any(unused >> s & 1 for s in sizes if s <= slack):  # nothing fits into the waste
                yield chosen
            return
        for j in range(i, len(sizes)):
            if not reach[j] >> left & 1:
                return
            s = sizes[j]
            for k in range(min(counts[s], left // s), 0, -1):
                steps.take()
                if not reach[j + 1] >> (left - k * s) & 1:
                    continue
                new = sums << s  # sums of chosen lengths with one of these among them, or several
                for _ in range(k - 1):
                    new |= new << s
                left_over = unused & ~(1 << s) if k == counts[s] else unused
                # a length alone isn't swapped for its like
                if swaps(new & ~(1 << s), left_over, slack) or swaps(1 << s, left_over & ~(1 << s), slack):
                    continue
                yield from below(j + 1, left - k * s, slack, (*chosen, *(s,) * k), sums | new, left_over)

    for slack in range(min(room, room if waste is None else waste) + 1):
        if reach[0] >> (room - slack) & 1:
            yield from below(0, room - slack, slack, (), 1, unused_all)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins of equal content are kept together, so the work follows the number of lengths, not of pieces."""
    open_bins: Counter[tuple[int, ...]] = Counter()
    by_room: dict[int, list[tuple[int, ...]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = next((r for r in range(size, capacity) if by_room.get(r)), None)
            if room is None:
                k = capacity // size
                for per, m in ((k, left // k), (left % k, 1)):
                    if per and m:
                        bins = (size,) * per
                        open_bins[bins] += m
                        by_room.setdefault(capacity - size * per, []).append(bins)
                break
            bins = by_room[room].pop()
            m, per = open_bins.pop(bins), min(room // size, left)
            n = min(m, left // per)
            if m > n:
                open_bins[bins] = m - n
                by_room[room].append(bins)
            fuller = bins + (size,) * per
            if fuller not in open_bins:
                by_room.setdefault(room - size * per, []).append(fuller)
            open_bins[fuller] += n
            left -= n * per
    return list(open_bins.items())


def bin_completion(counts: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one bin, number of such bins). steps bounds the search, never what is packed."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    best = best_fit_decreasing(counts, capacity)
    least, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    fewest = sum(m for _, m in best)
    budget, left = _Steps(steps), dict(counts)
    path: list[tuple[tuple[int, ...], int]] = []
    waste = used = 0

    def applications() -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings around the largest length left, each as often as the counts allow, then less often."""
        budget.take(NODE)
        big = max(s for s, n in left.items() if n)
        rest = {s: n - (s == big) for s, n in left.items() if n}
        for f in fillings(rest, capacity - big, (fewest - 1) * capacity - total - waste, budget):
            bins = (big, *f)
            for m in range(min(left[s] // k for s, k in Counter(bins).items()), 0, -1):
                yield bins, m

    def put(bins: tuple[int, ...], m: int) -> None:
        nonlocal waste, used
        for s, k in Counter(bins).items():
            left[s] -= m * k
        waste += m * (capacity - sum(bins))
        used += m

    # levels of the search: fillings still to come, and how many were taken. Only the last HELD levels hold theirs; others
    # are enumerated anew, up to where they were, when the search comes back to them
    stack: list[list] = []
    try:
        if fewest > least:
            stack.append([applications(), 0])
        while stack and fewest > least:
            if len(path) == len(stack):  # back from below
                bins, m = path.pop()
                put(bins, -m)
            level = stack[-1]
            if level[0] is None:
                level[0] = applications()
                for _ in range(level[1]):
                    next(level[0], None)
            choice = next(level[0], None)
            level[1] += 1
            if choice is None:
                stack.pop()
                continue
            budget.take()
            bins, m = choice
            if waste + m * (capacity - sum(bins)) > (fewest - 1) * capacity - total:
                continue  # no better than the incumbent, whatever follows
            put(bins, m)
            path.append(choice)
            if not any(left.values()):
                best, fewest = list(path), used
            else:
                stack.append([applications(), 0])
                if len(stack) > HELD:
                    stack[-1 - HELD][0] = None
    except _Spent:
        pass
    return best


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: first rank, copies a bin, first bin, offset of the first copy."""
    rows, taken, base = [], Counter(), 0
    for bins, m in patterns:
        offset = 0
        for size, k in sorted(Counter(bins).items(), reverse=True):
            rows.append((size, taken[size], k, base, offset))
            taken[size] += m * k
            offset += size * k
        base += m
    size, first, k, base_, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return {"key": (size << 44) + first, "first": first, "k": k, "base": base_, "offset": offset}


def pack(rows: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    salted = checkpointed(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")))
    counted = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # at most one row for each length up to the capacity
    counts = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [c for c in rows.columns]
    if not counts:
        return rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = slots(bin_completion(counts, capacity))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("within", F.row_number().over(within)).join(counted.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select(*names, (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(table["key"], (size << 44) + rank, side="right") - 1
            bin_, copy = np.divmod(rank - table["first"][i], table["k"][i])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table["base"][i] + bin_), pa.array(table["offset"][i] + copy * size)], names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(place, ddl + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from packed pieces with ids; a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))
