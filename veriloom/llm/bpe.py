"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a byte string that ends in token t consists of the encoding of what stands
before t, then t, provided that t and the token before it are stable neighbours (encoding
their concatenation gives just the two). So a prefix's encoding is fixed by its last token.
New distinct words go into a trie; a depth-first walk carries the last tokens of all prefixes
on the path, so prefixes that words share are worked out once.

Words come from the public byte-level pattern. Texts are first cut where a word boundary is
certain (before a single space or around a single line feed between visible characters), and
a worker remembers the ids of the pieces met so far, up to CACHE bytes; then it forgets all.

Defined results: null is the empty text (no ids); the strings of special tokens in a text get
their ids; equal texts give equal ids; repeated rows are kept; empty tables give no rows; other
columns are not looked at. Memory: one batch of texts, the cache and the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame

from veriloom.llm.common import Remembered, arrow_map, arrow_schema, small_batches, tools

#: Bytes of pieces remembered by a worker.
CACHE = 128 << 20
#: Bytes of text whose words go into one trie.
GATHER = 16 << 20
#: Bytes of words remembered by a worker, besides.
WORDS = 96 << 20
#: Pairs of neighbours remembered.
PAIRS = 400_000
#: Fixed value: the public word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters outside ranges whose letters and numerals all Unicode versions in use agree on: texts that have one are cut by the tokenizers library.
UNSURE = re.compile("[^\x00-\u052f\u2000-\u206f\u20a0-\u20bf\u3000-\u3029\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f9ff]")


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 as itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """The vocabulary of a tokenizers file of kind byte-level BPE, its trie walk and its cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = printable_bytes()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw and t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(self.ids[raw[a]], self.ids[raw[b]]): (r, self.ids[raw[a + b]]) for r, (a, b) in enumerate(pairs)}
        self.made = {token: (r, a, b) for (a, b), (r, token) in reversed(self.rank.items())}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: Tokens that can end an encoding: those which encode as themselves.
        self.sound: dict[int, bool] = {}
        self.ends = {b: i for b, i in self.ids.items() if self.is_sound(i)}
        self.longest = max(map(len, self.ends))
        self.stable: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(PATTERN)
        self.cutter = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.letters = letters
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = Remembered(CACHE)
        self.coded: dict[str, bytes] = Remembered(WORDS)
        self.first: dict[str, bytes] = Remembered(CACHE // 8)

    def is_sound(self, token: int) -> bool:
        """The token encodes as itself: its halves do, and none but its own merge crosses their border in time."""
        if token not in self.made:
            return len(self.bytes_of[token]) == 1
        if token not in self.sound:
            _, a, b = self.made[token]
            crossing = ((x, y) for x, y in self.crossings(a, b) if (x, y) != (a, b))
            self.sound[token] = self.is_sound(a) and self.is_sound(b) and not any(crossing)
        return self.sound[token]

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge (1 left, 2 right) while BPE builds the token, each with the rank of the merge that consumes it."""
        out, gone = [], float("inf")
        while True:
            out.append((token, gone))
            if token not in self.made:
                return out
            gone, token = self.made[token][0], self.made[token][side]

    def crossings(self, a: int, b: int):
        """Merges across the border that come before the merges that consume their two sides; of equal ranks, the leftmost is first."""
        rank, left = self.rank, self.spine(b, 1)
        return [(x, y) for x, gone_x in self.spine(a, 2) for y, gone_y in left if (p := rank.get((x, y))) and p[0] < gone_x and p[0] <= gone_y]

    def neighbours(self, a: int, b: int) -> bool:
        if (known := self.stable.get((a, b))) is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            known = self.stable[a, b] = not self.crossings(a, b)
        return known

    def walk(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words. Sorted words are the trie in depth-first order: what two neighbours share is a common path from the root."""
        out, path, last = {}, b"", [-1]
        ends, longest, neighbours, bytes_of = self.ends, self.longest, self.neighbours, self.bytes_of
        for word in sorted(words):
            same, top = 0, min(len(path), len(word))
            while same < top and path[same] == word[same]:
                same += 1
            del last[same + 1 :]
            for n in range(same + 1, len(word) + 1):
                for start in range(max(0, n - longest), n):
                    t = ends.get(word[start:n])
                    if t is not None and (start == 0 or neighbours(last[start], t)):
                        last.append(t)
                        break
            path, n, back = word, len(word), []
            while n:
                back.append(last[n])
                n -= len(bytes_of[last[n]])
            out[word] = back[::-1]
        return out

    def split(self, text: str) -> list[str]:
        if text.isascii() or not UNSURE.search(text):
            return self.words.findall(text)
        return [bytes(map(self.letters.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self.cutter.pre_tokenize_str(text)]

    def _learn(self, pieces: dict[str, list[str]], cache: Remembered) -> None:
        self.coded.trim()
        coded = self.coded
        new = {w.encode("utf-8", "surrogatepass"): w for ws in pieces.values() for w in ws if w not in coded}
        for word, ids in self.walk(new).items():
            coded[new[word]] = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
        coded.told(new.values())
        for piece, ws in pieces.items():
            cache[piece] = b"".join([coded[w] for w in ws])
        cache.told(pieces)

    def learn(self, missing: set[str]) -> None:
        """A piece stands after a space that is not part of its key, or else begins with its line feed."""
        self._learn({p: ["\n", *self.words.findall(p[1:])] if p[:1] == "\n" else self.words.findall(" " + p) for p in missing}, self.known)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts without special tokens."""
        self.known.trim()
        self.first.trim()
        cut: list[list[str] | None] = []
        for t in texts:
            # one separator between any two runs of visible characters, and each a space or a line feed
            runs = t.split()
            even = runs and (t.isascii() or not UNSURE.search(t)) and len(runs) == t.count(" ") + t.count("\n") + 1 == len(t) - sum(map(len, runs)) + 1
            cut.append(t.replace("\n", " \n").split(" ") if even else None)
        missing: set[str] = set()
        for pieces in cut:
            if pieces:
                missing.update(pieces[1:])
        missing = {x for x in missing if x not in self.known}
        if missing:
            self.learn(missing)
        heads = {p[0] if p else t for p, t in zip(cut, texts, strict=True)}
        whole = {h: self.split(h) for h in heads if h not in self.first}
        self._learn(whole, self.first)
        known, first = self.known, self.first
        out = [first[p[0]] + b"".join([known[x] for x in p[1:]]) if p else first[t] for p, t in zip(cut, texts, strict=True)]
        for p, t in zip(cut, texts, strict=True):
            if p is None and len(t) > 64:  # whole odd texts would swell the cache
                first.pop(t, None)  # still counted: forgotten a little earlier
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.between is None or not any(s in t for t in texts for s in self.special):
            return self.plain(texts)
        parts = [self.between.split(t) for t in texts]
        ids = iter(self.plain([x for p in parts for x in p if x and x not in self.special]))
        code = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        return [b"".join([code[x] if x in code else next(ids) for x in p if x]) for p in parts]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return tools(f"bpe {path}", lambda: Encoder(path))


ENCODED = "doc_id long, ids binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its ids, as binary of little-endian unsigned 32-bit integers."""
    small_batches(df.sparkSession)

    def rows(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        return {"doc_id": ids, "ids": encoder(path).encode([t or "" for t in texts])}

    return arrow_map(df.select(key, text), rows, arrow_schema(ENCODED), ENCODED, gather=GATHER)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 become U+FFFD."""

    def rows(batch):
        ids, coded = (c.to_pylist() for c in batch.columns)
        return {"doc_id": ids, "text": [encoder(path).decode(x) for x in coded]}

    return arrow_map(encoded.select("doc_id", "ids"), rows, arrow_schema("doc_id long, text string"), "doc_id long, text string")


def bpe_digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes the ids again, and gives lengths and hashes of both: one pass, so no ids travel."""
    small_batches(df.sparkSession)

    def rows(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        coded = encoder(path).encode([t or "" for t in texts])
        back = (encoder(path).decode(x).encode("utf-8", "surrogatepass") for x in coded)
        return {"doc_id": ids, "n_tokens": [len(x) // 4 for x in coded], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded], "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in back]}

    return arrow_map(df.select(key, text), rows, arrow_schema(DIGEST), DIGEST, gather=GATHER)
