"""Language by unigram pieces, with the segmentation summed out.

For each language there is a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all ways to cut it into pieces of the product of their
probabilities, which a forward algorithm gives without listing them; a text's is the product over
its words. The piece probabilities come from a few rounds of expectation-maximisation over the
words of at most SAMPLE texts of each language, those of least id hash, of SAMPLE_BYTES in all
(a text that would go beyond is passed over; words of more than LONGEST characters are cut into
parts of that length, for learning only); prediction covers all texts and whole words.
Language, source and id are no inputs of a prediction.

Texts are lower-cased and cut at white space; a word begins with the vocabulary's word mark; all
pieces of the vocabulary take part, of whatever length; a character that no piece covers has a
small fixed share. Words of at most LONGEST characters are scored many at once; a longer one on its
own, place by place with a scale kept apart, in sections, so that no length underflows or fills memory.

Defined results: a text that is null or has no letter is `und` with score 0; so is all if no text
teaches; ties go to the language first in order; the score is the posterior if the text had at
most EVIDENCE words like its average; repeated rows are kept; empty tables give no rows; other
columns are not looked at. Memory: one batch, the model and a cache of words bounded by CACHE bytes.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import Remembered, arrow_map, arrow_schema, fold, give_back, keep_rows, least_hashed, small_batches, tools, within_bytes

#: Texts of each language that are learnt from, at most, their bytes together, and rounds of learning.
SAMPLE, SAMPLE_BYTES, ROUNDS = 400, 64 << 20, 3
LEARN_MODULUS, HELD_OUT = 5, 0
#: Characters of a word scored beside others; of a section of a longer one; words that a posterior counts; bytes of words remembered; bytes of text whose words are scored at once.
LONGEST, SECTION, EVIDENCE, CACHE, GATHER = 32, 1 << 16, 20, 64 << 20, 4 << 20
#: Words whose lattices are held at once.
WORDS = 8_192
MARK, UNKNOWN, UND = "▁", 1e-6, "und"
BASE, SPREAD, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 22


def vocabulary(path: str) -> list[str]:
    """Lower-cased pieces of the vocabulary that can match within a word: word mark in front only."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return sorted(p for p in found if p and MARK not in p[1:])


class Matcher:
    """Finds all pieces in a run of words by hashes of windows, all positions at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last stands for unknown characters
        self.keys, self.index = [], []
        self.seen = np.zeros(1 << BITS, bool)
        self.longest = max(map(len, pieces), default=1)
        for n in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * BASE + codes[:, k] + np.uint64(1)
            order = h.argsort()
            self.keys.append(h[order])
            self.index.append(np.array(own, np.int64)[order])
            self.seen[self._slot(h, n)] = True

    @staticmethod
    def _slot(h: np.ndarray, n: int) -> np.ndarray:
        return ((h ^ np.uint64(n)) * SPREAD >> np.uint64(64 - BITS)).astype(np.int64)

    def lattice(self, words: list[str]):
        """Starts of words, their ends, and the edges (start, length, piece) sorted by place in the word and length."""
        codes = np.frombuffer((MARK + MARK.join(words) + MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        marks = np.flatnonzero(codes == ord(MARK))
        begin, end = marks[:-1], marks[1:]
        place = np.arange(len(codes)) - np.repeat(marks, np.diff([*marks, len(codes)]))
        start, length, piece = self.edges(codes)
        inside = start < len(codes) - 1
        start, length, piece = start[inside], length[inside], piece[inside]
        order = np.lexsort((length, place[start] + length))
        return begin, end, start[order], length[order], piece[order], (place[start] + length)[order]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and number of every piece that matches, and of the unknown characters."""
        h = np.zeros(len(codes), np.uint64)
        edges = []
        for n in range(1, min(self.longest, len(codes)) + 1):
            h = h[: len(codes) - n + 1] * BASE + codes[n - 1 :] + np.uint64(1)
            if not len(self.keys[n - 1]):
                continue
            at = np.flatnonzero(self.seen[self._slot(h, n)])
            i = np.minimum(np.searchsorted(self.keys[n - 1], h[at]), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][i] == h[at]
            at, i = at[hit], i[hit]
            edges.append((at, np.full(len(at), n), self.index[n - 1][i]))
            if n == 1:
                lone = np.ones(len(codes), bool)
                lone[at] = False
                miss = np.flatnonzero(lone)
                edges.append((miss, np.ones(len(miss), np.int64), np.full(len(miss), self.size - 1)))
        return tuple(np.concatenate(x) for x in zip(*edges, strict=True))


def groups(ends: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of edges with one end place and length: no two of a run meet."""
    cut = np.flatnonzero((np.diff(ends) != 0) | (np.diff(lengths) != 0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(ends)], strict=True)) if len(ends) else []


def forward(lattice, p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    begin, end, start, length, piece, place = lattice
    alpha = np.zeros((int(end[-1]) + 1, p.shape[1]))
    alpha[begin] = 1
    # the place where a word ends is where the next begins: ends are kept apart
    final = np.zeros_like(alpha)
    runs = groups(place, length)
    is_end = np.zeros(len(alpha), bool)
    is_end[end] = True
    for a, b in runs:
        to = start[a:b] + length[a:b]
        value = alpha[start[a:b]] * p[piece[a:b]]
        last = is_end[to]
        alpha[to[~last]] += value[~last]
        final[to[last]] += value[last]
    return np.concatenate([alpha, final[end]]), runs


def word_scores(words: list[str], matcher: Matcher, p: np.ndarray) -> np.ndarray:
    """Log-probabilities of words, a column a language; no word is longer than LONGEST."""
    lattice = matcher.lattice(words)
    alpha, _ = forward(lattice, p)
    return np.log(alpha[len(alpha) - len(words) :])


def long_score(word: str, matcher: Matcher, p: np.ndarray) -> np.ndarray:
    """Log-probabilities of a word of any length. held: probability mass at the next places, over a scale kept apart."""
    codes = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, width = len(codes), matcher.longest + 1
    held, scale = np.zeros((width, p.shape[1])), np.zeros(p.shape[1])
    held[0] = 1
    for a in range(0, n, SECTION):
        many = min(SECTION, n - a)
        start, length, piece = matcher.edges(codes[a : a + many + matcher.longest - 1])
        order = np.argsort(start, kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        ends = np.searchsorted(start, np.arange(many), side="right").tolist()
        flow, to = p[piece], length + start + a
        i = 0
        for at in range(many):
            j, here = ends[at], (a + at) % width
            held[to[i:j] % width] += held[here] * flow[i:j]
            held[here] = 0
            if at % 8 == 7:
                top = held.max(axis=0)
                held /= top
                scale += np.log(top)
            i = j
    return np.log(held[n % width]) + scale


def parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def words_of(text: str) -> list[str]:
    return text.lower().replace(MARK, " ").split()


@dataclass
class Model:
    pieces: list[str]
    langs: list[str]
    p: np.ndarray = field(repr=False)  # pieces and unknown by languages
    token: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False)  # tells models apart in workers


def learn(counts: dict[str, Counter], path: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from word counts of each language."""
    pieces, langs = vocabulary(path), sorted(counts)
    matcher = Matcher(pieces)
    words = sorted(set().union(*counts.values()) if counts else ())
    n = np.array([[counts[g][w] for g in langs] for w in words], float).reshape(len(words), len(langs))
    p = np.full((matcher.size, len(langs)), 1 / matcher.size)
    for _ in range(rounds if words else 0):
        seen = np.zeros_like(p)
        for at in range(0, len(words), WORDS):
            lattice = matcher.lattice(words[at : at + WORDS])
            begin, end, start, length, piece, _ = lattice
            alpha, runs = forward(lattice, p)
            total = alpha[len(alpha) - len(begin) :]
            beta = np.zeros((int(end[-1]) + 1, len(langs)))
            word = np.searchsorted(begin, np.arange(len(beta)), side="right") - 1
            is_end = np.zeros(len(beta), bool)
            is_end[end] = True
            weight = n[at : at + WORDS] / total
            for a, b in reversed(runs):
                to = start[a:b] + length[a:b]
                after = np.where(is_end[to][:, None], 1.0, beta[to])
                flow = p[piece[a:b]] * after
                beta[start[a:b]] += flow
                gain = alpha[start[a:b]] * flow * weight[word[start[a:b]]]
                for g in range(len(langs)):
                    seen[:, g] += np.bincount(piece[a:b], gain[:, g], matcher.size)
        shared = seen.sum(axis=1, keepdims=True) + 0.01
        seen += 0.5 * len(langs) * shared / shared.sum() * 100  # a language borrows a little from all
        p = seen / seen.sum(axis=0)
        p[-1] = np.maximum(p[-1], UNKNOWN)
    return Model(pieces, langs, p)


class Scorer:
    def __init__(self, model: Model):
        self.matcher, self.p, self.langs = Matcher(model.pieces), model.p, model.langs
        self.row: dict[str, int] = Remembered(CACHE)
        self.table = np.zeros((1 << 16, len(self.langs)))

    def known(self, words: set[str]) -> dict[str, np.ndarray]:
        """Scores words that are new, and gives those too long to remember."""
        new = sorted(w for w in words if w not in self.row and len(w) <= LONGEST)
        for at in range(0, len(new), WORDS):
            some = new[at : at + WORDS]
            n = len(self.row)
            while n + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(some)] = word_scores(some, self.matcher, self.p)
            self.row.update(zip(some, range(n, n + len(some)), strict=True))
            self.row.told(some, 16 * len(self.langs))
        return {w: long_score(w, self.matcher, self.p) for w in words if len(w) > LONGEST}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.row.trim():
            self.table = np.zeros((1 << 16, len(self.langs)))
        cut = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        apart = self.known(set().union(*cut)) if self.langs else {}
        out = []
        for words in cut:
            if not words or not self.langs:
                out.append((UND, 0.0))
                continue
            rows = [r for w in words if (r := self.row.get(w)) is not None] if apart else list(map(self.row.__getitem__, words))
            total = self.table[np.array(rows, np.int64)].sum(axis=0)
            for w in words if apart else ():
                if w in apart:
                    total = total + apart[w]
            best = int(total.argmax())
            z = (total - total[best]) * min(1.0, EVIDENCE / len(words))
            out.append((self.langs[best], float(1 / np.exp(z).sum())))
        return out


def train(docs: DataFrame, path: str, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows outside the held-out fold; the words of the chosen rows come to the driver, counted."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (fold(key, LEARN_MODULUS) != HELD_OUT))
    least = least_hashed(rows.select(F.col(key).alias("k"), F.col(lang).alias("g")), sample)
    ids = within_bytes(rows, [k for one in zip_longest(*least.values()) for k in one if k is not None], SAMPLE_BYTES, key, text)
    counts: dict[str, Counter] = {}
    if ids:
        chosen = rows.where(F.col(key).isin(ids)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        ddl = "lang string, word string, n long"

        def count(batch):
            found = Counter()
            for g, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update((g, x) for w in words_of(t or "") for x in parts(w))
            return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

        for batch in arrow_map(chosen, count, arrow_schema(ddl), ddl).groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_batches(max_chunksize=8192):
            for g, w, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(g, Counter())[w] = k
    model = learn(counts, path)
    del counts
    give_back()
    return model


PREDICTED = "doc_id long, lang_pred string, score double"


def _scorer(shared) -> Scorer:
    return tools(f"langid {shared.value.token}", lambda: Scorer(shared.value))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages, bounded by the vocabulary

    def rows(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        found = _scorer(shared).predict(texts)
        return {"doc_id": ids, "lang_pred": [g for g, _ in found], "score": [s for _, s in found]}

    return arrow_map(docs.select(key, text), rows, arrow_schema(PREDICTED), PREDICTED, gather=GATHER)


def keep(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """Rows whose language is known with at least this score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts):
        return [g != UND and s >= least for g, s in _scorer(shared).predict(texts)]

    return keep_rows(docs, text, good, GATHER)
