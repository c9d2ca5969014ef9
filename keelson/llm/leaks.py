"""Finds documents that hold items of a benchmark, also edited or paraphrased.

Texts become lower-cased runs of letters and digits. Of every few consecutive n-grams of an item the one that the fewest
documents have is a seed, counted over all documents, so that each part of an item has seeds however often the item
has leaked. Where a document has enough seeds of an item, Smith-Waterman alignment of the words around them with the item
gives the score: 2 for a match, -1 for a mismatch or a gap, as a share of what the whole item would score.

Edits in every n-gram leave no such seed, so single words are seeds too, and these miss no leak: a score of LEAK takes matches of
that share of an item's words, hence some of any larger rest of them, for which its rarest words are taken; and the run of
the document's words that it spans scores as much even if every word of it that the item has is taken for a match, and has
that many of the item's words.

The benchmark is a query set that is read in parts of bounded size; the documents pass each part and are never shuffled.

Defined results: a null or empty text holds nothing; items without words are never held; of items with the same score
the smallest id counts; repeated rows each give a row; an empty table gives an empty one, an empty benchmark no leaks; of
the input's columns those with the names of new ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cover import runs
from .words import chunks, joined, xxh64

#: Words of a seed; of so many consecutive n-grams the rarest is one; bytes of the benchmark in a part; share of an item's score that is a leak.
NGRAM, WITHIN, PART, LEAK = 3, 2, 8 << 20, 0.5
#: A document is aligned with an item if it has this share of its seeds, one at least.
SEEDS = 0.08
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NEW = [("n_items", T.LongType()), ("item_id", T.LongType()), ("score", T.DoubleType()), ("leaked", T.BooleanType())]


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the hash of each n-gram (0 where the text has no whole one), and where each text's words begin."""
    parts, sizes = [], []
    raw = [(t or "").encode().translate(NORMAL) for t in texts]
    for a, b in chunks([len(t) for t in raw], 1 << 20):
        flat, starts, ends, of = joined(raw[a:b])
        parts.append(xxh64(flat, starts, ends))
        sizes.append(np.bincount(of, minlength=b - a) if len(of) else np.zeros(b - a, int))
    words = np.concatenate([np.zeros(0, np.uint64), *parts])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, int), *sizes]))]).astype(int)
    grams = np.zeros(len(words), np.uint64)
    if len(words) >= NGRAM:
        grams[: len(words) - NGRAM + 1] = runs(words, NGRAM)
        over = (starts[1:, None] - np.arange(1, NGRAM)).ravel()
        grams[over[over >= 0]] = 0
    return words, grams, starts


def align(item: np.ndarray, words: np.ndarray) -> int:
    """The Smith-Waterman score of the two sequences."""
    place = np.arange(len(words) + 1)
    row, best = np.zeros(len(words) + 1, np.int64), 0
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == w, 2, -1))
        row = np.maximum.accumulate(new + place) - place
        best = max(best, int(row.max()))
    return best


class Known:
    """Sorted distinct hashes, with a table of their low bits that tells most others apart in one look."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << max(16, (4 * len(hashes)).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[hashes & self.mask] = True

    def find(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known ones are, and the place of each."""
        at = np.nonzero(self.table[among & self.mask])[0]
        place = np.searchsorted(self.hashes, among[at])
        sure = self.hashes[np.minimum(place, len(self.hashes) - 1)] == among[at] if len(self.hashes) else place < 0
        return at[sure], place[sure]


class Items:
    """A part of the benchmark: the words of each item, and its seeds."""

    def __init__(self, rows: list[tuple[int, str]], leak: float = LEAK):
        self.leak = leak
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        self.ids = [r[0] for r in rows]
        words, grams, starts = hashed([r[1] for r in rows])
        self.words = [words[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.grams = [g[g > 0] if (g := grams[a:b]).any() else g[:0] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.vocabulary, self.times = zip(*(np.unique(w, return_counts=True) for w in self.words)) if rows else ((), ())
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams, *self.vocabulary]))

    def seeded(self, documents: np.ndarray) -> Items:
        """Chooses the seeds, given in how many documents each of the known n-grams and words is."""
        seeds, items, places = [], [], []
        for i, g in enumerate(self.grams):
            n = documents[np.searchsorted(self.known, g)]
            pick = {k + int(np.argmin(n[k : k + WITHIN])) for k in range(max(1, len(g) - WITHIN + 1))} if len(g) else set()
            for k in sorted(pick):
                seeds.append(g[k])
                items.append(i)
                places.append(k)
        order = np.argsort(np.array(seeds, np.uint64), kind="stable")
        self.seeds, self.of, self.place = np.array(seeds, np.uint64)[order], np.array(items, int)[order], np.array(places, int)[order]
        self.needed = np.maximum(1, np.ceil(SEEDS * np.bincount(self.of, minlength=len(self.ids))).astype(int))
        sizes = np.array([len(w) for w in self.words], int)
        self.least = np.maximum(1, np.ceil(2 * sizes * self.leak - 1e-9)).astype(int)  # the score of a leak
        self.matches = (self.least + 1) // 2
        self.asked = np.maximum(1, self.matches // 3)  # so many of the rarest words are in any leak
        self.span = 3 * sizes - self.least  # of the document's words, at most
        rare = [np.unique(w[np.argsort(documents[np.searchsorted(self.known, w)], kind="stable")[: len(w) - self.matches[i] + self.asked[i]]]) for i, w in enumerate(self.words) if len(w)]
        some = np.nonzero(sizes)[0]
        flat = np.concatenate([np.zeros(0, np.uint64), *rare])
        order = np.argsort(flat, kind="stable")
        self.rare, self.rare_from = np.unique(flat[order], return_index=True)
        self.rare_from = np.append(self.rare_from, len(flat))
        self.rare_of = np.repeat(some, [len(r) for r in rare])[order]
        self.rare_ones, self.seed_ones = Known(self.rare), Known(np.unique(self.seeds))
        return self

    def spans(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): the ranges of these words where an item may have the score of a leak, all of them."""
        at, place = self.rare_ones.find(words)
        if not len(at):
            return
        first = self.rare_from[place]
        n = self.rare_from[place + 1] - first
        item = self.rare_of[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(at, n)
        order = np.argsort(item, kind="stable")  # at stays sorted within an item
        at, item = at[order], item[order]
        other = np.arange(len(at)) + self.asked[item] - 1
        end = np.minimum(other, len(at) - 1)
        near = np.nonzero((other == end) & (item[end] == item) & (at[end] - at < self.span[item]))[0]
        begins, item = at[near], item[near]
        reach = self.span[item]
        new = np.ones(len(near), bool)
        new[1:] = (item[1:] != item[:-1]) | (np.diff(begins) > 2 * reach[1:])
        cut = np.append(np.nonzero(new)[0], len(near)).tolist()
        for g, h in zip(cut[:-1], cut[1:], strict=True):
            i, reach_i = int(item[g]), int(reach[g])
            lo, hi = max(0, int(begins[g]) - reach_i), int(begins[h - 1]) + 2 * reach_i
            own = self.vocabulary[i]
            word = np.minimum(own.searchsorted(words[lo:hi]), len(own) - 1)
            same = own[word] == words[lo:hi]
            if not self._enough(i, word[same]):
                continue
            total = np.where(same, 2, -1).cumsum()
            ends = np.nonzero(total - np.minimum.accumulate(np.concatenate([[0], total[:-1]])) >= self.least[i])[0]
            for run in np.split(ends, np.nonzero(np.diff(ends) > reach_i)[0] + 1) if len(ends) else []:
                x, y = max(0, int(run[0]) + 1 - reach_i), int(run[-1]) + 1
                if self._enough(i, word[x:y][same[x:y]]):
                    yield i, lo + x, lo + y

    def _enough(self, i: int, found: np.ndarray) -> bool:
        """Whether these words, places in the item's vocabulary, could match as many of the item's as a leak takes, each word as often as it has it."""
        return np.minimum(np.bincount(found, minlength=len(self.times[i])), self.times[i]).sum() >= self.matches[i]

    def found(self, words: np.ndarray, grams: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) for the items that a document with these words and n-grams may hold."""
        best: dict[int, int] = {}
        for i, lo, hi in [*self.spans(words), *self.hits(grams)]:
            best[i] = max(best.get(i, 0), align(self.words[i], words[lo:hi]))
        return [(i, b / (2 * len(self.words[i]))) for i, b in sorted(best.items()) if b]

    def hits(self, grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): the ranges around n-grams that are seeds, also of what is less than a leak."""
        at, _ = self.seed_ones.find(grams)
        at = at[grams[at] > 0]
        if not len(at):
            return
        first, last = np.searchsorted(self.seeds, grams[at], "left"), np.searchsorted(self.seeds, grams[at], "right")
        n = last - first
        seed = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, item, place = np.repeat(at, n), self.of[seed], self.place[seed]
        order = np.lexsort((at, item))
        at, item, place = at[order], item[order], place[order]
        for hits in np.split(np.arange(len(at)), np.nonzero(np.diff(item))[0] + 1):
            i = int(item[hits[0]])
            size = len(self.words[i])
            reach = size + size // 4 + NGRAM
            # hits that one occurrence of the item could give are aligned together
            for group in np.split(hits, np.nonzero(np.diff(at[hits]) > reach)[0] + 1):
                if len(np.unique(place[group])) >= self.needed[i]:
                    yield i, max(0, int(at[group[0]]) - reach), int(at[group[-1]]) + reach


def _documents(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each known n-gram and word is."""
    shared = docs.sparkSession.sparkContext.broadcast(Known(items.known))  # of one part: bounded by PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n = len(known.hashes)
        total = np.zeros(n, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks([len(t or "") for t in texts], 1 << 20):
                w, g, starts = hashed(texts[a:b])
                for h in (w, g):
                    hit, place = known.find(h)
                    pairs = np.unique(np.searchsorted(starts, hit, "right") * n + place)
                    total += np.bincount(pairs % max(1, n), minlength=n)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(len(items.known), np.int64)
    for r in counted.collect():  # at most a row for each n-gram and word of one part
        out[r.gram] = r.n
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, part: int = PART) -> DataFrame:
    """Adds n_items (items whose score is leak or more), item_id and score of the best one, and leaked."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = bench.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, math.ceil(size / part))
    plain = [f for f in docs.schema if f.name not in {n for n, _ in NEW}]
    schema = T.StructType(plain + [T.StructField(n, t) for n, t in NEW])
    out = docs.select(*(F.col(f"`{f.name}`") for f in plain), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(False).alias("leaked"))
    for k in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about `part` bytes
        items = Items([(r.item_id, r.text) for r in rows], leak)
        items.seeded(_documents(docs, items))
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for a, b in chunks([len(t or "") for t in texts], 1 << 20):
                    piece = batch.slice(a, b - a)
                    words, grams, starts = hashed(texts[a:b])
                    new = {n: piece.column(n).to_pylist() for n, _ in NEW}
                    for d in range(b - a):
                        s, e = starts[d], starts[d + 1]
                        for i, score in items.found(words[s:e], grams[s:e]):
                            new["n_items"][d] += score >= leak
                            old = new["score"][d], new["item_id"][d]
                            if score > old[0] or score == old[0] and items.ids[i] is not None and (old[1] is None or items.ids[i] < old[1]):
                                new["score"][d], new["item_id"][d] = score, items.ids[i]
                            new["leaked"][d] |= score >= leak
                    kinds = {"n_items": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "leaked": pa.bool_()}
                    cols = {f.name: piece.column(f.name) for f in plain} | {n: pa.array(new[n], kinds[n]) for n, _ in NEW}
                    yield pa.RecordBatch.from_pydict(cols)

        out = out.mapInArrow(run, schema)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs.select("doc_id", "text"), benchmark).drop("text")
