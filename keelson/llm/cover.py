"""Removes passages of words that a document with a smaller id has too, found by difference-cover anchors.

The residues COVER modulo PERIOD have every difference between them, so wherever two documents share WINDOW words in a
row, some offset below PERIOD is a cover position in both. Only runs of ANCHOR words at cover positions are hashed and
compared between documents (see blocks). The windows that hold a shared anchor then look for the document that has them first, by 96 bits
of hash; windows that match one after the other are one extended match, and the words of each such match are compared
with those of the document that was first before any of them goes.

Defined results: a null or empty text has no words; rows with the same id count as one document, which doesn't repeat
itself; a null id counts as smaller than all others; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .words import chunks, joined, xxh64

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Windows of a match that are compared at once.
RUN = 64
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def runs(h: np.ndarray, length: int, salt: int = 3) -> np.ndarray:
    """A hash of each run of so many hashes, by doubling."""
    size = 1
    while size * 2 <= length:
        h = mix(h[:-size] * U(salt) + h[size:])
        size *= 2
    if length > size:
        h = mix(h[: len(h) - (length - size)] * U(salt + 2) + h[length - size :])
    return h


class Words:
    """The words of a block's texts: bytes, bounds, a hash of each, and where each text's words begin."""

    def __init__(self, block: blocks.Block):
        parts = []
        for a, b in chunks([len(t) for t in block.texts], 1 << 20):
            flat, starts, ends, of = joined(block.texts[a:b])
            parts.append((flat, ends - starts, of + a, xxh64(flat, starts, ends)))
        flat, lengths, of, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.flat, self.lengths, self.of, self.hash = flat, lengths, of, h
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.n = np.bincount(of, minlength=len(block.texts))
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(of)) - self.first[of]
        self.left = self.n[of] - self.place

    def runs(self, length: int, salt: int = 3) -> np.ndarray:
        """By word, the hash of the run that starts there; of no meaning where the text has fewer words left."""
        out = np.zeros(len(self.hash), np.uint64)
        if len(out) >= length:
            out[: len(out) - length + 1] = runs(self.hash, length, salt)
        return out

    def text(self, first: int, words: int) -> bytes:
        """So many words, joined by one space."""
        last = first + words - 1
        return self.flat[self.starts[first] : self.starts[last] + self.lengths[last]].tobytes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.nonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR))[0]
        return at, self.runs(ANCHOR)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(WINDOW), (self.runs(WINDOW, 7) >> U(32)).astype(np.uint32)


def _name(block: blocks.Block):
    at, keys = Words(block).anchors()
    return np.unique(keys, return_counts=True)


def _first(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each, the place of the first one with the same 96 bits."""
    order = np.lexsort((more, h))  # keeps the order of equal ones
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
    first = np.zeros(len(h), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else order
    return first


def _hang(block: blocks.Block, shared: np.ndarray, hot: np.ndarray, buckets: int):
    """Windows that contain a shared anchor: (hash, more of it, id, document and place of the first in the block)."""
    w = Words(block)
    at, keys = w.anchors()
    at = at[blocks.member(keys >> U(16), shared) >= 0]
    step = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(step, np.maximum(at - (WINDOW - ANCHOR), w.first[w.of[at]]), 1)
    np.add.at(step, at + 1, -1)
    s = np.nonzero((np.cumsum(step[:-1]) > 0) & (w.left >= WINDOW))[0]
    h, more = w.windows()
    s = s[_first(h[s], more[s]) == np.arange(len(s))]  # the rows are in order of the id
    ids = block.ids[w.of[s]]
    return [(bucket, block.number, blocks.pack(h[s[p]], more[s[p]], ids[p], w.of[s[p]].astype(np.int32), w.place[s[p]].astype(np.int32))) for bucket, p in blocks.by_bucket(h[s], buckets)]


def _settle(table: pa.Table) -> pa.Table:
    """To each block, its windows that a block with a smaller id has, and the place of the first of them."""
    parts = [(*blocks.unpack(x), b) for x, b in zip(table.column("data").to_pylist(), table.column("block").to_pylist(), strict=True)]
    h, more, ids, doc, place = (np.concatenate([p[k] for p in parts]) for k in range(5))
    block = np.concatenate([np.full(len(p[0]), p[5], np.int32) for p in parts])
    order = np.lexsort((block, ids, more, h))
    h, more, ids, doc, place, block = (x[order] for x in (h, more, ids, doc, place, block))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = np.nonzero(ids > ids[first])[0]
    later = later[np.lexsort((place[later], doc[later], block[later]))]
    first = first[later]
    rows = []
    for cut in np.split(np.arange(len(later)), np.nonzero(np.diff(block[later]))[0] + 1):
        if len(cut):
            x, y = later[cut], first[cut]
            rows.append((int(block[x[0]]), blocks.pack(doc[x], place[x], block[y], doc[y], place[y])))
    return blocks.told(rows)


def _told(heard: list[tuple]) -> list[np.ndarray]:
    """All that a block has been told, in order of its documents and places."""
    parts = [np.concatenate([np.zeros(0, np.int32), *(x[k] for x in heard)]) for k in range(5)]
    order = np.lexsort((parts[1], parts[0]))
    return [x[order] for x in parts]


def _claim(block: blocks.Block, heard: list[tuple]) -> list[tuple]:
    w = Words(block)
    doc, place, owner, their_doc, their_place = _told(heard)
    return list({
        (int(owner[i]), int(their_doc[i]), int(their_place[i]), j - i + WINDOW - 1, w.text(int(w.first[doc[i]] + place[i]), j - i + WINDOW - 1))
        for i, j in blocks.diagonals(doc, place, owner, their_doc, their_place, RUN)
    })


def _confirm(block: blocks.Block, doc: int, place: int, words: int, held: bytes) -> bool:
    if not hasattr(block, "words"):
        block.words = Words(block)
    w = block.words
    return place + words <= w.n[doc] and w.text(int(w.first[doc] + place), words) == held


def removed(block: blocks.Block, heard: list[tuple]) -> tuple[Words, np.ndarray]:
    """Which words of the block's texts go."""
    w = Words(block)
    h, more = w.windows()
    whole = np.nonzero(w.left >= WINDOW)[0]
    first = whole[_first(h[whole], more[whole])]
    doc, place, *_ = _told(heard)
    known = np.zeros(len(w.hash), bool)
    known[w.first[doc] + place] = True
    mark = np.zeros(len(w.hash), bool)
    mark[first[known[whole]]] = True
    gone = mark[first]  # what one of equal ones has been told goes for all of them
    inside = np.nonzero(block.ids[w.of[whole]] > block.ids[w.of[first]])[0]
    zero = np.zeros(len(inside), np.int32)
    for i, j in blocks.diagonals(w.of[whole[inside]], w.place[whole[inside]], zero, w.of[first[inside]], w.place[first[inside]], RUN):
        x, y, n = int(whole[inside[i]]), int(first[inside[i]]), j - i + WINDOW - 1
        if w.text(x, n) != w.text(y, n):
            raise ValueError(f"two different texts have one hash: {w.text(x, n)!r} and {w.text(y, n)!r}")
    gone[inside] = True
    step = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(step, whole[gone], 1)
    np.add.at(step, whole[gone] + WINDOW, -1)
    return w, np.cumsum(step[:-1]) > 0


def kept_words(w: Words, gone: np.ndarray, texts: int) -> list[bytes]:
    keep = np.repeat(~gone, w.lengths + 1)
    flat = w.flat[keep].tobytes()
    size = np.bincount(w.of, weights=np.where(gone, 0, w.lengths + 1), minlength=texts).astype(int) if len(w.of) else np.zeros(texts, int)
    ends = np.cumsum(size)
    return [flat[e - n : max(e - 1, e - n)] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def dedup(docs: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space, of each row."""

    def apply(b: blocks.Block, heard: list[tuple]) -> pa.Table:
        w, gone = removed(b, heard)
        n = np.bincount(w.of[gone], minlength=len(b.texts)) if gone.any() else np.zeros(len(b.texts), int)
        return pa.table({"doc_id": b.id_array(), "n_words": pa.array(w.n, pa.int64()), "n_removed": pa.array(n, pa.int64()), "kept": pa.array(kept_words(w, gone, len(b.texts)), pa.binary())})

    return blocks.run(docs, _name, _hang, _settle, _claim, _confirm, apply, "doc_id long, n_words long, n_removed long, kept binary", block=block)


def digest(docs: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """dedup() with the SHA-256 of what stays in place of it."""

    def apply(b: blocks.Block, heard: list[tuple]) -> pa.Table:
        w, gone = removed(b, heard)
        n = np.bincount(w.of[gone], minlength=len(b.texts)) if gone.any() else np.zeros(len(b.texts), int)
        sha = [hashlib.sha256(x).hexdigest() for x in kept_words(w, gone, len(b.texts))]
        return pa.table({"doc_id": b.id_array(), "n_words": pa.array(w.n, pa.int64()), "n_removed": pa.array(n, pa.int64()), "kept_sha256": sha})

    return blocks.run(docs, _name, _hang, _settle, _claim, _confirm, apply, "doc_id long, n_words long, n_removed long, kept_sha256 string", block=block)


SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {blocks.NO_ID}) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT r, o, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS key FROM (SELECT r, o, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW})
), g AS (
  SELECT DISTINCT r, i + j AS p FROM (SELECT r, o, i, min(o) OVER (PARTITION BY key) AS first FROM w), range({WINDOW}) t(j) WHERE first < o
), u AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d
), k AS (
  SELECT u.r, count(g.p) AS n, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN g ON u.r = g.r AND u.p = g.p GROUP BY u.r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""
