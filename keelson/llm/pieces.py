"""Counts of word pieces by a longest-match automaton that never builds the pieces.

The automaton is the trie of the vocabulary with failure links. Each node knows how many pieces are popped when
the word leaves the trie there, and from which node the rest goes on. A word costs time linear in its length.

Words are runs of anything but ASCII white space, taken as UTF-8 bytes. Defined results: a null or empty text has no
words; a word that the vocabulary can't build counts as one unknown piece; repeated rows each give a row; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a process remembers at most, and bytes of the longest that it does.
REMEMBERED, LONGEST = 400_000, 100


class Automaton:
    """From the pieces that may start a word, and those that may go on with it."""

    def __init__(self, starts: Iterable[bytes], rest: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0 is where words start, 1 where they go on
        ends = [False, False]
        for root, pieces in ((0, starts), (1, rest)):
            for piece in pieces:
                at = root
                for b in piece:
                    if b not in self.next[at]:
                        self.next[at][b] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][b]
                ends[at] |= bool(piece)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = [0, 1]
        for at in queue:  # by depth
            for b, to in self.next[at].items():
                if ends[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    up, n = self.fail[at], self.popped[at]
                    while up >= 0 and b not in self.next[up]:
                        n, up = n + self.popped[up], self.fail[up]
                    self.fail[to], self.popped[to] = (self.next[up][b], n) if up >= 0 else (-1, 0)
                queue.append(to)

    def count(self, word: bytes) -> int:
        """The pieces of the greedy longest-match split, or 0 if there is none."""
        nxt, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for b in word:
            while b not in nxt[at]:
                if fail[at] < 0:
                    return 0
                n += popped[at]
                at = fail[at]
            at = nxt[at][b]
        while at != 1:
            if fail[at] < 0:
                return 0
            n += popped[at]
            at = fail[at]
        return n


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """From a file of ranks: the tokens with a leading space start words, those without go on with them; single bytes do both."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    white = b" \t\n\x0b\x0c\r"
    plain = [t for t in tokens if not any(c in white for c in t)]
    starts = [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and not any(c in white for c in t[1:])]
    return starts + [t for t in plain if len(t) == 1], plain


@lru_cache(1)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(*vocabulary(path)), {}


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, seen = automaton(path)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                words = (t or "").encode().split()  # splits at the ASCII white space alone
                if len(seen) > REMEMBERED:
                    seen.clear()
                for w in set(words).difference(seen):
                    if len(w) <= LONGEST:
                        seen[w] = machine.count(w)
                n = [seen[w] if w in seen else machine.count(w) for w in words]
                unknown = n.count(0)
                rows.append((len(words), sum(n) + unknown, unknown))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (a, b, c))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
