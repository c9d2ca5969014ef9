"""Exact search for repeats between blocks of documents, without sending every position anywhere.

Documents are dealt into blocks of bounded size by a hash of id and text, in one exchange that all steps read. Then

1. each block names its anchors' keys, once each, to the bucket that owns the key;
2. a bucket tells each block which of them other blocks have named too;
3. each block, knowing its shared anchors, names what hangs on them to buckets;
4. a bucket finds who is first and tells the blocks what is repeated, and of whom if only hashes say so;
5. each block claims of the blocks that were first what hashes alone have matched: runs of it, with what they hold. Equal claims
   are merged, and the block that was first compares each with its own text;
6. each block applies what it was told to its texts.

Keys are merged in the block before they are sent, so a passage that a third of the documents share is sent once a
block, and claimed once in all. Blobs are small arrays, packed; a blob is at most one block's part of one bucket, and never
holds less than one key, so that however many blocks there are, there are no more blobs than keys.

A claim that doesn't hold would be two texts of one 96-bit hash. It stops the job, as what the rest has been told is then in doubt;
another salt of the hashes gets past it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text in a block, about, and blocks for each bucket.
BLOCK, PER_BUCKET = 4 << 20, 4
#: Texts of fewer bytes hold nothing that is looked for; blobs of fewer bytes aren't compressed.
LEAST, SMALL = 25, 256
SENT = "bucket int, block int, data binary"
TOLD = "block int, data binary"
CLAIM = "owner int, doc int, start int, n int, held binary"
#: The id that stands for null, before all others.
NO_ID = -(1 << 63)


def pack(*arrays) -> bytes:
    """Arrays of numbers, each behind its type and shape."""
    parts = [bytes([len(arrays)])]
    for a in map(np.ascontiguousarray, arrays):
        parts += [struct.pack("<3sII", a.dtype.str.encode(), len(a), a.shape[1] if a.ndim == 2 else 0), a.tobytes()]
    raw = b"".join(parts)
    return b"\0" + raw if len(raw) < SMALL else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = blob[1:] if blob[0] == 0 else zstandard.ZstdDecompressor().decompress(blob[1:])
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n, width = struct.unpack_from("<3sII", raw, at)
        at += 11
        dtype, size = np.dtype(kind.decode()), n * (width or 1)
        a = np.frombuffer(raw, dtype, size, at)
        out.append(a.reshape(n, width) if width else a)
        at += size * dtype.itemsize
    return tuple(out)


class Block:
    """Rows of a block in a fixed order, by id and then text."""

    def __init__(self, table: pa.Table):
        ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        texts = [(x or "").encode() for x in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.number = table.column("__block")[0].as_py()
        self.order, self.table = order, table

    def column(self, name: str) -> pa.ChunkedArray:
        """A column that was kept, in the block's order."""
        return self.table.column(name).take(pa.array(self.order, pa.int64()))

    def id_array(self) -> pa.Array:
        return pa.array([None if x == NO_ID else x for x in self.ids.tolist()], pa.int64())


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that has any, the places of its keys."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.nonzero(np.diff(bucket[order]))[0] + 1) if len(order) else []:
        yield int(bucket[part[0]]), part


def sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(a, pa.int32()), "block": pa.array(b, pa.int32()), "data": pa.array(c, pa.binary())})


def told(rows: list[tuple[int, bytes]]) -> pa.Table:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.table({"block": pa.array(a, pa.int32()), "data": pa.array(b, pa.binary())})


def name_keys(number: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Step 1 for distinct keys of a block: their upper 48 bits, and how often the block has each, to 255."""
    rows = []
    for bucket, at in by_bucket(keys, buckets):
        at = at[np.argsort(keys[at])]
        rows.append((bucket, number, pack((keys[at] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].copy(), np.minimum(counts[at], 255).astype(np.uint8))))
    return sent(rows)


def shared_keys(table: pa.Table, often: int) -> pa.Table:
    """Step 2: for each block, the keys that another block has too, and which of them are had more than often in all."""
    blocks, parts, counts = [], [], []
    for number, blob in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        six, n = unpack(blob)
        keys = np.zeros((len(six), 8), np.uint8)
        keys[:, :6] = six
        parts.append(keys.view(np.uint64).ravel())
        counts.append(n.astype(np.int64))
        blocks.append(np.full(len(six), number, np.int32))
    keys, n, block = map(np.concatenate, (parts, counts, blocks))
    order = np.argsort(keys, kind="stable")
    keys, n, block = keys[order], n[order], block[order]
    first = np.nonzero(np.diff(keys, prepend=~keys[:1]))[0]
    size = np.diff(first, append=len(keys))
    all_n = np.repeat(np.add.reduceat(n, first), size)
    keep = np.repeat(size, size) > 1
    keys, hot, block = keys[keep], (all_n > often)[keep], block[keep]
    order = np.argsort(block, kind="stable")
    keys, hot, block = keys[order], hot[order], block[order]
    rows = []
    for part in np.split(np.arange(len(block)), np.nonzero(np.diff(block))[0] + 1):
        if len(part):
            rows.append((int(block[part[0]]), pack(keys[part], hot[part])))
    return told(rows)


def run(docs: DataFrame, name: Callable, hang: Callable, settle: Callable, claim: Callable, confirm: Callable, apply: Callable, out: str | T.StructType, often: int = 1 << 40, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """The steps. name(Block) -> keys, counts; hang(Block, shared keys, which are hot, buckets) -> rows for sent(); settle(table) -> a
    told() table; claim(Block, blobs) -> (owner, doc, start, n, bytes) of runs; confirm(Block, doc, start, n, bytes) -> whether
    the block's text holds these; apply(Block, blobs) -> a table of out. keep: other columns that apply needs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`") for c in keep))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(8, math.ceil(total / block))
    buckets = max(16, blocks // PER_BUCKET)
    # rows without anything to find may be equal in great number; any block will do for them
    tiny = F.coalesce(F.octet_length("text"), F.lit(0)) < LEAST
    dealt = rows.withColumn("__block", F.pmod(F.when(tiny, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "text")), F.lit(blocks)).cast("int"))

    def first(table: pa.Table) -> pa.Table:
        b = Block(table)
        return name_keys(b.number, *name(b), buckets)

    def second(table: pa.Table) -> pa.Table:
        return shared_keys(table, often)

    def third(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        both = [unpack(x) for x in heard.column("data").to_pylist()]
        keys = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in both)])
        hot = np.concatenate([np.zeros(0, bool), *(x[1] for x in both)])
        order = np.argsort(keys)
        return sent(hang(Block(table), keys[order], hot[order], buckets))

    def fifth(table: pa.Table, heard: pa.Table) -> pa.Table:
        made = claim(Block(table), [unpack(x) for x in heard.column("data").to_pylist()]) if table.num_rows and heard.num_rows else []
        *places, held = zip(*made, strict=True) if made else [()] * 5
        return pa.table({**{c: pa.array(x, pa.int32()) for c, x in zip(("owner", "doc", "start", "n"), places, strict=True)}, "held": pa.array(held, pa.binary())})

    def confirmed(table: pa.Table, claims: pa.Table) -> pa.Table:
        if claims.num_rows:
            own = Block(table)
            for c in claims.to_pylist():
                if not confirm(own, c["doc"], c["start"], c["n"], c["held"]):
                    raise ValueError(f"two different texts have one hash: {c['held'][:200]!r} and the one at {c['start']} of {own.ids[c['doc']]}")
        return empty

    def sixth(table: pa.Table, heard: pa.Table) -> pa.Table:
        return apply(Block(table), [unpack(x) for x in heard.column("data").to_pylist()])

    empty = pa.Table.from_batches([], to_arrow_schema(out if isinstance(out, T.StructType) else T._parse_datatype_string(out)))
    shared = dealt.groupBy("__block").applyInArrow(first, SENT).groupBy("bucket").applyInArrow(second, TOLD)
    hung = dealt.groupBy("__block").cogroup(shared.groupBy("block")).applyInArrow(third, SENT)
    settled = hung.groupBy("bucket").applyInArrow(settle, TOLD)
    claims = dealt.groupBy("__block").cogroup(settled.groupBy("block")).applyInArrow(fifth, CLAIM).distinct()
    applied = dealt.groupBy("__block").cogroup(settled.groupBy("block")).applyInArrow(sixth, out)
    return applied.unionByName(dealt.groupBy("__block").cogroup(claims.groupBy("owner")).applyInArrow(confirmed, out))


def diagonals(doc: np.ndarray, at: np.ndarray, owner: np.ndarray, their_doc: np.ndarray, their_at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of matches, given in order of (doc, at), that go on place by place on both sides, of at most so many."""
    if not len(doc):
        return
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (their_doc[1:] != their_doc[:-1]) | (their_at[1:] != their_at[:-1] + 1)
    cut = np.append(np.nonzero(new)[0], len(doc)).tolist()
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        for k in range(i, j, most):
            yield k, min(j, k + most)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted ones, or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)
