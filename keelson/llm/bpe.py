"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every match of the pattern is encoded by itself; equal matches of a batch are encoded once, and a
per-process memory of short matches already seen, bounded in number and length, saves most of the work.

Defined results: a null text is an empty one (no ids, empty bytes); repeated rows each give a row; an empty
table gives an empty one; a column of the input with the name of a new one is replaced.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are worked on at a time, the most matches that a process remembers, and the characters of the longest of them.
ROWS, REMEMBERED, LONGEST = 64, 250_000, 64


def byte_to_char() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Decoder:
    """The bytes of each id, by way of the vocabulary's characters and the reversed byte table."""

    def __init__(self, path: str):
        chars = byte_to_char()
        back = {c: b for b, c in enumerate(chars)}
        vocabulary = {r: "".join(map(chars.__getitem__, t)) for t, r in read_ranks(path).items()}
        self.token_bytes = {r: bytes(map(back.__getitem__, t)) for r, t in vocabulary.items()}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each id completes: a character split over ids goes to the last of them, and what is no UTF-8 becomes U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.token_bytes[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each id, the first byte that it covers and the character of the text that has this byte."""
        ends = np.cumsum(np.fromiter((len(self.token_bytes[i]) for i in ids), np.int64, len(ids)))
        starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        raw = np.frombuffer(text.encode(), np.uint8)
        return starts, (np.cumsum((raw & 0xC0) != 0x80) - 1)[starts]


class Encoder:
    """Encoder for a file of ranks. What it remembers of a match are the ids' bytes as 32-bit numbers, a fifth of what a list takes."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_to_char()
        text = lambda token: "".join(map(chars.__getitem__, token))
        by_rank = sorted(ranks, key=ranks.__getitem__)
        # any two neighbours whose joined bytes have a rank may merge, so every split of a token is a merge
        merges = [(text(t[:i]), text(t[i:])) for t in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.find(x) for x in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list(set(chain.from_iterable(found)).difference(self.seen))
        long: dict[str, bytes] = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = (np.array(e.ids, np.int32).tobytes() for e in self.model.encode_batch_fast(part, add_special_tokens=False))
            for match, packed in zip(part, ids, strict=True):
                (self.seen if len(match) <= LONGEST else long)[match] = packed
        ids_of = self.seen.__getitem__ if not long else lambda m: long[m] if len(m) > LONGEST else self.seen[m]
        return [np.frombuffer(b"".join(map(ids_of, x)), np.int32) for x in found]


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_pydict(kept | new)


def _schema(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema if f.name not in names] + [T.StructField(n, t) for n, t in new])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: bool = False, decoded: str | None = None) -> DataFrame:
    """Adds the ids of each text, and with offsets also byte_starts and char_starts of each id. decoded names a column for what the ids
    decode to, as decode() has it, in the same pass and so in the same Python processes."""
    new = [(ids, T.ArrayType(T.IntegerType()))] + [(decoded, T.BinaryType())] * bool(decoded) + [(n, T.ArrayType(T.LongType())) for n in ("byte_starts", "char_starts") if offsets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = encoder(path, pattern), decoder(path) if offsets or decoded else None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [x or "" for x in batch.column(text).to_pylist()]
                got = bpe.encode(texts)
                cols = {ids: id_lists(got)}
                if decoded:
                    cols[decoded] = pa.array([table.decode(i.tolist()) for i in got], pa.binary())
                if offsets:
                    both = [table.offsets(x, i.tolist()) for x, i in zip(texts, got, strict=True)]
                    cols |= {n: pa.array([b[k] for b in both], pa.list_(pa.int64())) for k, n in enumerate(("byte_starts", "char_starts"))}
                yield _with(batch, cols)

    return docs.mapInArrow(run, _schema(docs, new))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; they need not be UTF-8. Null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = decoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield _with(batch, {out: pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())})

    return df.mapInArrow(run, _schema(df, [(out, T.BinaryType())]))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids."""
    both = encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
