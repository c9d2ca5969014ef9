"""Removes every byte of a string of LENGTH bytes that also starts earlier in the corpus, by a sparse suffix array.

The suffixes sorted are those that start at anchors: positions whose K-byte prefix has the least hash among SPAN
consecutive ones. Any LENGTH bytes hold an anchor, chosen by these bytes alone, so equal strings share one at the same
offset. Anchors whose prefix occurs only once in the corpus are left out (see blocks). The others go, with LENGTH bytes
from the anchor and SPAN - 1 before it, to buckets that sampled splitters range-partition by the suffixes' leading
bytes. A bucket sorts its suffixes by multikey quicksort, eight bytes a key, and measures how many bytes neighbours in that
order share; those with an equal prefix are also sorted by the bytes before them, backwards, and measured likewise. A string
that starts so many bytes before its anchor is equal to another exactly if neither order has a pair of neighbours between
them that share fewer bytes than it has on that side. So neighbours decide, by bytes, for every offset around the anchor.

Boundaries between buckets never separate suffixes that share K bytes, as ranges are of whole leading parts of less than that;
there is then nothing that neighbours across a boundary could share. A prefix that occurs very often would make one bucket
large: the strings around it are sent one by one instead, by 96 bits of hash that spread them over all buckets, and what matches so is
claimed of the block that has it first, which compares the bytes (see blocks). So bytes decide however often a string occurs.

Runs of one byte or of a short period have anchors everywhere. Only the first few of a run are kept: an anchor whose
surroundings equal those of the one before it, less than SPAN bytes back, has nothing but repeats around it.

Order is by (id, start). Defined results: a null text is empty; a null id is before all others; rows with the same
id count as one document (of strings that start at the same place one stays); an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .cover import _first, mix, runs
from .words import chunks

LENGTH, K = 100, 50
SPAN = LENGTH - K + 1
BEFORE = SPAN - 1
#: Occurrences of an anchor from which its strings are sent one by one; texts and bytes of each that splitters are sampled from; leading
#: bytes that splitters are of.
OFTEN, SAMPLE, SAMPLE_BYTES, LEAD = 20_000, 400, 4000, 16
#: Bytes of text, anchors and suffixes worked on at a time; strings that are compared at once if hashes have matched them.
WINDOW, MANY, GROUP, RUN = 1 << 20, 8192, 50_000, 400
#: Kinds of blobs.
KNOWN, STRINGS, SUFFIXES = range(3)
U = np.uint64


def _windows(texts: list[bytes]):
    """Anchors of all texts, window by window: the text, the position and the prefix's hash of each."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    for begin in range(0, len(raw), WINDOW):
        end = min(len(raw), begin + WINDOW)
        low, high = max(0, begin - SPAN), min(len(raw), end + LENGTH)
        if high - low < LENGTH:
            continue
        h = runs(mix(raw[low:high] * U(0x9E3779B97F4A7C15) + U(1)), K)
        least = _extreme(h, SPAN, np.minimum)
        # strings that would run over the end of their text choose nothing
        over = np.zeros(high - low + 1, np.int32)
        near = (ends > low) & (ends - sizes < high)
        np.add.at(over, np.clip(np.maximum(ends - LENGTH + 1, ends - sizes)[near] - low, 0, high - low), 1)
        np.add.at(over, np.clip(ends[near] - low, 0, high - low), -1)
        least[np.cumsum(over)[: len(least)] > 0] = 0
        edge = np.zeros(SPAN - 1, np.uint64)
        chosen = _extreme(np.concatenate([edge, least, edge]), SPAN, np.maximum)
        at = np.nonzero((chosen == h) & (h > 0))[0]
        at = at[(at + low >= begin) & (at + low < end)]
        doc = np.searchsorted(ends, at + low, side="right")
        yield doc, at + low - (ends - sizes)[doc], h[at]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the text, the position and the prefix's hash of each anchor."""
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)), *_windows(texts)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the anchors, those that aren't in the midst of a run; and (text, from, to) of what is around the others, all of it repeats."""
    starts = np.cumsum([0] + [len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    kept, spans, last = [], [], None
    for doc, at, key in _windows(texts):
        if last is not None:
            doc, at, key = (np.concatenate([a, b]) for a, b in zip(last, (doc, at, key), strict=True))
        near = np.nonzero((doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (np.diff(at) < SPAN) & (at[:-1] >= BEFORE) & (starts[doc[1:]] + at[1:] + LENGTH <= starts[doc[1:] + 1]))[0] + 1
        inner = np.zeros(len(doc), bool)
        place = np.arange(-BEFORE, LENGTH)
        for i in range(0, len(near), MANY):
            x = near[i : i + MANY]
            here = starts[doc[x]] + at[x]
            same = (raw[here[:, None] + place] == raw[(here - (at[x] - at[x - 1]))[:, None] + place]).all(1)
            inner[x[same]] = True
        skip = int(last is not None)  # the one that was carried over has had its turn
        x = np.nonzero(inner)[0]
        if len(x):
            new = np.ones(len(x), bool)
            new[1:] = (doc[x[1:]] != doc[x[:-1]]) | (at[x[1:]] - BEFORE > at[x[:-1]] + LENGTH)
            first = np.nonzero(new)[0]
            end = np.append(first[1:], len(x)) - 1
            spans.append((doc[x[first]], at[x[first]] - BEFORE, at[x[end]] + LENGTH))
        outer = ~inner
        outer[:skip] = False
        kept.append((doc[outer], at[outer], key[outer]))
        last = (doc[-1:], at[-1:], key[-1:]) if len(doc) else last
    join = lambda parts, kinds: tuple(np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))
    return (*join(kept, (int, int, np.uint64)), join(spans, (int, int, int)))


def _extreme(x: np.ndarray, span: int, of) -> np.ndarray:
    size = 1
    while size * 2 <= span:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def around(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes around each anchor, zero outside the text, and how many there are before it and from it on."""
    starts = np.cumsum([0] + [len(t) for t in texts])
    raw = np.frombuffer(b"\0" * BEFORE + b"".join(texts) + b"\0" * LENGTH, np.uint8)
    context = raw[(starts[doc] + at)[:, None] + np.arange(BEFORE + LENGTH)]
    size = np.diff(starts)[doc]
    before, after = np.minimum(at, BEFORE), np.minimum(size - at, LENGTH)
    place = np.arange(BEFORE + LENGTH)
    return np.where((place >= BEFORE - before[:, None]) & (place < BEFORE + after[:, None]), context, 0).astype(np.uint8), before, after


def digits(context: np.ndarray) -> np.ndarray:
    """The suffixes from the anchor on as big-endian numbers of eight bytes; the prefix fills the first seven."""
    n = len(context)
    padded = np.zeros((n, 8 * 14), np.uint8)
    padded[:, :K] = context[:, BEFORE : BEFORE + K]
    padded[:, 56 : 56 + LENGTH - K] = context[:, BEFORE + K :]
    return padded.view(">u8").astype(np.uint64)


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of digits, and by sorted place the group of equal first seven digits. Each round sorts, by the next
    digit, only the runs that the digits before have left equal."""
    n = len(keys)
    order, group = np.arange(n), np.zeros(n, np.int64)
    prefix = group
    for d in range(keys.shape[1]):
        size = np.bincount(group, minlength=n) if n else group
        open_ = np.nonzero(size[group] > 1)[0]
        if len(open_):
            rows = order[open_]
            order[open_] = rows[np.lexsort((keys[rows, d], group[open_]))]
            new = np.zeros(n, bool)
            new[1:] = (np.diff(group) != 0) | (keys[order[1:], d] != keys[order[:-1], d])
            group = np.cumsum(new)
        if d == 6:
            prefix = group.copy()
    return order, prefix


def _hashes(context: np.ndarray, salt: int = 3) -> np.ndarray:
    """By offset a from 0 to BEFORE, a hash of the LENGTH bytes that start a before the anchor."""
    n, width = context.shape
    flat = runs(mix(context.ravel() * U(0x9E3779B97F4A7C15) + U(1)), LENGTH, salt)
    full = np.zeros(n * width, np.uint64)
    full[: len(flat)] = flat
    return full.reshape(n, width)[:, BEFORE::-1]


def neighbours(rows: np.ndarray) -> np.ndarray:
    """Of rows of bytes, how many leading ones each shares with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), MANY):
        j = min(len(rows), i + MANY)
        differ = rows[i:j] != rows[i - 1 : j - 1]
        first = differ.argmax(1)
        out[i:j] = np.where(differ[np.arange(j - i), first], first, rows.shape[1])
    return out


def repeats(context: np.ndarray, before: np.ndarray, after: np.ndarray, group: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in their order, with group naming those of equal prefixes and age ranking all by (id, start): the least and the
    greatest offset of a string that an older one has too; else 1, 0."""
    n = len(context)
    low, high = np.ones(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return low, high
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    right = np.where(new, -1, neighbours(context[:, BEFORE:]))
    # the same by what is before the anchor, from there backwards
    padded = np.zeros((n, 56), np.uint8)
    padded[:, :BEFORE] = context[:, BEFORE - 1 :: -1] if BEFORE else 0
    order, _ = multikey_sort(np.concatenate([group[:, None].astype(np.uint64), padded.view(">u8").astype(np.uint64)], axis=1))
    new[1:] = group[order[1:]] != group[order[:-1]]
    left = np.where(new, -1, neighbours(padded[order, :BEFORE]))
    name = np.zeros(n, np.int64)
    by_age = np.argsort(age)
    seen = np.zeros(n, bool)
    for a in range(SPAN):
        name[order] = np.cumsum(left < a)
        both = np.cumsum(right < LENGTH - a) * (n + 1) + name
        rows = by_age[((before >= a) & (after >= LENGTH - a))[by_age]]
        _, once, back = np.unique(both[rows], return_index=True, return_inverse=True)
        mine = rows[once[back] != np.arange(len(rows))]
        low[mine] = np.where(seen[mine], np.minimum(low[mine], a), a)
        high[mine] = np.where(seen[mine], np.maximum(high[mine], a), a)
        seen[mine] = True
    return low, high


def _name(block: blocks.Block):
    return np.unique(sparse(block.texts)[2], return_counts=True)


def _lead(context: np.ndarray) -> np.ndarray:
    """The suffixes' leading bytes, as texts that compare."""
    return np.ascontiguousarray(context[:, BEFORE : BEFORE + LEAD]).view(f"S{LEAD}").ravel()


def _strings(block: blocks.Block, doc: np.ndarray, at: np.ndarray, context: np.ndarray, before: np.ndarray, after: np.ndarray, buckets: int) -> tuple[list, list]:
    """Rows of strings around the anchors, one by one by their hashes, and (text, from, to) of those that are repeats in the block."""
    rows, known = [], []
    starts = np.cumsum([0] + [len(t) for t in block.texts])
    raw = np.frombuffer(b"".join(block.texts), np.uint8)
    a = np.arange(SPAN)
    for i in range(0, len(doc), MANY // 2):
        x = slice(i, i + MANY // 2)
        r, c = np.nonzero((a <= before[x][:, None]) & (LENGTH - a <= after[x][:, None]))
        h, more = _hashes(context[x])[r, c], (_hashes(context[x], 7)[r, c] >> U(32)).astype(np.uint32)
        of, start = doc[x][r], at[x][r] - c
        by = np.lexsort((of, start, block.ids[of]))
        h, more, of, start = h[by], more[by], of[by], start[by]
        # two anchors of one string name it twice; that is no repeat
        once = np.ones(len(by), bool)
        once[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1])
        h, more, of, start = h[once], more[once], of[once], start[once]
        first = _first(h, more)
        later = np.nonzero(first != np.arange(len(first)))[0]
        place = np.arange(LENGTH)
        for k in range(0, len(later), MANY):
            y = later[k : k + MANY]
            if not (raw[(starts[of[y]] + start[y])[:, None] + place] == raw[(starts[of[first[y]]] + start[first[y]])[:, None] + place]).all():
                raise ValueError("two different strings have one hash")
        known.append((of[later], start[later], start[later] + LENGTH))
        k = np.nonzero(first == np.arange(len(first)))[0]
        for bucket, p in blocks.by_bucket(h[k], buckets):
            y = k[p]
            rows.append((bucket, block.number, blocks.pack(np.array([STRINGS], np.uint8), h[y], more[y], block.ids[of[y]], of[y].astype(np.int32), start[y].astype(np.int32))))
    return rows, known


def _hang(splitters: np.ndarray):
    def hang(block: blocks.Block, shared: np.ndarray, hot: np.ndarray, buckets: int):
        doc, at, keys, run = sparse(block.texts)
        known = [run]
        own, count = np.unique(keys, return_counts=True)
        place = blocks.member(keys >> U(16), shared)
        keep = (place >= 0) | (count[blocks.member(keys, own)] > 1)
        doc, at, place, keys = doc[keep], at[keep], place[keep], keys[keep]
        often = np.zeros(len(doc), bool)
        often[place >= 0] = hot[place[place >= 0]]
        # in order of (id, start), so that the first of equal ones is the earliest
        order = np.lexsort((doc, at, block.ids[doc]))
        doc, at, often, keys = doc[order], at[order], often[order], keys[order]
        context, before, after = around(block.texts, doc, at)
        sized = np.concatenate([context, before[:, None].astype(np.uint8), after[:, None].astype(np.uint8)], axis=1)
        _, once, back = np.unique(np.ascontiguousarray(sized).view(f"V{sized.shape[1]}").ravel(), return_index=True, return_inverse=True)
        later = (once[back] != np.arange(len(doc))) & (before + after >= LENGTH)
        known.append((doc[later], (at - before)[later], (at + after)[later]))
        x, y = np.sort(once[often[once]]), np.sort(once[~often[once]])
        rows, more = _strings(block, doc[x], at[x], context[x], before[x], after[x], buckets)
        known += more
        # where there are more buckets than ranges, a range is split by the prefix, which keeps equal prefixes together
        part_of = max(1, buckets // (len(splitters) + 1))
        bucket = np.searchsorted(splitters, _lead(context[y]), side="right") * part_of + (keys[y] >> U(8)).astype(np.int64) % part_of if len(y) else y
        by = np.argsort(bucket, kind="stable")
        for part in np.split(by, np.nonzero(np.diff(bucket[by]))[0] + 1) if len(by) else []:
            p = y[part]
            rows.append((int(bucket[part[0]]), block.number, blocks.pack(np.array([SUFFIXES], np.uint8), context[p], before[p].astype(np.uint8), after[p].astype(np.uint8), block.ids[doc[p]], doc[p].astype(np.int32), at[p].astype(np.int32))))
        d, s, e = (np.concatenate(z) for z in zip(*known, strict=True))
        if len(d):
            rows.append((block.number % buckets, block.number, blocks.pack(np.array([KNOWN], np.uint8), d.astype(np.int32), s.astype(np.int32), e.astype(np.int32))))
        return rows

    return hang


def _settle(table: pa.Table) -> pa.Table:
    """To each block, (text, from, to) of repeats, and of those that only hashes have found also the block, text and start of the first."""
    found: dict[int, list] = {}
    suffixes, strings = [], []
    nobody = lambda n: [np.full(n, -1, np.int32)] * 3
    for number, blob in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        kind, *arrays = blocks.unpack(blob)
        if kind[0] == KNOWN:
            found.setdefault(number, []).append([*arrays, *nobody(len(arrays[0]))])
        else:
            (suffixes if kind[0] == SUFFIXES else strings).append((*arrays, np.full(len(arrays[0]), number, np.int32)))

    def tell(block, *arrays):
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(block[order]))[0] + 1):
            if len(part):
                found.setdefault(int(block[part[0]]), []).append([x[part].astype(np.int32) for x in arrays])

    if strings:
        h, more, ids, doc, start, block = (np.concatenate(x) for x in zip(*strings, strict=True))
        o = np.lexsort((doc, block, start, ids, more, h))
        again = np.zeros(len(o), bool)  # one string may be named by two anchors
        again[1:] = (doc[o[1:]] == doc[o[:-1]]) & (block[o[1:]] == block[o[:-1]]) & (start[o[1:]] == start[o[:-1]]) & (h[o[1:]] == h[o[:-1]])
        o = o[~again]
        new = np.ones(len(o), bool)
        new[1:] = (h[o[1:]] != h[o[:-1]]) | (more[o[1:]] != more[o[:-1]])
        first = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))][~new]
        late = o[~new]
        tell(block[late], doc[late], start[late], start[late] + LENGTH, block[first], doc[first], start[first])
    if suffixes:
        context, before, after, ids, doc, at, block = (np.concatenate(x) for x in zip(*suffixes, strict=True))
        del suffixes
        order, prefix = multikey_sort(digits(context))
        size = np.bincount(prefix)
        keep = size[prefix] > 1
        order, prefix = order[keep], prefix[keep]
        # groups of equal prefixes, a bounded number of rows at a time
        sizes = np.diff(np.append(np.nonzero(np.diff(prefix, prepend=-1))[0], len(prefix)))
        ends = np.cumsum(sizes)
        for a, b in chunks(sizes.tolist(), GROUP):
            part = slice(ends[a - 1] if a else 0, ends[b - 1])
            rows, group = order[part], prefix[part]
            age = np.empty(len(rows), np.int64)
            age[np.lexsort((doc[rows], block[rows], at[rows], ids[rows]))] = np.arange(len(rows))
            low, high = repeats(context[rows], before[rows].astype(int), after[rows].astype(int), group, age)
            x = high >= low
            r = rows[x]
            tell(block[r], doc[r], at[r] - high[x], at[r] + LENGTH - low[x], *nobody(len(r)))
    return blocks.told([(number, blocks.pack(*(np.concatenate(z) for z in zip(*parts, strict=True)))) for number, parts in found.items()])


def _claim(block: blocks.Block, heard: list[tuple]) -> list[tuple]:
    doc, start, _, owner, their_doc, their_start = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in heard)]) for k in range(6))
    order = np.lexsort((start, doc))
    order = order[owner[order] >= 0]
    doc, start, owner, their_doc, their_start = (x[order] for x in (doc, start, owner, their_doc, their_start))
    return list({
        (int(owner[i]), int(their_doc[i]), int(their_start[i]), j - i + LENGTH - 1, block.texts[doc[i]][start[i] : start[i] + j - i + LENGTH - 1])
        for i, j in blocks.diagonals(doc, start, owner, their_doc, their_start, RUN)
    })


def _confirm(block: blocks.Block, doc: int, start: int, n: int, held: bytes) -> bool:
    return block.texts[doc][start : start + n] == held


def marked(block: blocks.Block, heard: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all bytes of the block's texts, which go; where each text starts; all bytes."""
    starts = np.cumsum([0] + [len(t) for t in block.texts])
    step = np.zeros(starts[-1] + 1, np.int32)
    for doc, start, end, *_ in heard:
        np.add.at(step, starts[doc] + start, 1)
        np.add.at(step, starts[doc] + end, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0, starts, np.frombuffer(b"".join(block.texts), np.uint8)


def _applied(block: blocks.Block, heard: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    gone, starts, raw = marked(block, heard)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[starts[:-1][starts[:-1] < len(gone)]] = gone[starts[:-1][starts[:-1] < len(gone)]]
    n, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in (gone, begins))
    kept = [raw[a:b][~gone[a:b]].tobytes() if c else t for a, b, c, t in zip(starts[:-1].tolist(), starts[1:].tolist(), n.tolist(), block.texts, strict=True)]
    return n, spans, kept


def _splitters(docs: DataFrame, block: int) -> np.ndarray:
    """Leading bytes that cut the sampled suffixes into as many equal parts as there are buckets, less one."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(16, max(8, -(-(size.n or 0) // block)) // blocks.PER_BUCKET)
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, 4 * SAMPLE / max(1, size.rows)) * (1 << 20)) + 1)
    texts = [(r.t or "").encode() for r in part.select(F.substring("text", 1, SAMPLE_BYTES).alias("t")).limit(SAMPLE).collect()]
    doc, at, _ = anchors(texts)
    if not len(doc):
        return np.zeros(0, f"S{LEAD}")
    lead = np.sort(_lead(around(texts, doc, at)[0]))
    return np.unique(lead[np.arange(1, buckets) * len(lead) // buckets])


def _run(docs: DataFrame, apply, out, block: int, often: int, keep: tuple[str, ...] = ()) -> DataFrame:
    return blocks.run(docs, _name, _hang(_splitters(docs, block)), _settle, _claim, _confirm, apply, out, often, block, keep)


def cleaned(docs: DataFrame, block: int = blocks.BLOCK, often: int = OFTEN) -> DataFrame:
    """The rows of docs with what stays in place of the text (what is left of a character that was cut goes too), without those of
    which nothing stays. A column n_chars, if there is one, counts anew; all others stay."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def apply(b: blocks.Block, heard: list[tuple]) -> pa.Table:
        n, _, kept = _applied(b, heard)
        texts = [k.decode("utf-8", "ignore") if c else k.decode() for k, c in zip(kept, n.tolist(), strict=True)]
        stay = np.array([bool(t) or not c for t, c in zip(texts, n.tolist(), strict=True)], bool)
        new = {"doc_id": b.id_array(), "text": pa.array(texts, pa.string()), **{c: b.column(c) for c in keep}}
        return pa.table(new).filter(pa.array(stay))

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(docs.schema[c] for c in keep)])
    done = _run(docs, apply, out, block, often, keep)
    if "n_chars" in keep:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup(docs: DataFrame, block: int = blocks.BLOCK, often: int = OFTEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay, of each row."""

    def apply(b: blocks.Block, heard: list[tuple]) -> pa.Table:
        n, spans, kept = _applied(b, heard)
        return pa.table({"doc_id": b.id_array(), "n_bytes": pa.array([len(t) for t in b.texts], pa.int64()), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return _run(docs, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", block, often)


def digest(docs: DataFrame, block: int = blocks.BLOCK, often: int = OFTEN) -> DataFrame:
    """dedup() with the SHA-256 of what stays in place of it."""

    def apply(b: blocks.Block, heard: list[tuple]) -> pa.Table:
        n, spans, kept = _applied(b, heard)
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table({"doc_id": b.id_array(), "n_bytes": pa.array([len(t) for t in b.texts], pa.int64()), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": sha})

    return _run(docs, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block, often)


SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {blocks.NO_ID}) AS o, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT r, o, i, array_slice(b, i, i + {LENGTH - 1}) AS string FROM (SELECT r, o, b, unnest(range(1, n - {LENGTH - 2})) AS i FROM d WHERE n >= {LENGTH})
), g AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY string ORDER BY o, i, r) AS k FROM s) WHERE k > 1
), e AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM g
), x AS MATERIALIZED (
  SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM e) GROUP BY r, k
), t AS (
  SELECT r, sum(z - a) AS removed, count(*) AS spans FROM x GROUP BY r
), p AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 1) AS a, a AS z FROM x UNION ALL SELECT r, max(z), NULL FROM x GROUP BY r
), h AS (
  SELECT p.r, string_agg(hex(array_slice(b, p.a, coalesce(p.z - 1, n))), '' ORDER BY p.a, p.z NULLS LAST) AS kept FROM p JOIN d ON p.r = d.r WHERE coalesce(p.z - 1, n) >= p.a GROUP BY p.r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN t ON d.r = t.r LEFT JOIN h ON d.r = h.r
"""
