"""SimHash fingerprints and their groups at a small Hamming distance, by vantage-point shards and trees; and groups by the Jaccard
similarity of shingles, for which fingerprints only say who may belong together.

All 64 bits of a fingerprint are nearly as far from any vantage point (32 bits or so, give or take 4), so a tree over
whole fingerprints prunes next to nothing at 4 bits. The fingerprints are therefore cut into parts: two that differ in at
most 4 bits differ in at most 1 in some of three parts. Each part has vantage points, and the distances to
them, the rings, name a shard. By the triangle bound a neighbour at distance 1 is exactly one ring further in or out
from every vantage point, so a fingerprint is sent to its own shard and, as a query, to the overlapping shards that lie
outwards from the first point. As there are more fingerprints there are more points, up to one for each bit, which tell every
value of the part from every other. A shard joins its members and queries by a local tree with the same bounds and full
checks, and returns only who belongs with whom, not all pairs. Connected components of that are taken across shards.

Equal fingerprints are merged before all this. Defined results: a null or empty text has the fingerprint zero, which is
linked like any other; rows with a null id belong to the groups of the others, and to a group without id if there are
none; repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, looked_up, materialise
from .cover import mix
from .words import chunks, joined, xxh64

#: Word, low bit and width of each part: of a fingerprint of 64 bits, whose parts meet all that differ in at most 5; and of one of
#: 256 bits, whose parts meet nearly all that differ in up to a sixth of the bits (see similar_groups).
NARROW = ((0, 0, 22), (0, 22, 21), (0, 43, 21))
WIDE = tuple((word, low, 16) for word in range(4) for low in (0, 16, 32, 48))
#: The first vantage points of a part: as many of these constants' bits as it is wide; and by how many of them are used, the rows,
#: members and queries, that the largest shard has for each fingerprint, if the bits of parts as above are even.
POINTS = (0x0000000000000000, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF)
SHARE = {2: 0.195, 4: 0.042}
#: Rows of a shard from which on every bit is a vantage point; rows of shards that are worked on in one go.
MOST, ROWS = 200_000, 200_000
#: Bytes of text worked on at a time, and fingerprint pairs compared at a time.
TEXT, PAIRS = 1 << 20, 1 << 19
#: Texts, and shingles of them, that are compared with each other in one go.
GROUP, SHINGLES = 1000, 1 << 20


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of every shingle of so many words, lower-cased in A-Z, and the text it is of; a shorter text is one shingle."""
    flat, starts, ends, of = joined(texts, lower=True)
    n = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), int)
    first = np.cumsum(n) - n
    k = np.arange(len(of))
    begins = k[np.where(n[of] >= size, k + size <= first[of] + n[of], k == first[of])] if len(of) else k
    last = np.minimum(begins + size, (first + n)[of[begins]]) - 1
    return xxh64(flat, starts[begins], ends[last]), of[begins]


def sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and the text each is of."""
    hashes, doc = shingles(texts, size)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def fingerprints(texts: list[bytes], size: int = 4, words: int = 1) -> np.ndarray:
    """Of each text, by its shingles of so many words: a row of 64-bit words, the first by the hashes themselves, others by hashes of
    them."""
    return _prints(*shingles(texts, size), len(texts), words)


def _prints(hashes: np.ndarray, doc: np.ndarray, texts: int, words: int) -> np.ndarray:
    total = np.bincount(doc, minlength=texts) if len(doc) else np.zeros(texts, int)
    out = np.zeros((texts, words), np.uint64)
    for w in range(words):
        ones = np.zeros((texts, 64), np.int64)
        for at in range(0, len(hashes), 1 << 17):
            part = hashes[at : at + (1 << 17)]
            part = mix(part + np.uint64(w)) if w else part
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cut = np.nonzero(np.diff(doc[at : at + len(part)], prepend=-1))[0]
            ones[doc[at + cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        out[:, w] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprinted(docs: DataFrame, size: int = 4, words: int = 1, text: str = "text") -> DataFrame:
    """doc_id, node and words f0, f1 and so on of each row; node names the fingerprint: the one word itself, or a hash of all."""
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], TEXT):
                prints = fingerprints(texts[a:b], size, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(prints[:, w].copy()) for w in range(words))], names=["doc_id", *names])

    done = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))
    return done.withColumn("node", F.col("f0") if words == 1 else F.xxhash64(*names))


def _part(prints: np.ndarray, band: tuple[int, int, int]) -> np.ndarray:
    word, low, width = band
    return (prints[..., word] >> np.uint64(low)) & np.uint64((1 << width) - 1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ, by words in the last axis."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for w in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


class Linked:
    """Sets of fingerprints that links have joined so far: union by the smaller place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            ri, rj = root[i], root[j]
            differ = ri != rj
            if not differ.any():
                return
            i, j = i[differ], j[differ]
            np.minimum.at(root, np.maximum(ri[differ], rj[differ]), np.minimum(ri[differ], rj[differ]))
            while (root != root[root]).any():
                root[:] = root[root]


def link(prints: np.ndarray, queries: np.ndarray, members: np.ndarray, band: tuple[int, int, int], bits: int, linked: Linked, depth: int = 0) -> None:
    """Links every query (place in prints) with every member at most bits apart whose part differs in one bit at most: a vantage-point
    tree over the part, with checks of whole fingerprints at its leaves."""
    if not len(queries) or not len(members):
        return
    if len(queries) * len(members) <= PAIRS:
        _leaf(prints, queries, members, bits, linked)
        return
    part = _part(prints[members], band)
    point = part[(depth * 7919) % len(members)]
    near = np.bitwise_count(part ^ point).astype(int)
    if (part == point).all():
        _dense(prints, queries, members, bits, linked)
        return
    asked = np.bitwise_count(_part(prints[queries], band) ^ point).astype(int)
    # members in rings, queries wherever the triangle bound lets them have a neighbour
    for r in np.unique(near):
        link(prints, queries[np.abs(asked - r) <= 1], members[near == r], band, bits, linked, depth + 1)


def _leaf(prints: np.ndarray, queries: np.ndarray, members: np.ndarray, bits: int, linked: Linked) -> None:
    step = max(1, PAIRS // len(members))
    for at in range(0, len(queries), step):
        i, j = np.nonzero(_apart(prints[queries[at : at + step], None], prints[members][None]) <= bits)
        linked.join(queries[at + i], members[j])


def _dense(prints: np.ndarray, queries: np.ndarray, members: np.ndarray, bits: int, linked: Linked, leaders: int = 32) -> None:
    """For many fingerprints with the same part: leaders first link all that is near them, which joins a crowd of near copies in
    one pass each; then only what isn't in the largest set yet is compared with all."""
    everyone = np.unique(np.concatenate([queries, members]))
    rest = everyone
    for _ in range(leaders):
        if not len(rest):
            break
        near = _apart(prints[rest], prints[rest[0]][None]) <= bits
        linked.join(rest[near], np.full(near.sum(), rest[0]))
        rest = rest[~near]
    roots, size = np.unique(linked.root[everyone], return_counts=True)
    others = everyone[linked.root[everyone] != roots[np.argmax(size)]]
    for at in range(0, len(everyone), PAIRS):
        if len(others):
            _leaf(prints, others, everyone[at : at + PAIRS], bits, linked)


def _copies(k: int, band: tuple[int, int, int], points: int | None) -> Column:
    """An array of (band, shard, query) for the k-th part of a fingerprint: its own shard, and those that lie outwards."""
    word, low, width = band
    part = F.shiftrightunsigned(F.col(f"f{word}"), low).bitwiseAND(F.lit((1 << width) - 1))
    copy = lambda shard, query: F.struct(F.lit(k).alias("band"), shard.alias("shard"), F.lit(query).alias("query"))
    if points is None:
        # outwards from the first point is one more bit set
        unset = F.filter(F.array(*(F.lit(1 << i).cast("long") for i in range(width))), lambda x: part.bitwiseAND(x) == 0)
        return F.concat(F.array(copy(part, False)), F.transform(unset, lambda x: copy(part.bitwiseOR(x), True)))
    rings = [F.bit_count(part.bitwiseXOR(F.lit(p & ((1 << width) - 1)))) for p in POINTS[:points]]
    name = lambda shift: F.xxhash64(*(r + s for r, s in zip(rings, shift, strict=True)))
    outwards = [(1, *((1 if j >> i & 1 else -1) for i in range(points - 1))) for j in range(1 << (points - 1))]
    return F.array(copy(name((0,) * points), False), *(copy(name(o), True) for o in outwards))


def _sent(prints: DataFrame, bands: tuple, points: int | None, names: list[str]) -> DataFrame:
    """band, shard, query and the named columns of each fingerprint for every shard that it is a member of or asks; points is None for
    one for each bit."""
    copies = F.concat(*(_copies(k, band, points) for k, band in enumerate(bands)))
    return prints.select(*names, F.explode(copies).alias("x")).select("x.*", *names)


def links(prints: DataFrame, n: int, bits: int = 4, bands: tuple = NARROW, points: int = 4, most: int = MOST) -> DataFrame:
    """(a, b) by node, b < a, such that the components of these pairs are those of all pairs at most bits apart, of which a part
    differs in one bit at most. prints: n distinct fingerprints. There are more shards where one might hold more than most of them;
    small shards are worked on together."""
    names = ["node", *(c for c in prints.columns if c[0] == "f")]
    fine = n * SHARE.get(points, 1.0) > most
    each = len(bands) * (2 + max(width for _, _, width in bands) // 2 if fine else 1 + (1 << (points - 1)))
    sent = _sent(prints, bands, None if fine else points, names).withColumn("bucket", F.pmod(F.xxhash64("band", "shard"), F.lit(max(8, n * each // ROWS))))

    def local(table: pa.Table) -> pa.Table:
        node, print_of = np.unique(table.column("node").to_numpy(), return_inverse=True)
        prints = np.zeros((len(node), len(names) - 1), np.uint64)
        prints[print_of] = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names[1:]], axis=1)
        band, shard, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("band", "shard", "query"))
        linked = Linked(len(node))
        order = np.lexsort((shard, band))
        cut = np.nonzero((np.diff(band[order]) != 0) | (np.diff(shard[order]) != 0))[0] + 1
        for rows in np.split(order, cut):
            members = np.unique(print_of[rows[~asks[rows]]])
            link(prints, np.unique(print_of[rows]), members, bands[band[rows[0]]], bits, linked)
        moved = linked.root != np.arange(len(node))
        return pa.table({"a": node[moved], "b": node[linked.root[moved]]})

    return sent.groupBy("bucket").applyInArrow(local, "a long, b long").distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def alike(own: list[np.ndarray], queries: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), places in own, of all pairs of a query (a place) with any other set that are so similar, by counts of what they share."""
    if len(own) == 1:
        return queries[:0], queries[:0]
    if len(own) == 2:
        return (np.array([0]), np.array([1])) if similarity(*own) >= similar else (queries[:0], queries[:0])
    n = np.array([len(x) for x in own], np.float64)
    flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), n.astype(int))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = times[column] > 1  # what only one has is shared by none
    column, of = (np.cumsum(times > 1) - 1)[column[some]], of[some]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    shared = np.zeros((len(queries), len(own)), np.float32)
    width = 1024
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        has = np.zeros((len(own), width), np.float32)
        has[of[a:b], column[a:b] - first] = 1
        shared += has[queries] @ has.T
    left, right = [queries[:0]], [queries[:0]]
    for k in range(0, len(queries), 128):
        both = n[queries[k : k + 128]][:, None] + n[None] - shared[k : k + 128]
        i, j = np.nonzero(shared[k : k + 128] / np.maximum(both, 1) >= similar)
        left.append(queries[k + i])
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    return i[i != j], j[i != j]


def _nodes(hashes: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """A name for each text's set of shingles."""
    cut = 8 * np.searchsorted(doc, np.arange(texts + 1))
    return xxh64(hashes.view(np.uint8), cut[:-1], cut[1:]).view(np.int64)


def named(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the node that names its set of shingles, their number n, and f0 to f3: a fingerprint of the set."""
    names = [f"f{w}" for w in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            for a, b in chunks([len(t) for t in texts], TEXT):
                hashes, doc = sets(texts[a:b], size)
                prints = _prints(hashes, doc, b - a, 4).view(np.int64)
                n = np.bincount(doc, minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_nodes(hashes, doc, b - a)), pa.array(n), *(pa.array(prints[:, w].copy()) for w in range(4))], names=["doc_id", "node", "n", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", "node long", "n long", *(f"{f} long" for f in names)]))


def _with_node(df: DataFrame, size: int) -> DataFrame:
    """Adds own, the node that names the set of each row's text."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), TEXT):
                part = batch.slice(a, b - a)
                hashes, doc = sets([(x or "").encode() for x in part.column("text").to_pylist()], size)
                yield part.set_column(part.schema.get_field_index("own"), "own", pa.array(_nodes(hashes, doc, b - a)))

    df = df.withColumn("own", F.lit(0).cast("long"))
    return df.mapInArrow(name, df.schema)


def _texts(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(node, family, parts, text), a row for each of members (node, least, family, parts): the text of the document with the id least whose
    set is the node. An id may be there with several texts, and those without an id are looked up by their sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("least"), "text")
    # as at any size: neither side is small, so both are exchanged by id, and equal rows are merged where they meet
    met = rows.where("least is not null").join(members.where("least is not null").hint("merge"), "least").distinct()
    with_id = _with_node(met, size).where("own = node").select("node", "family", "parts", "text")
    nameless = _with_node(rows.where("least is null").select("text").distinct(), size).groupBy(F.col("own").alias("node")).agg(F.first("text").alias("text"))
    without = nameless.join(members.where("least is null").select("node", "family", "parts"), "node").select("node", "family", "parts", "text")
    return with_id.unionByName(without)


def _within(texts: DataFrame, buckets: int, size: int, similar: float) -> DataFrame:
    """(a, b) by node, b < a, whose components are those of all pairs of texts of one part that are so similar, with at least one that asks.
    texts: part (of bounded size), node, ask, text. Parts are worked on together, many at a time."""

    def local(table: pa.Table) -> pa.Table:
        part, order = table.column("part").to_numpy(), np.argsort(table.column("part").to_numpy(), kind="stable")
        node, asks = table.column("node").to_numpy(), table.column("ask").to_numpy(zero_copy_only=False)
        raw = [(x or "").encode() for x in table.column("text").to_pylist()]
        own: list[np.ndarray] = []
        for a, b in chunks([len(t) for t in raw], TEXT):
            hashes, doc = sets(raw[a:b], size)
            own += np.split(hashes, np.searchsorted(doc, np.arange(1, b - a)))
        left, right = [node[:0]], [node[:0]]
        for rows in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
            rows = rows[np.argsort(node[rows], kind="stable")]
            linked = Linked(len(rows))
            linked.join(*alike([own[r] for r in rows], np.nonzero(asks[rows])[0], similar))
            moved = linked.root != np.arange(len(rows))
            left.append(node[rows][moved])
            right.append(node[rows][linked.root[moved]])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    keyed = texts.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    return keyed.select("bucket", "part", "node", "ask", "text").groupBy("bucket").applyInArrow(local, "a long, b long").where("a <> b")


def components(pairs: DataFrame, nodes: int) -> DataFrame:
    """(node, root): the smallest node of each one's component, by alternating large and small stars until nothing changes. Centres
    with very many links are spread over tasks. nodes: how many there are at most."""
    edges = checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), nodes)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = tuple(state), state[0]
        # what is larger than a node goes to the least of what the node is linked with; that is the node itself if nothing is less
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = looked_up(edges, least, "b", n).select("a", F.coalesce("m", "b").alias("b"))
        large = checkpoint(large.distinct(), n)
        # what is less than a node goes to the least of that, and so does the node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = looked_up(large, least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = checkpoint(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), n)


def _rooted(prints: DataFrame, distinct: DataFrame, found: DataFrame, nodes: int) -> DataFrame:
    """prints with the root of its node and the component_id, the least id of all nodes that found (node, root) puts together."""
    rooted = checkpoint(distinct.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), nodes)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = checkpoint(looked_up(rooted.select("node", "root"), least, "root", nodes).select("node", "root", "component_id"), nodes)
    return looked_up(prints, of, "node", prints.count(), stored=True)


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4, bands: tuple = NARROW, points: int = 4, text: str = "text") -> DataFrame:
    """doc_id, the fingerprint's words, and component_id, the smallest doc_id reachable by links of at most bits."""
    words = 1 + max(word for word, _, _ in bands)
    prints = checkpoint(fingerprinted(docs, size, words, text))
    names = [f"f{w}" for w in range(words)]
    distinct = checkpoint(prints.groupBy("node", *names).agg(F.min("doc_id").alias("least")), prints.count())
    nodes = distinct.count()
    found = components(links(distinct.drop("least"), nodes, bits, bands, points), nodes)
    return _rooted(prints, distinct, found, nodes).drop("node", "root")


def _groups(docs: DataFrame, size: int, similar: float, bits: int, group: int, shingles: int) -> DataFrame:
    """similar_groups() with the node of each text and the root of its group, which is the smallest node in it.

    Fingerprints of 256 bits tell who may belong together, the sets decide. Sets at 0.8 differ in 39 bits, give or take 6, and those at 0.9
    in 26; whoever is linked by up to 60, directly or by others, is one family, and the 16 parts of the fingerprint miss half a
    percent of lone pairs at 0.8. The texts of each family meet, and all its pairs are compared by their sets. A family of more
    than group texts or so many shingles is dealt into parts of that size, three times over; after that nearly all of it is in
    one group, and what isn't is compared, part by part, with every text of the family. So only links come out, at most one for each
    text and comparison of parts, however many pairs are alike, and no part is larger than its bound."""
    names = [f"f{w}" for w in range(4)]
    prints = checkpoint(named(docs, size))
    distinct = checkpoint(prints.groupBy("node", "n", *names).agg(F.min("doc_id").alias("least")), prints.count())
    nodes = distinct.count()
    family = components(links(distinct.select("node", *names), nodes, bits, WIDE, 2), nodes)
    family = checkpoint(family.unionByName(family.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "family"), nodes)
    members = distinct.join(family, "node").select("node", "n", "least", "family")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / group), F.ceil(F.sum("n") / shingles), F.lit(1)).cast("long")
    sizes = checkpoint(members.groupBy("family").agg(parts.alias("parts"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("all")), nodes)
    total = sizes.agg(F.sum("all_n").alias("n"), F.sum("all").alias("all"), F.count_if(F.col("parts") > 1).alias("large")).first()
    most = total["all"] or 0
    members = checkpoint(looked_up(members.drop("n"), sizes.select("family", "parts"), "family", most), most)
    buckets = max(8, (total.n or 0) // shingles)
    dealt = lambda salt: F.xxhash64("family", F.pmod(F.xxhash64("node", F.lit(salt)), "parts")).alias("part")
    within = lambda texts: checkpoint(_within(texts, buckets, size, similar).coalesce(8 + buckets))
    texts = _texts(docs, members, size)
    if not total.large:
        found = within(texts.select(dealt(0), "node", F.lit(True).alias("ask"), "text"))
        return _rooted(prints, distinct, components(found, most), nodes).select("doc_id", "node", "root", "component_id")
    texts = materialise(texts.coalesce(8 + buckets))
    crowds = texts.where("parts > 1")
    found = within(texts.select(dealt(0), "node", F.lit(True).alias("ask"), "text"))
    for salt in (1, 2):
        found = found.unionByName(within(crowds.select(dealt(salt), "node", F.lit(True).alias("ask"), "text")))
    # of each large family, the texts outside its largest group against all of it
    of = crowds.select("node", "family", "parts").join(components(found, most), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = checkpoint(of, most)
    main = of.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    rest = checkpoint(looked_up(of, main, "family", most).where("root <> main").select("node", "family", "parts"), most)
    asked = rest.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / group).alias("turns"))
    turn = F.pmod(F.xxhash64("node", F.lit(3)), "turns")
    cell = lambda turn, part: F.xxhash64("family", turn, part).alias("part")
    every = looked_up(crowds, asked, "family", most).where("turns is not null").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    targets = every.select(cell(F.col("turn"), F.pmod(F.xxhash64("node", F.lit(0)), "parts")), "node", F.lit(False).alias("ask"), "text")
    asking = looked_up(rest.join(crowds.select("node", "text"), "node"), asked, "family", most).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = asking.select(cell(turn, F.col("cell")), "node", F.lit(True).alias("ask"), "text")
    found = found.unionByName(within(targets.unionByName(queries)))
    return _rooted(prints, distinct, components(found, most), nodes).select("doc_id", "node", "root", "component_id")


def similar_groups(docs: DataFrame, size: int = 5, similar: float = 0.8, bits: int = 60, group: int = GROUP, shingles: int = SHINGLES) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by links between texts whose sets of shingles are so similar."""
    return _groups(docs, size, similar, bits, group, shingles).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similar: float = 0.8) -> DataFrame:
    """Of each group of near copies the row whose id names it. Rows without an id go if their group has one with an id, and else one of them
    stays; of rows with the same id and text one stays, whatever their other columns."""
    found = _groups(docs, size, similar, 60, GROUP, SHINGLES)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.where("doc_id is not null").withColumn("__id", F.col("doc_id").cast("long"))
    # as at any size neither side is small; rows meet by id once, for the join and for merging equal ones
    kept = rows.join(stay.hint("merge"), "__id", "left_semi").dropDuplicates(["__id", "text"]).drop("__id")
    alone = found.where(F.col("doc_id").isNull() & F.col("component_id").isNull() & (F.col("node") == F.col("root"))).select(F.col("node").alias("__node")).distinct()
    own = {"own": "__own"} if "own" in docs.columns else {}
    nameless = _with_node(docs.where("doc_id is null").dropDuplicates(["text"]).withColumnsRenamed(own), size)
    nameless = nameless.join(alone, F.col("own") == F.col("__node"), "left_semi").dropDuplicates(["own"]).drop("own").withColumnsRenamed({v: k for k, v in own.items()})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(nameless.select(*columns))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
