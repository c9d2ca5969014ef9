import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import common, simhash, words

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_xxh64_of_all_lengths():
    rnd = random.Random(1)
    flat = np.frombuffer(rnd.randbytes(3000), np.uint8)
    starts = np.array([rnd.randrange(2800) for _ in range(4000)])
    ends = starts + np.array([rnd.randrange(200) for _ in range(4000)])
    got = words.xxh64(flat, starts, ends)
    assert all(int(g) == xxhash.xxh64_intdigest(flat[a:b].tobytes(), 42) for g, a, b in zip(got, starts, ends, strict=True))


def test_fingerprints_like_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n", "One", "a B c", "A b\x0bC d", "ÄB Äb é x y z", "w " * 3000] + [" ".join(rnd.choice("abcdef") * rnd.randrange(1, 9) for _ in range(rnd.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    rows = simhash.digest(docs).collect()
    want = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == want
    assert {r.doc_id: r.component_id for r in rows} == brute_components(want)


def test_groups_like_brute_force(spark):
    rnd = random.Random(3)
    prints = {}
    for c in range(12):
        x = rnd.getrandbits(64)
        for i in range(40):
            for _ in range(rnd.randrange(4)):
                x ^= 1 << rnd.randrange(64)
            prints[c * 40 + i] = x
    distinct = sorted({x for x in prints.values()})
    signed = [x - (1 << 64) if x >> 63 else x for x in distinct]
    df = spark.createDataFrame([(x, x) for x in signed], "node long, f0 long")
    for points, most in ((3, 1 << 40), (5, 1 << 40), (4, 1)):  # the last has every bit for a point
        rows = simhash.components(simhash.links(df, len(distinct), points=points, most=most), len(distinct)).collect()
        root = {r.node % (1 << 64): r.root % (1 << 64) for r in rows}
        want = brute_components(dict(enumerate(distinct)))
        mine, theirs = {}, {}
        for i, x in enumerate(distinct):
            mine.setdefault(root.get(x, x), set()).add(x)
            theirs.setdefault(want[i], set()).add(x)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def sets_of(linked, n):
    out = {}
    for i in range(n):
        out.setdefault(int(linked.root[i]), set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(("words", "bits"), [(1, 4), (4, 44)])
def test_tree_and_crowds_like_all_pairs(monkeypatch, words, bits):
    monkeypatch.setattr(simhash, "PAIRS", 64)
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, (12, words), dtype=np.uint64)
    rows = [b.copy() for b in base]
    for _ in range(300):
        x = rows[rng.integers(len(rows))].copy()
        for _ in range(rng.integers(0, bits)):
            x[rng.integers(words)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        rows.append(x)
    prints = np.unique(np.array(rows), axis=0)
    n, places = len(prints), np.arange(len(prints))
    want = simhash.Linked(n)
    i, j = np.nonzero(simhash._apart(prints[:, None], prints[None]) <= bits)
    want.join(i, j)
    got = simhash.Linked(n)
    for band in simhash.NARROW if words == 1 else simhash.WIDE:
        simhash.link(prints, places, places, band, bits, got)
    if words == 1:
        assert sets_of(got, n) == sets_of(want, n)
    else:
        assert len(sets_of(want, n)) <= len(sets_of(got, n)) <= len(sets_of(want, n)) + 1
    crowd = simhash.Linked(n)
    simhash._dense(prints, places, places, bits, crowd)
    assert sets_of(crowd, n) == sets_of(want, n)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(t.translate(LOWER)) for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(2000)]
    texts, origin = [], []
    for k in range(40):
        w = rnd.choices(vocab, k=rnd.randrange(150, 600))
        for copy in range(3):
            edited = list(w)
            for _ in range(copy * len(w) // 120):  # about 5 shingles an edit
                edited[rnd.randrange(len(w))] = "edit"
            texts.append(" ".join(edited))
            origin.append(3 * k)
    texts += [" ".join(rnd.choices(vocab, k=200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()}
    near = [i for i in range(120) if i != origin[i] and jaccard(texts[i], texts[origin[i]]) >= 0.8]
    assert len(near) > 60 and sum(i in kept for i in near) <= len(near) // 20
    assert kept >= {*origin, *range(120, 160)}


def families():
    rnd = random.Random(10)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "One  two", "a b c d e f " * 300 + "x y z u v", "a b c d e f " * 300 + "p q r s t"]
    for _ in range(60):
        w = rnd.choices(vocab, k=rnd.randrange(20, 200))
        for _ in range(4):
            edited = list(w)
            for _ in range(rnd.randrange(1 + len(w) // 25)):  # similarities around 0.8
                edited[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(edited))
    crowd = rnd.choices(vocab, k=200)
    for _ in range(120):
        edited = list(crowd)
        for _ in range(rnd.randrange(9)):
            edited[rnd.randrange(200)] = rnd.choice(vocab)
        texts.append(" ".join(edited))
    return texts


@pytest.fixture(scope="module")
def alike_like_brute_force():
    texts = families()
    root = list(range(len(texts)))
    near = [(i, j, jaccard(texts[i] or "", texts[j] or "")) for i in range(len(texts)) for j in range(i)]
    for _ in texts:
        for i, j, s in near:
            if s >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    assert sum(0.6 < s < 0.8 for _, _, s in near) > 60 < sum(0.8 <= s < 1 for _, _, s in near)
    assert sum(r >= len(texts) - 120 for r in set(root)) > 5  # some of the crowd are like nobody
    return texts, root


@pytest.mark.parametrize("group", [simhash.GROUP, 7])
def test_stage_like_brute_force_jaccard(spark, alike_like_brute_force, group):
    texts, root = alike_like_brute_force
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, group=group).collect()}
    assert got == dict(enumerate(root))
    if group == simhash.GROUP:
        kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
        assert kept == {i for i, r in enumerate(root) if i == r}


def test_alike_like_each_pair():
    rng = np.random.default_rng(12)
    own = [np.unique(rng.choice(60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)] + [np.arange(3000, dtype=np.uint64), np.arange(100, 3000, dtype=np.uint64)]
    asks = np.array([0, 3, 7, 41])
    want = {(i, j) for i in asks for j in range(len(own)) if i != j and simhash.similarity(own[i], own[j]) >= 0.5}
    assert set(zip(*(x.tolist() for x in simhash.alike(own, asks, 0.5)), strict=True)) == want and (41, 40) in want
    assert [len(x) for x in simhash.alike(own[:1], asks[:1], 0.5)] == [0, 0]


def test_no_shard_is_above_its_bound(spark):
    rnd = F.xxhash64
    prints = spark.range(10**6).select(F.col("id").alias("node"), *(rnd("id", F.lit(w)).alias(f"f{w}") for w in range(4)))
    for bands, points, copies in ((simhash.WIDE[:2], 2, 3), (simhash.NARROW[:1], 4, 9)):
        sizes = lambda p, bands=bands: simhash._sent(prints, bands, p, ["node"]).groupBy("band", "shard").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        coarse, fine = sizes(points), sizes(None)
        assert coarse["all"] == copies * len(bands) * 10**6 and coarse.most <= simhash.SHARE[points] * 10**6 < 1.3 * coarse.most
        assert fine.most <= 1000 and coarse.most <= simhash.MOST


def test_components_of_a_star_and_a_chain(spark):
    star = [(0, i) for i in range(1, 3000)]
    chain = [(i, i + 1) for i in range(5000, 5200)]
    other = [(9000, 8999), (9001, 8999), (9002, 9001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(star + chain + other, "a long, b long"), 4000).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5201)} | {i: 8999 for i in (9000, 9001, 9002)}


def test_hot_keys_are_spread(spark):
    left = spark.range(5000).select((F.when(F.col("id") < 3000, 1).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "hot"), (4000, "some")], "k long, x string")
    got = common.looked_up(left, right, "k", 5000)
    assert {(r.k, r.v, r.x) for r in got.collect()} == {(1, i, "hot") for i in range(3000)} | {(i, i, "some" if i == 4000 else None) for i in range(3000, 5000)}
    assert got.count() == 5000


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "same text of words here"), (7, "same text of words here"), (7, "same text of words here")], "doc_id long, text string")
    assert [r.component_id for r in simhash.digest(docs).collect()] == [7, 7, 7]
    assert simhash.digest(docs.where("doc_id = 1")).collect() == []
    assert simhash.near_duplicates(docs.where(F.col("doc_id").isNull())).first().component_id is None
