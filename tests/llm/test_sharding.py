import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import sharding


def test_hypergeometric_is_exact(spark):
    n = 20_000
    df = spark.range(n).select(sharding._hypergeometric(F.lit(7).cast("long"), F.lit(20).cast("long"), F.lit(9).cast("long"), (F.col("id") + 0.5) / n).alias("x"))
    got = Counter(r.x for r in df.collect())
    for x in range(8):
        p = math.comb(7, x) * math.comb(13, 9 - x) / math.comb(20, 9)
        assert abs(got[x] / n - p) < 2e-4


def test_large_draws_keep_the_mean(spark):
    m, t, k = 10**7, 4 * 10**8, 10**8
    df = spark.range(99).select(sharding._hypergeometric(F.lit(m).cast("long"), F.lit(t).cast("long"), F.lit(k).cast("long"), (F.col("id") + 0.5) / 99).alias("x"))
    x = [r.x for r in df.collect()]
    assert x == sorted(x) and abs(sum(x) / 99 - m * k / t) < 30 and x[0] > 2.49e6


@pytest.mark.parametrize("sizes", [[5], [0, 3, 9], [1] * 17, [100, 1, 50, 7]])
def test_matrix_has_both_margins(spark, sizes):
    counts = spark.createDataFrame(list(enumerate(sizes)), "source long, n long")
    rows = sharding.matrix(counts, 4, 3).collect()
    assert {r.source: sum(r.sends) for r in rows} == {i: n for i, n in enumerate(sizes) if n}
    total = [sum(c) for c in zip(*(r.sends for r in rows), strict=True)]
    assert sum(total) == sum(sizes) and max(total) - min(total) <= 1


def test_shuffle_is_whole_even_and_gapless(spark):
    rows = [(None, None, 1), (1, "x", 1), (1, "x", 1)] + [(i, "t" * (i % 7), 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.shuffle(docs, 8, bucket_rows=20).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))


def xx(*values):
    """Spark's xxhash64 of ints (as (value, 4)) and longs."""
    h = 42
    for v in values:
        v, width = v if isinstance(v, tuple) else (v, 8)
        h = xxhash.xxh64_intdigest(v.to_bytes(width, "little", signed=True), h)
    return h


def draw(marked, total, drawn, u):
    """The inverse of the distribution, in whole numbers."""
    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    below, x = 0, low
    while x < high:
        below += math.comb(marked, x) * math.comb(total - marked, drawn - x)
        if below / math.comb(total, drawn) > u:
            break
        x += 1
    return x


def plain_matrix(sources, caps, seed, level=0):
    """{source: what it sends to each shard}, by the same tree."""
    if len(sources) == 1:
        return {sources[0][0]: caps}
    half = -(-len(sources) // 2)
    total, sent, left = sum(n for _, n in sources), sum(n for _, n in sources[:half]), []
    for s, cap in enumerate(caps):
        u = (xx((seed + level, 4), sources[0][0], (s, 4)) >> 11) / float(1 << 53)
        left.append(draw(cap, total, sent, u))
        total, sent = total - cap, sent - left[-1]
    right = [a - b for a, b in zip(caps, left, strict=True)]
    return plain_matrix(sources[:half], left, seed, level + 1) | plain_matrix(sources[half:], right, seed, level + 1)


def test_shuffle_like_plain_python(spark):
    docs = spark.createDataFrame([(i // 3, "t" * (i % 5)) for i in range(700)] + [(None, None)] * 3, "doc_id long, text string").repartition(6)
    shards, seed = 9, 4
    rows = [r.row for r in docs.select(F.monotonically_increasing_id().alias("row")).collect()]
    of = Counter(r >> 33 for r in rows)
    caps = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    sends = plain_matrix(sorted(of.items()), caps, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    where = {}
    for source, n in sends.items():
        mine = sorted((r for r in rows if r >> 33 == source), key=lambda r: (signed(xx((seed, 4), (1, 4), r)), r))
        shard = [s for s, k in enumerate(n) for _ in range(k)]
        where |= dict(zip(mine, shard, strict=True))
    want = {}
    for s in range(shards):
        mine = sorted((r for r in rows if where[r] == s), key=lambda r: xx((seed, 4), (2, 4), r))
        want |= {r: (s, k) for k, r in enumerate(mine)}
    for bucket_rows in (10**6, 20):
        kept = docs.withColumn("row", F.monotonically_increasing_id())
        assert {r.row: (r.shard, r.slot) for r in sharding.shuffle(kept, shards, seed, bucket_rows).collect()} == want


def test_digest_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "é")], "doc_id long, text string")
    rows = {r.doc_id: r for r in sharding.digest(docs).collect()}
    assert (rows[1]["size"], rows[1].text_crc32, rows[2]["size"], rows[2].law, rows[2].grown_shard) == (16, 0, 18, "rows", None)
    assert sharding.digest(docs.limit(0)).collect() == []


def test_uniform_over_shards(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(3)
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffle(docs, 3, seed).where("doc_id < 20").collect():
            seen[r.shard] += 1
    assert sum(seen.values()) == 240 and all(50 < v < 110 for v in seen.values())
