"""A uniform shuffle into shards of exact sizes, in DataFrame expressions only.

The rows are written once, and the partitions of that table are the sources. From the counts of the sources and the
sizes of the shards an exact communication matrix is drawn: row p says how many rows source p sends to each shard,
with the probabilities that a uniform permutation of all rows would give. The matrix is drawn down a binary tree over
the sources; each node splits what it sends between its halves by hypergeometric draws, shard after shard. Every source
then permutes its rows and deals them out by its row of the matrix, and every shard permutes what it has got.

Draws and permutations hash a seed and the places of rows, so a table that is read in the same partitions gives the same shards, and
one that is split otherwise gives others that are as uniform. Sizes of shards are at most one apart.

Defined results: null keys and texts are rows like any other; repeated rows are dealt out one by one; an empty table
gives an empty one; columns shard and slot of the input are replaced, working columns start with two underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let

#: Rows that a shard permutes in one task, about; a draw looks this many standard deviations to either side of the mode.
BUCKET_ROWS, WIDE = 200_000, 12


def _log_factorial(n: Column) -> Column:
    """ln n!: exact products to 20, Stirling's series beyond (error below 1e-14 relative)."""
    x = F.greatest(n, F.lit(20)).cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    small = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(21)))
    return F.when(n <= 20, F.get(small, F.least(n, F.lit(20)).cast("int"))).otherwise(series)


def _hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn rows are marked, where marked of total are: the inverse of the distribution at u in [0, 1)."""
    m, n, k = marked.cast("double"), total.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    spread = F.sqrt(F.greatest(F.lit(0.0), k * (m / n) * (1 - m / n) * ((n - k) / F.greatest(n - 1, F.lit(1.0)))))
    mode = F.floor((k + 1) * (m + 1) / (n + 2))
    first = F.greatest(low, (mode - F.ceil(WIDE * spread) - WIDE).cast("long"))
    last = F.least(high, (mode + F.ceil(WIDE * spread) + WIDE).cast("long"))
    choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)
    start = F.exp(choose(marked, first) + choose(total - marked, drawn - first) - choose(total, drawn))

    def walk(s: Column, x: Column) -> Column:
        below = s.mass + s.p
        nxt = s.p * ((m - x) * (k - x)) / ((x + 1) * (n - m - k + x + 1))
        return F.struct((s.got + F.when(below <= u, 1).otherwise(0)).alias("got"), below.alias("mass"), nxt.alias("p"))

    steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    got = F.aggregate(steps, F.struct(F.lit(0).alias("got"), F.lit(0.0).alias("mass"), start.alias("p")), walk, lambda s: s.got)
    return F.when(low >= high, low).otherwise(first + got)


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def _left(sizes: Column, caps: Column, half: Column, name: Column, seed: Column) -> Column:
    """What the left half of a node's sources sends to each shard."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    sent = F.aggregate(F.slice(sizes, F.lit(1), half), F.lit(0).cast("long"), lambda a, x: a + x)

    def step(s: Column, cap: Column) -> Column:
        draw = let(_hypergeometric(cap, s.total, s.sent, _uniform(seed, name, F.size(s.out))), lambda d: F.struct(d.alias("d")))
        return let(draw, lambda x: F.struct((s.total - cap).alias("total"), (s.sent - x.d).alias("sent"), F.concat(s.out, F.array(x.d)).alias("out")))

    return F.aggregate(caps, F.struct(total.alias("total"), sent.alias("sent"), F.array().cast("array<bigint>").alias("out")), step, lambda s: s.out)


def matrix(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """From (source, n): (source, sends), sends[s] being the rows that go to shard s. counts has a row a source."""
    nodes = counts.where("n > 0").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all")).where(F.size("all") > 0)
    total = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x.n)
    share = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(F.col("__total") / shards) + F.when(s < F.col("__total") % shards, 1).otherwise(0)).cast("long"))
    nodes = nodes.withColumn("__total", total).select(F.transform("all", lambda x: x.source).alias("sources"), F.transform("all", lambda x: x.n).alias("sizes"), share.alias("caps"), F.lit(0).alias("level"))
    n = max(1, counts.count())
    for _ in range(math.ceil(math.log2(n))):
        many = F.size("sizes") > 1
        half = F.ceil(F.size("sizes") / 2).cast("int")
        # the level is a column, so that every level is the same plan
        nodes = nodes.withColumn("__seed", F.lit(seed) + F.col("level")).withColumn("__left", F.when(many, _left(F.col("sizes"), F.col("caps"), half, F.element_at("sources", 1), F.col("__seed"))))
        part = lambda first, length, caps: F.struct(F.slice("sources", first, length).alias("sources"), F.slice("sizes", first, length).alias("sizes"), caps.alias("caps"), (F.col("level") + 1).alias("level"))
        rest = F.zip_with("caps", "__left", lambda a, b: a - b)
        both = F.array(part(F.lit(1), half, F.col("__left")), part(half + 1, F.size("sizes") - half, rest))
        nodes = nodes.select(F.explode(F.when(many, both).otherwise(F.array(part(F.lit(1), F.lit(1), F.col("caps"))))).alias("x")).select("x.*")
        # later draws in more tasks, of 32 sources or so, and a plan of bounded depth
        nodes = checkpoint(nodes.repartition(F.element_at("sources", 1)).coalesce(4 + n // 32))
    return nodes.select(F.element_at("sources", 1).alias("source"), F.col("caps").alias("sends"))


def shuffle(docs: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds shard in [0, shards) and slot, gapless from 0 in each shard."""
    mid = F.monotonically_increasing_id()
    rows = checkpoint(docs.drop("shard", "slot").withColumn("__row", mid))
    source = F.shiftright("__row", 33)
    counts = rows.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    sends = matrix(counts, shards, seed).select(F.col("source").alias("__source"), "sends")
    until = F.aggregate("sends", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    # each source permutes its own rows where they are
    local = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), F.lit(1), "__row"), "__row").withColumn("__at", mid.bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = local.withColumn("__source", source).join(sends.select("__source", until.alias("__until")), "__source")
    dealt = dealt.withColumn("shard", F.size(F.filter("__until", lambda x: x <= F.col("__at"))))
    # a shard permutes by a random key, in buckets of the key's leading part that hold a bounded number of rows
    n = rows.count()
    buckets = max(1, math.ceil(n / shards / bucket_rows))
    key = F.xxhash64(F.lit(seed), F.lit(2), "__row")
    dealt = dealt.withColumn("__key", key).withColumn("__bucket", F.floor(F.shiftrightunsigned("__key", 11).cast("double") / float(1 << 53) * buckets).cast("int"))
    filled = dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    return _slots(dealt.drop("__source", "__until", "__at"), filled)


def _slots(dealt: DataFrame, filled: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    before = filled.withColumn("__before", F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("shard").alias("__shard"), F.col("__bucket").alias("__of"), F.coalesce("__before", F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(F.shiftrightunsigned("__key", 11), "__key", "__row"))
    placed = dealt.withColumn("__place", place).join(before, (F.col("shard") == F.col("__shard")) & (F.col("__bucket") == F.col("__of")))
    return placed.withColumn("slot", (F.col("__before") + F.col("__place") - 1).cast("long")).drop("__shard", "__of", "__before", "__place", "__key", "__bucket", "__row")


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle(narrow, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
