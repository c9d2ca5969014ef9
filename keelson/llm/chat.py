"""Conversations from the perspective of each of their participants, in DataFrame expressions only.

Every participant of a conversation in turn is the assistant; the others become users with a name, the system stays itself. Each
rendering is of the whole conversation, for whoever speaks anywhere in it. The mask is the spans of characters that the
assistant says, with the mark that ends them.

A conversation may hold a large part of all rows. Its turns are numbered in range-partitioned pieces, and a row of the result
holds TURNS consecutive turns at most: a conversation of more has several rows for each participant, whose renderings in order of
`part` are the whole one when joined. No turn is left out. The result has as many characters as the method asks for, which is the
conversation's times its participants.

Defined results: a null role speaks as unknown, a null text is empty; turns are ordered by number, role and text, null
numbers first; repeated rows are turns like any other; rows without conversation id are one conversation; a conversation in
which only the system speaks gives no row; the marks of turns in a text or name get a backslash, and line breaks in a name
become spaces, so that neither can pass for a turn; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns in a row of the result, at most.
TURNS = 4096
SYSTEM, UNKNOWN = "system", "unknown"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Leading characters of a text by which turns that are otherwise equal go to pieces.
LEADING = 32


def _harmless(text: Column) -> Column:
    for mark in (BEGIN, END.strip()):
        text = F.replace(text, F.lit(mark), F.lit("<\\" + mark[1:]))
    return text


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, n (how often the row is there) and at (the place of the first of them in its conversation)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    # a leading part of the text keeps its order, and bounds the keys that are sampled for the ranges
    ranged = merged.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, LEADING))
    pieces = materialise(ranged.withColumn("__piece", F.spark_partition_id()))
    # pieces are in order, and so are the rows of a conversation in each: two levels of running counts
    before = Window.partitionBy("conv_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("conv_id", "__piece").agg(F.sum("n").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(F.col("conv_id").alias("__conv"), F.col("__piece").alias("__of"), "__before")
    within = Window.partitionBy("conv_id", "__piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("__within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    both = placed.join(counts, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__piece") == F.col("__of")))
    return both.select("conv_id", "role", "text", "n", (F.col("__before") + F.col("__within")).alias("at"))


def rotated(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, part, speaker, n_turns, rendered, mask (array of start and end, in characters of rendered)."""
    rows = numbered(conversations)
    div = lambda c: F.floor(c / F.lit(turns)).cast("long")
    last = F.col("at") + F.col("n") - 1
    # copies of a row are told apart part by part, so that no array is longer than a part
    spread = rows.withColumn("part", F.explode(F.sequence(div(F.col("at")), div(last))))
    first_here, last_here = F.greatest(F.col("at"), F.col("part") * turns), F.least(last, F.col("part") * turns + turns - 1)
    each = spread.withColumn("at", F.explode(F.sequence(first_here, last_here)))
    parts = each.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    speakers = conversations.select(F.col("conv_id").alias("__conv"), F.coalesce("role", F.lit(UNKNOWN)).alias("speaker")).where(F.col("speaker") != SYSTEM).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    name = lambda t: F.concat(F.lit("user name="), _harmless(F.regexp_replace(t.role, "[\r\n]", " ")))
    head = lambda t: F.concat(F.lit(BEGIN), F.when(t.role == F.col("speaker"), F.lit("assistant")).when(t.role == SYSTEM, F.lit(SYSTEM)).otherwise(name(t)), F.lit("\n"))
    said = seen.withColumn("said", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_harmless(t.text), F.lit(END)).alias("body"), (t.role == F.col("speaker")).alias("own"))))
    # running lengths, then the spans of those that are the speaker's own
    lengths = F.transform("said", lambda x: F.length(x.head) + F.length(x.body))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    said = said.withColumn("ends", ends)
    spans = F.zip_with("said", "ends", lambda x, e: F.when(x.own, F.struct((e - F.length(x.body)).alias("start"), e.alias("end"))))
    return said.select("conv_id", "part", "speaker", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("said", lambda x: F.concat(x.head, x.body)), "").alias("rendered"), F.array_compact(spans).alias("mask"))


def digest(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m.start.cast("string"), m.end.cast("string"))), ",")
    return rotated(conversations, turns).select(
        "conv_id",
        "part",
        "speaker",
        "n_turns",
        F.length("rendered").cast("long").alias("n_chars"),
        F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"),
        spans.alias("mask"),
    )


_SAFE = "replace(replace({0}, '<|im_start|>', '<\\|im_start|>'), '<|im_end|>', '<\\|im_end|>')"
SQL = f"""
WITH u AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM u
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'
), r AS (
  SELECT s.conv_id, CAST(t.k // {TURNS} AS BIGINT) AS part, s.speaker, t.k, t.role = s.speaker AS own,
         '{BEGIN}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || {_SAFE.format("regexp_replace(t.role, '[\r\n]', ' ', 'g')")} END || chr(10) AS head,
         {_SAFE.format("t.text")} || '{END.strip()}' || chr(10) AS body
  FROM s JOIN t ON s.conv_id IS NOT DISTINCT FROM t.conv_id
), p AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r
)
SELECT conv_id, part, speaker, count(*) AS n_turns, CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars,
       sha256(string_agg(head || body, '' ORDER BY k)) AS rendered_sha256,
       coalesce(string_agg(CASE WHEN own THEN CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(body) AS BIGINT) END, ',' ORDER BY k), '') AS mask
FROM p GROUP BY conv_id, part, speaker
"""
