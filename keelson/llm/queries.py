"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cover, leaks, licenses, pieces, quality, sharding, simhash, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.digest(table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of op1_byte_bpe decode to."""
    return op1_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_sharding's law says of each shard: its rows and its slots."""
    counts = (F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))
    return op2_sharding(spark, sf_dir).groupBy("shard").agg(*counts)


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_license_scan that phrases alone decide."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AT = lambda phrase: f"list_filter(range(1, len(w) + 1), lambda i: w[i : i + {len(phrase) - 1}] = {phrase})"
_BASE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {_AT(["mit", "license"])} AS mit, {_AT(["apache", "license"])} AS apache, {_AT(["general", "public", "license"])} AS gpl FROM d),
b AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS every FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM b
"""
_LAW = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS shard), c AS (SELECT shard, n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END AS n FROM s, n)
SELECT shard, n, CAST(0 AS BIGINT) AS first_slot, n - 1 AS last_slot, n AS n_slots FROM c WHERE n > 0
"""

#: By name: opN_<name>, and parts of three of them that SQL can state.
QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_sharding, op3_suffix_array, op4_token_counts, op5_quality_rules, op6_license_scan, op7_decontamination, op8_difference_cover, op9_chat_rotation, op10_simhash, bpe_round_trip, sharding_law, license_base)}
SQL = {"bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents", "sharding_law": _LAW, "license_base": _BASE, "op3_suffix_array": suffix.SQL, "op5_quality_rules": quality.SQL, "op8_difference_cover": cover.SQL, "op9_chat_rotation": chat.SQL}
