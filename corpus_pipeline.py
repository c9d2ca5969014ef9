"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

1. quality rules: documents that the rules reject go;
2. near-duplicates by SimHash: of each group the document with the smallest id stays;
3. repeated strings of 100 bytes: every occurrence but the first is cut out; a document of which nothing is left goes;
4. benchmark leaks: documents that hold an item of the benchmark, also edited, go;
5. byte-level BPE: the ids of each text, and whether they decode to it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, leaks, quality, simhash, suffix
from keelson.llm.common import materialise

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.features(docs, out="__quality"), out="__quality")
    return judged.where("__quality.kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.cleaned(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {n: f"__own_{n}" for n, _ in leaks.NEW if n in docs.columns}  # the operator would replace these
    found = leaks.decontaminate(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not leaked").drop(*(n for n, _ in leaks.NEW)).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    both = bpe.encode(docs, path, pattern, decoded="decoded")
    return both.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]
#: The estimate of the quality rules, the alignment and the encoding have no SQL form; the tests use plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
