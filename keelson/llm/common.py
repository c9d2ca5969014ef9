"""What the operators share: places for written tables, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a file of those that are known to be few.
FILE_ROWS = 50_000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named there is one of our own in local mode, as in tests; on a
    cluster that is an error, as no folder of one machine will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return named.rstrip("/")


def clean(spark: SparkSession) -> int:
    """Deletes the tables that materialise has written in this session, and says how many. What has been computed from them and not yet
    stored is lost, so this is for the end of a job."""
    for path in _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(_written)
    _written.clear()
    return n


def _files(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.coalesce(8 + rows // FILE_ROWS)


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df from a reliable checkpoint in the shared folder. Where there are known to be so many at most, it has a file for each
    FILE_ROWS of them, however many partitions there are: each file costs its writer a process for its permissions."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return _files(df, rows).checkpoint()


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df from a table in the shared folder, so that two uses of them see the same rows and neither depends on an executor. rows
    is as in checkpoint()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _files(df, rows).write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(left: DataFrame, right: DataFrame, key: str, n: int, stored: bool = False, most: int = 1024, salts: int = 64) -> DataFrame:
    """left, of n rows or so, with the columns that right has for each key, null where it has none; right has a row for a key at most.

    Keys of more than one in `most` rows of left, of which there are at most that many, are spread over tasks: the rows of left by a hash
    of all they hold, those of right to all. Rows of left may be equal in great number where it is stored, as a table or checkpoint;
    then they go by a running number, which is the same if a lost task runs again."""
    heavy = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(64, n // most)).select(F.col(key).alias("__key"))
    heavy = F.broadcast(heavy)  # at most `most` keys, or n / 64
    is_heavy = F.col("__key").isNotNull()
    spread = F.monotonically_increasing_id() if stored else F.xxhash64(*left.columns)
    numbered = left.withColumn("__salt", F.pmod(spread, F.lit(salts)))
    salted = numbered.join(heavy, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.when(is_heavy, F.col("__salt")).otherwise(0)).drop("__key")
    copies = F.when(is_heavy, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copied = right.join(heavy, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(copies)).drop("__key")
    return salted.join(copied, [key, "__salt"], "left").drop("__salt")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
