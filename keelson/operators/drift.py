"""What differs between two environments, or two snapshots: a full outer join on name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.classify import strip

MASK = "********"
# Texts that are compared as truth values, and those that are true.
BOOLEANS, TRUTHY = ("true", "false", "yes", "no", "on", "off", "1", "0"), ("true", "yes", "on", "1")


def equal_values(a: Column, b: Column, kind: Column | None = None, normalize: bool = True, collections: bool = False) -> Column:
    """Whether two values mean the same. Strict: the same text. Else in this order: equal as values of the type (one
    that is a value beside one that isn't differ for good); equal but for white space; equal as truth values; with
    collections, equal as JSON or literal collections."""
    if not normalize:
        return a.eqNullSafe(b)
    x, y = strip(a), strip(b)
    truth = F.lower(x).isin(*BOOLEANS) & F.lower(y).isin(*BOOLEANS)
    same = F.lit(False)
    if collections:
        opened = x.rlike(r"^[\[{]") & y.rlike(r"^[\[{]") & (x != y)
        same = F.coalesce(coerce.same_collection(F.when(opened, x), F.when(opened, y)), F.lit(False))
    untyped = F.when(x == y, True)
    if kind is None:
        return F.when(a.isNull() | b.isNull(), a.eqNullSafe(b)).otherwise(untyped.when(truth, F.lower(x).isin(*TRUTHY) == F.lower(y).isin(*TRUTHY)).otherwise(same))
    left, right = coerce.accepted(a, kind), coerce.accepted(b, kind)
    both_fail = F.coalesce(~left & ~right, F.lit(False))
    one_fails = F.coalesce(left != right, F.lit(False))
    return (
        F.when(a.isNull() | b.isNull(), a.eqNullSafe(b))
        .when(left & right & (coerce.canonical(a, kind) == coerce.canonical(b, kind)), True)
        .when(one_fails, False)
        .when(x == y, True)
        .when(truth & ~both_fail, F.lower(x).isin(*TRUTHY) == F.lower(y).isin(*TRUTHY))
        .otherwise(same)
    )


def drift(left: DataFrame, right: DataFrame, fields: DataFrame | None = None, keys: tuple[str, ...] = (), mask: bool = True, include_unchanged: bool = False, normalize: bool = True, collections: bool = False) -> DataFrame:
    """(keys, name, diff_type, value1, value2, is_sensitive, line_number1, line_number2).

    left and right: (keys, name, value) and maybe line_number, one row for each name. keys tell several pairs of files
    apart. fields: (field, type, sensitive) of a contract; it is broadcast only where Spark finds it small."""
    by = [*keys, "name"]

    def side(df: DataFrame, n: int) -> DataFrame:
        line = F.col("line_number") if "line_number" in df.columns else F.lit(None).cast("int")
        return df.select(*by, F.col("value").alias(f"value{n}"), line.alias(f"line_number{n}"), F.lit(True).alias(f"in{n}"))

    both = side(left, 1).join(side(right, 2), by, "full_outer")
    kind, sensitive = None, F.lit(False)
    if fields is not None:
        both = both.join(fields.select(F.col("field").alias("name"), F.col("type").alias("__kind"), F.col("sensitive").alias("__sensitive")), "name", "left")
        kind, sensitive = F.col("__kind"), F.coalesce("__sensitive", F.lit(False))
    same = equal_values(F.col("value1"), F.col("value2"), kind, normalize, collections)
    found = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    shown = lambda c: F.when(sensitive & F.lit(mask), F.when(F.col(c) != "", MASK)).otherwise(F.col(c))
    out = both.select(*by, found.alias("diff_type"), shown("value1").alias("value1"), shown("value2").alias("value2"), sensitive.alias("is_sensitive"), "line_number1", "line_number2")
    return out if include_unchanged else out.where("diff_type <> 'unchanged'")


def summary(differences: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by kind, and whether there is any drift; without keys one row also where nothing differs."""
    count = lambda kind: F.count_if(F.col("diff_type") == kind).alias(kind)
    grouped = differences.groupBy(*keys).agg(count("added"), count("removed"), count("changed"))
    return grouped.withColumn("has_drift", F.col("added") + F.col("removed") + F.col("changed") > 0)


def report(differences: DataFrame, env1: str, env2: str) -> DataFrame:
    """One row of JSON: both names, the counts, and the differences in order of name. For a pair of environments, whose names are few."""
    rows = F.sort_array(F.collect_list(F.struct("name", F.col("diff_type").alias("type"), F.col("value1").alias("value_env1"), F.col("value2").alias("value_env2"), F.col("is_sensitive").alias("sensitive"))))
    counts = F.struct(*(F.count_if(F.col("diff_type") == k).alias(k) for k in ("added", "removed", "changed")), (F.count_if(F.col("diff_type") != "unchanged") > 0).alias("has_drift"))
    return differences.agg(F.to_json(F.struct(F.lit(env1).alias("env1"), F.lit(env2).alias("env2"), counts.alias("summary"), rows.alias("differences")), {"ignoreNullFields": "false"}).alias("report"))
