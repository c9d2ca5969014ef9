"""Findings that other scanners have reported, in our form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify

COMMIT = "commit_sha string, commit_author string, commit_date string"
# Severities that tools use, in ours.
LEVELS = {"critical": "critical", "high": "high", "medium": "medium", "moderate": "medium", "low": "low", "info": "info", "informational": "info", "unknown": "medium"}

GITLEAKS = "RuleID string, Description string, StartLine int, StartColumn int, Match string, Secret string, File string, Commit string, Entropy double, Author string, Email string, Date string"
TRUFFLEHOG = "SourceMetadata struct<Data:struct<Filesystem:struct<file:string,line:int>,Git:struct<commit:string,file:string,email:string,timestamp:string,line:int>>>, DetectorName string, Verified boolean, Raw string"
KINGFISHER = "rule struct<id:string,name:string>, finding struct<path:string,line:int,column_start:int,snippet:string,secret:string,`match`:string,value:string,confidence:string,entropy:string,validation:struct<status:string>>"
TRIVY = "Results array<struct<Target:string,Secrets:array<struct<RuleID:string,Category:string,Severity:string,Title:string,StartLine:int,EndLine:int,`Match`:string>>>>"
TALISMAN = "results array<struct<filename:string,failure_list:array<struct<type:string,message:string,severity:string,commits:array<string>>>>>"


def level(text: Column, default: str = "medium") -> Column:
    known = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(text)), F.lit(default))


def _finding(df: DataFrame, tool: str, path, rule, description, severity, line, column, secret, sha=None, author=None, date=None, entropy=None, verified=None) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    has = F.coalesce(secret, F.lit("")) != ""
    return df.select(
        path.alias("path"),
        F.concat(F.lit(f"{tool}-"), rule).alias("rule_id"),
        F.coalesce(description, rule).alias("rule_description"),
        severity.alias("severity"),
        line.cast("int").alias("line_number"),
        (null("int") if column is None else column.cast("int")).alias("column_number"),
        F.when(has, classify.redact(secret)).alias("secret_preview"),
        F.when(has, classify.secret_hash(secret)).alias("secret_hash"),
        (null("double") if entropy is None else entropy.cast("double")).alias("entropy"),
        F.lit(tool).alias("scanner"),
        (F.lit(False) if verified is None else F.coalesce(verified, F.lit(False))).alias("verified"),
        (null("string") if sha is None else sha).alias("commit_sha"),
        (null("string") if author is None else author).alias("commit_author"),
        (null("string") if date is None else date).alias("commit_date"),
    )


def gitleaks(spark: SparkSession, path: str, tool: str = "gitleaks") -> DataFrame:
    df = spark.read.schema(GITLEAKS).option("multiLine", True).json(path)
    secret = F.coalesce("Secret", "Match", F.lit(""))
    author = F.col("Author") if tool == "gitleaks" else F.coalesce(F.when(F.col("Author") != "", F.col("Author")), "Email")
    return _finding(df, tool, F.col("File"), F.coalesce("RuleID", F.lit("unknown")), F.when(F.col("Description") != "", F.col("Description")), F.lit("high"), F.col("StartLine"), F.col("StartColumn"), secret, F.col("Commit"), author, F.col("Date"), F.col("Entropy"))


def infisical(spark: SparkSession, path: str) -> DataFrame:
    return gitleaks(spark, path, "infisical")


def trufflehog(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(TRUFFLEHOG).json(path)
    fs, git = F.col("SourceMetadata.Data.Filesystem"), F.col("SourceMetadata.Data.Git")
    rule = F.lower(F.replace(F.coalesce("DetectorName", F.lit("unknown")), F.lit(" "), F.lit("-")))
    severity = F.when(F.coalesce("Verified", F.lit(False)), "critical").otherwise("high")
    return _finding(df, "trufflehog", F.coalesce(fs["file"], git["file"]), rule, F.col("DetectorName"), severity, F.coalesce(fs["line"], git["line"]), None, F.col("Raw"), git["commit"], git["email"], git["timestamp"], None, F.col("Verified"))


def kingfisher(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(KINGFISHER).json(path)
    f, rule = F.col("finding"), F.col("rule")
    secret = F.coalesce(*(F.when(f[c] != "", f[c]) for c in ("secret", "match", "value", "snippet")))
    confirmed = F.lower(f["validation"]["status"]).isin("active", "active credential", "valid", "verified")
    severity = F.when(F.coalesce(confirmed, F.lit(False)), "critical").otherwise("high")
    return _finding(df, "kingfisher", f["path"], F.coalesce(rule["id"], F.lit("unknown")), rule["name"], severity, f["line"], f["column_start"], secret, entropy=f["entropy"].try_cast("double"), verified=confirmed)


def trivy(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """The tool masks its matches; with lines (path, line_number, line) the secret is what the mask hides, where that is plain."""
    df = spark.read.schema(TRIVY).option("multiLine", True).json(path).select(F.inline("Results")).select("Target", F.inline("Secrets"))
    df = df.withColumnsRenamed({"Target": "path", "StartLine": "line_number", "Match": "masked"})
    secret = F.lit(None).cast("string")
    if lines is not None:
        df = df.join(lines.select("path", "line_number", "line"), ["path", "line_number"], "left")
        masked = F.trim("masked")
        before, after = F.regexp_extract(masked, r"^(.*?)\*{3,}", 1), F.regexp_extract(masked, r"\*{3,}([^*]*)$", 1)
        whole = F.trim("line")
        fits = whole.startswith(before) & whole.endswith(after) & (F.length(whole) > F.length(before) + F.length(after))
        secret = F.when(fits, F.substring(whole, F.length(before) + 1, F.length(whole) - F.length(before) - F.length(after)))
    found = _finding(df, "trivy", F.col("path"), F.coalesce("RuleID", F.lit("unknown")), F.col("Title"), level(F.col("Severity")), F.col("line_number"), None, secret)
    place = F.concat_ws(":", "path", F.col("line_number").cast("string"), "rule_id")
    return found.withColumn("secret_hash", F.coalesce("secret_hash", classify.secret_hash(place)))


def said_secret(message: Column) -> Column:
    """The secret that a message quotes after its marker, without quotes and ellipsis."""
    found = F.regexp_extract(message, r"""(?i)(?:secret pattern|content|file)\s*:\s*["']?(.+?)["']?\s*$""", 1)
    return F.when(found != "", F.regexp_replace(found, r"([.]{3}|…)$", ""))


def talisman(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(TALISMAN).option("multiLine", True).json(path).select(F.inline("results")).select("filename", F.inline("failure_list"))
    return _finding(df, "talisman", F.col("filename"), F.coalesce("type", F.lit("unknown")), F.col("message"), level(F.col("severity")), F.lit(None), None, said_secret(F.col("message")), F.get("commits", F.lit(0)))


READERS = {"gitleaks": gitleaks, "infisical": infisical, "trufflehog": trufflehog, "kingfisher": kingfisher, "trivy": trivy, "talisman": talisman}


def union(findings: dict[str, DataFrame]) -> DataFrame:
    """Findings of several scanners, in order of the scanners' names."""
    first, *rest = [findings[n] for n in sorted(findings)]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
