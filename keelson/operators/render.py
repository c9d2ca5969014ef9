"""Results as documents: JSON, SARIF 2.1.0, combined files, key files, and contract modules."""

from __future__ import annotations

import unicodedata
from keyword import iskeyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, rules
from . import findings as fnd

# The level and the security score of each severity in SARIF.
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SCORE = {"critical": "9.0", "high": "7.0", "medium": "5.0", "low": "3.0", "info": "1.0"}


def _map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def scan_json(findings: DataFrame, runs: DataFrame, fail_on: str | None = None) -> DataFrame:
    """One row of JSON for one run: findings in their order, counts by severity with zeros, scanners and the exit code. A report is for
    people and holds all findings of the run; for large corpora write the findings table itself."""
    rank = classify.severity_rank(F.col("severity"))
    row = F.struct((-rank).alias("__r"), F.struct(*findings.columns).alias("f"))
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda x: x.f)
    counts = F.struct(*(F.count_if(F.col("severity") == s).alias(s) for s in reversed(rules.SEVERITIES)))
    scanners = runs.agg(F.sort_array(F.collect_list(F.struct("scanner", "files_scanned", "error")))).scalar()
    code = fnd.exit_code(findings, runs, fail_on).select("exit_code").scalar()
    return findings.agg(rows.alias("findings"), counts.alias("summary")).select(F.to_json(F.struct("findings", "summary", scanners.alias("scanners"), code.alias("exit_code"))).alias("report"))


def uri(path: Column, root: str = "") -> Column:
    """Relative to the root where it can be, percent-encoded but for the slashes."""
    relative = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path) if root else path
    encoded = F.replace(F.replace(F.url_encode(relative), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sarif_results(findings: DataFrame, root: str = "") -> DataFrame:
    """A row for each result: rule, level, place and fingerprint."""
    place = uri(F.col("path"), root)
    print_ = F.concat_ws(":", place, F.coalesce(F.col("line_number").cast("string"), F.lit("0")), F.coalesce(F.col("column_number").cast("string"), F.lit("0")), "rule_id", F.substring(F.coalesce("secret_hash", F.lit("")), 1, 16))
    return findings.select("rule_id", "rule_description", "severity", _map(LEVEL, F.col("severity")).alias("level"), place.alias("uri"), "line_number", "column_number", print_.alias("fingerprint"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A row for each rule, described by its most severe finding."""
    best = findings.groupBy("rule_id").agg(F.max_by(F.struct("rule_description", "severity"), F.struct(classify.severity_rank(F.col("severity")), "path", F.coalesce("line_number", F.lit(0)))).alias("b"))
    return best.select("rule_id", F.col("b.rule_description").alias("description"), _map(LEVEL, F.col("b.severity")).alias("level"), _map(SCORE, F.col("b.severity")).alias("security_severity"))


def sarif(findings: DataFrame, root: str = "", tool: str = "keelson") -> DataFrame:
    """One SARIF 2.1.0 document for one run."""
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration"), F.struct(F.col("security_severity").alias("security-severity")).alias("properties"))
    listed = sarif_rules(findings).agg(F.sort_array(F.collect_list(rule))).scalar()
    region = F.when(F.col("line_number").isNotNull(), F.struct(F.col("line_number").alias("startLine"), F.col("column_number").alias("startColumn")))
    where = F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("level"), F.struct(F.col("rule_description").alias("text")).alias("message"), where.alias("locations"), F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"))
    results = sarif_results(findings, root).agg(F.sort_array(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"), F.col("results").alias("results"))
    version = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return results.withColumn("rules", listed).select(F.to_json(version).alias("sarif"))


def combined(parts: DataFrame, header: str = "") -> DataFrame:
    """(path, text, clear_lines, secret_lines): for (path, section, line_number, line) the header, the clear lines, then the encrypted ones."""
    rank = F.when(F.col("section") == "clear", 0).otherwise(1)
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "line_number", "line")))
    grouped = parts.groupBy("path").agg(rows.alias("rows"), F.count_if(rank == 0).alias("clear_lines"), F.count_if(rank == 1).alias("secret_lines"))
    text = F.concat(F.lit(header), F.array_join(F.transform("rows", lambda x: F.concat(F.coalesce(x.line, F.lit("")), F.lit("\n"))), ""))
    return grouped.select("path", text.alias("text"), "clear_lines", "secret_lines")


def in_sync(built: DataFrame, files: DataFrame) -> DataFrame:
    """(path, in_sync): whether the file there is what the parts give."""
    both = built.join(files.select("path", F.col("content").alias("__there")), "path", "left")
    return both.select("path", F.coalesce(F.sha2("text", 256) == F.sha2("__there", 256), F.lit(False)).alias("in_sync"))


def merged(parts: DataFrame) -> DataFrame:
    """combined() of clear lines and decrypted ones, without banners and public keys."""
    banner = F.col("line").rlike(r"^\s*#\s*/-+|^\s*#/-+") | classify.public_key_name(F.trim(F.substring_index("line", "=", 1)))
    return combined(parts.where((F.col("section") == "clear") | ~banner))


def upsert_key(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, line_number, line): with the lines of each key (path, key, value, environment) replaced, or a comment and the line added at the end."""
    name = F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    new = F.concat("key", F.lit("="), "value")
    met = lines.withColumn("key", F.when(name != "", name)).join(keys, ["path", "key"], "left")
    kept = met.select("path", "line_number", F.when(F.col("value").isNotNull(), new).otherwise(F.col("line")).alias("line"))
    there = lines.select("path", name.alias("key")).distinct()
    last = lines.groupBy("path").agg(F.max("line_number").alias("last"))
    added = keys.join(there, ["path", "key"], "left_anti").join(last, "path", "left").withColumn("at", F.coalesce("last", F.lit(0)))
    extra = F.array(F.struct((F.col("at") + 1).alias("line_number"), F.concat(F.lit("# "), "environment").alias("line")), F.struct((F.col("at") + 2).alias("line_number"), new.alias("line")))
    return kept.unionByName(added.select("path", F.inline(extra)))


def identifiers(names: list[str]) -> dict[str, str]:
    """A Python identifier for each name, in order, different also after NFKC."""
    out, taken = {}, set()
    for name in sorted(names):
        plain = "".join(c if c.isidentifier() or c.isdigit() else "_" for c in name.lower()) or "field"
        plain = plain if plain.isidentifier() and not plain.startswith("_") else "field_" + plain.lstrip("_")
        plain = plain + "_" if iskeyword(plain) else plain
        base, n = plain, 2
        while unicodedata.normalize("NFKC", plain) in taken:
            plain, n = f"{base}_{n}", n + 1
        taken.add(unicodedata.normalize("NFKC", plain))
        out[name] = plain
    return out


def contract_module(fields: list[dict], name: str = "Settings") -> str:
    """The source of a settings class for the rows of an inferred contract, names in order."""
    named = identifiers([f["field"] for f in fields])
    lines = ["from pydantic import Field", "from pydantic_settings import BaseSettings, SettingsConfigDict", "", "", f"class {name}(BaseSettings):", '    model_config = SettingsConfigDict(extra="forbid")', ""]
    for f in sorted(fields, key=lambda f: f["field"]):
        own = named[f["field"]]
        options = [repr(f["default"]) if f.get("default") is not None else None, f"validation_alias={f['field']!r}" if own != f["field"].lower() else None, 'json_schema_extra={"sensitive": True}' if f.get("sensitive") else None]
        given = ", ".join(o for o in options if o)
        lines.append(f"    {own}: {f['type']}" + (f" = Field({given})" if given else ""))
    return "\n".join(lines) + "\n"
