"""Comparing inventories: local keys with vaults, recipients with requests, running projects with enabled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

def profile_filter(mappings: DataFrame, profile: str | None = None) -> DataFrame:
    """Mappings without a profile, and those of the named one."""
    return mappings.where(F.col("profile").isNull() | (F.col("profile") == F.lit(profile)) if profile is not None else F.col("profile").isNull())


def sync(mappings: DataFrame, vault: DataFrame, local: DataFrame, verify: bool = False, force: bool = False) -> DataFrame:
    """What a sync would do with each mapping (secret_name, folder, environment, profile, status, ephemeral): created, updated,
    skipped, ephemeral or error. status is that of sources.files.env_files. vault: (secret_name, value); local: (folder,
    key_name, value). In verify mode nothing is created or updated, and what would be is an error."""
    environment = keys.effective_environment(F.col("environment"), F.col("profile"))
    rows = mappings.withColumn("environment", environment).withColumn("key_name", keys.key_name(environment))
    secrets = vault.select("secret_name", F.col("value").alias("__raw"))
    rows = rows.join(secrets, "secret_name", "left").withColumn("__k", keys.normalize("__raw", "environment"))
    rows = rows.join(local.select("folder", "key_name", F.col("value").alias("__local")), ["folder", "key_name"], "left")
    raw, mine = F.col("__raw"), F.col("__local")
    value, suffix, error = F.col("__k.value"), F.col("__k.suffix"), F.col("__k.error")
    unusable = F.when(raw.isNull(), "Secret not found in vault").when(error.isNotNull(), error).when(suffix.isNotNull() & (F.upper(suffix) != F.upper("environment")), "Key is for another environment").otherwise(keys.shape_error(value))
    wait = F.when(F.col("status") == "multiple_found", "Several files match").when(F.col("status") == "not_found", "No file yet")
    outcome = lambda action, message: F.struct(F.lit(action).alias("action"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    decided = F.when(F.col("status") == "folder_not_found", outcome("error", "Folder not found"))
    if verify:
        decided = decided.when(wait.isNotNull() & unusable.isNotNull(), outcome("error", unusable))
    decided = (
        decided.when(wait.isNotNull(), outcome("skipped", wait))
        .when(unusable.isNotNull(), outcome("error", unusable))
        .when(F.coalesce("ephemeral", F.lit(False)), outcome("ephemeral", "Key isn't stored"))
        .when(mine.isNull(), outcome("error", "Key is missing") if verify else outcome("created", "Key would be created"))
        .when(mine == value, outcome("skipped", "Values match"))
        .otherwise(outcome("error", "Values differ") if verify else outcome("updated", "Key would be updated") if force else outcome("skipped", "Update not confirmed"))
    )
    return rows.withColumn("__o", decided).select("secret_name", "folder", "environment", "key_name", F.col("__o.action").alias("action"), F.col("__o.message").alias("message"))


def counts(results: DataFrame) -> DataFrame:
    """One row: how many mappings had each action, and whether there was an error."""
    by = [F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "skipped", "ephemeral", "error")]
    return results.agg(*by, F.count(F.lit(1)).alias("total")).withColumn("has_errors", F.col("error") > 0)


def verify_lock(mappings: DataFrame, vault: DataFrame, local: DataFrame) -> DataFrame:
    """(secret_name, folder, key_name, verdict): match, mismatch, unavailable (no secret or no local key) or unusable."""
    environment = keys.effective_environment(F.col("environment"), F.col("profile"))
    rows = mappings.withColumn("environment", environment).withColumn("key_name", keys.key_name(environment))
    rows = rows.join(vault.select("secret_name", F.col("value").alias("__raw")), "secret_name", "left").withColumn("__k", keys.normalize("__raw", "environment"))
    rows = rows.join(local.select("folder", "key_name", F.col("value").alias("__local")), ["folder", "key_name"], "left")
    other = F.col("__k.suffix").isNotNull() & (F.upper("__k.suffix") != F.upper("environment"))
    verdict = (
        F.when(F.col("__raw").isNull() | F.col("__local").isNull(), "unavailable")
        .when(F.col("__k.error").isNotNull() | keys.shape_error(F.col("__k.value")).isNotNull(), "unusable")
        .when(other | (F.col("__k.value") != F.col("__local")), "mismatch")
        .otherwise("match")
    )
    return rows.select("secret_name", "folder", "key_name", verdict.alias("verdict"))


def stale_key(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """For folders (folder, key_name) whose key file (folder, line_number, name) lacks the key: the first other private key in it."""
    other = lines.where(F.col("name").startswith(keys.NAME))
    gone = wanted.join(other.select("folder", F.col("name").alias("key_name")), ["folder", "key_name"], "left_anti")
    return gone.join(other.groupBy("folder").agg(F.min_by("name", "line_number").alias("stale_name")), "folder")


def missing_recipients(requested: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, kind, recipient) that were asked for but are not in the metadata (path, key, value) of an encrypted file. The keys are
    flat, sops_<kind>__list_<n>__map_<field>; of an Azure key host, name and version must be one record's."""
    flat = metadata.select("path", F.regexp_extract("key", r"^sops_([a-z_]+?)__list_(\d+)__map_(\w+)$", 1).alias("kind"), F.regexp_extract("key", r"__list_(\d+)__map_", 1).alias("n"), F.regexp_extract("key", r"__map_(\w+)$", 1).alias("field"), F.col("value").alias("v")).where("kind <> ''")
    first = lambda *names: F.coalesce(*(F.max(F.when(F.col("field") == x, F.col("v"))) for x in names))
    record = flat.groupBy("path", "kind", "n").agg(first("recipient", "fp", "arn", "resource_id").alias("plain"), first("vault_url", "vaultUrl").alias("host"), first("name", "key").alias("name"), first("version").alias("version"))
    azure = F.concat(F.regexp_replace("host", "/+$", ""), F.lit("/keys/"), "name", F.lit("/"), "version")
    have = record.select("path", "kind", F.when(F.col("kind") == "azure_kv", azure).otherwise(F.col("plain")).alias("recipient"))
    return requested.join(have, ["path", "kind", "recipient"], "left_anti").select("path", "kind", "recipient")


def registry(enabled: DataFrame, running: DataFrame) -> DataFrame:
    """(project, action): start what is enabled and not running, stop what runs and isn't enabled, keep what is both or whose
    configuration failed to load (enabled: project, failed)."""
    both = enabled.select("project", F.coalesce("failed", F.lit(False)).alias("failed"), F.lit(True).alias("on")).join(running.select("project", F.lit(True).alias("runs")), "project", "full_outer")
    on, runs = F.coalesce("on", F.lit(False)), F.coalesce("runs", F.lit(False))
    action = F.when(on & runs, "keep").when(on & F.col("failed"), "wait").when(on, "start").otherwise("stop")
    return both.select("project", action.alias("action"))


def not_ignored(paths: DataFrame, ignored: DataFrame) -> DataFrame:
    return paths.join(ignored.select("path"), "path", "left_anti")


def schema_for(files: DataFrame, schemas: dict[str, str], default: str | None) -> DataFrame:
    """Adds the schema of the file's environment, else the default one."""
    known = F.create_map(*(F.lit(x) for pair in schemas.items() for x in pair)) if schemas else F.create_map().cast("map<string,string>")
    return files.withColumn("schema", F.coalesce(F.element_at(known, F.col("environment")), F.lit(default)))


def _shape(pattern: Column) -> Column:
    """Shell patterns as anchored expressions: * and ? stay within a part of a path, [abc], [!abc] and [^abc] are one character."""
    plain = F.regexp_replace(pattern, r"([.+(){}|$\\])", r"\\$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<!\[)\^", r"\\^"), r"\[!", "[^")
    shape = F.concat(F.lit("^"), F.replace(F.replace(plain, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    return F.when(pattern.rlike(r"\[[^\]]*$"), F.lit("(?!)")).otherwise(shape)  # without its end a class matches nothing


def more_patterns(patterns: DataFrame, mapped: DataFrame) -> DataFrame:
    """(project, pattern): the watch patterns of each project and the mapped file names that none of them covers."""
    shape = _shape(F.col("pattern"))
    names = mapped.select("project", F.col("name"))
    known = patterns.groupBy("project").agg(F.collect_set(shape).alias("shapes"))
    bare = names.join(known, "project", "left").where(~F.exists(F.coalesce("shapes", F.array().cast("array<string>")), lambda s: F.regexp_like("name", s)))
    return patterns.select("project", "pattern").unionByName(bare.select("project", F.col("name").alias("pattern"))).distinct()
