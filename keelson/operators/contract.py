"""Checks of variables against contracts, and contracts inferred from variables.

A contract is a table of fields: (field, type, required, sensitive, default, binding_names, description). Variables are
(keys, name, value, line_number), one row for each name; keys, such as a path, tell files apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, coerce

FIELDS = "field string, type string, required boolean, sensitive boolean, default string, binding_names array<string>, description string"


def folded(name: Column, case_sensitive: bool) -> Column:
    return name if case_sensitive else F.lower(name)


def bindings(fields: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """A row for each name that a field may be bound by, in order; without any it is the field's own."""
    names = F.when(F.size("binding_names") > 0, F.col("binding_names")).otherwise(F.array("field"))
    return fields.select("*", F.posexplode(names).alias("pos", "binding")).withColumn("lookup", folded(F.col("binding"), case_sensitive))


def indexed(variables: DataFrame, keys: tuple[str, ...], case_sensitive: bool = False) -> DataFrame:
    """Of names that fold to the same, the last one."""
    rest = F.struct("name", "value", "line_number")
    return variables.groupBy(*keys, folded(F.col("name"), case_sensitive).alias("lookup")).agg(F.max_by(rest, F.struct("line_number", "name")).alias("v")).select(*keys, "lookup", "v.*")


def collisions(variables: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Names that differ in case alone: the folded name, all spellings in order of their last line, and the one whose value counts. A
    name that is assigned again in the same spelling is no collision. Spellings are merged first, so a group has a row for each."""
    spelled = variables.groupBy(*keys, "name").agg(F.max("line_number").alias("line_number"))
    named = F.array_sort(F.collect_list(F.struct("line_number", "name")))
    grouped = spelled.groupBy(*keys, F.lower("name").alias("folded")).agg(named.alias("n")).where(F.size("n") > 1)
    return grouped.select(*keys, "folded", F.transform("n", lambda x: x["name"]).alias("names"), F.element_at("n", -1)["name"].alias("kept"))


def bind(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), case_sensitive: bool = False, ignore_empty: bool = False) -> DataFrame:
    """(keys, field, binding, name, value): of each field the first binding that is set."""
    found = indexed(variables, keys, case_sensitive)
    if ignore_empty:
        found = found.where("value <> ''")
    met = found.join(bindings(fields, case_sensitive).select("field", "pos", "binding", "lookup"), "lookup")
    first = met.groupBy(*keys, "field").agg(F.min_by(F.struct("binding", "name", "value"), "pos").alias("b"))
    return first.select(*keys, "field", "b.*")


def missing(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), case_sensitive: bool = False, ignore_empty: bool = False, files: DataFrame | None = None) -> DataFrame:
    """(keys, field, required): fields that no binding sets. files lists the files to check, if some may have no variables. The
    fields of the one contract are a scalar beside each file, not a join."""
    wanted = fields.agg(F.collect_list(F.struct("field", "required"))).scalar()
    bound = bind(variables, fields, keys, case_sensitive, ignore_empty).groupBy(*keys).agg(F.collect_set("field").alias("bound"))
    if keys:
        bound = (files.select(*keys) if files is not None else variables.select(*keys)).distinct().join(bound, [*keys], "left")
    rest = F.filter("wanted", lambda x: ~F.array_contains(F.coalesce("bound", F.array().cast("array<string>")), x.field))
    return bound.withColumn("wanted", wanted).select(*keys, F.inline(rest))


def extra(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), case_sensitive: bool = False) -> DataFrame:
    """(keys, name): variables that no field binds, but for public keys."""
    known = bindings(fields, case_sensitive).select("lookup").distinct()
    rows = variables.where(~classify.public_key_name(F.col("name"))).withColumn("lookup", folded(F.col("name"), case_sensitive))
    return rows.join(known, "lookup", "left_anti").select(*keys, "name")


def unencrypted(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), case_sensitive: bool = False) -> DataFrame:
    """(keys, name): plaintext of sensitive fields, by any of their bindings."""
    sensitive = bindings(fields.where("sensitive"), case_sensitive).select("lookup").distinct()
    rows = variables.where(classify.status(F.col("value")) == "plaintext").withColumn("lookup", folded(F.col("name"), case_sensitive))
    return rows.join(sensitive, "lookup", "left_semi").select(*keys, "name")


def unmarked(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), case_sensitive: bool = False) -> DataFrame:
    """(keys, name, reason): plaintext whose value or name looks like a secret though no sensitive field binds it."""
    sensitive = bindings(fields.where("sensitive"), case_sensitive).select("lookup").distinct()
    rows = variables.where((classify.status(F.col("value")) == "plaintext") & ~classify.public_key_name(F.col("name")))
    rows = rows.withColumn("lookup", folded(F.col("name"), case_sensitive)).join(sensitive, "lookup", "left_anti")
    reasons = F.array_compact(F.array(F.when(classify.suspicious_value(F.col("value")), "value"), F.when(classify.sensitive_name(F.col("name")), "name")))
    return rows.select(*keys, "name", F.explode(reasons).alias("reason"))


def mistyped(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), case_sensitive: bool = False, ignore_empty: bool = False) -> DataFrame:
    """(keys, field, value, message): bound values that are none of the field's type; ciphertext isn't checked."""
    bound = bind(variables, fields, keys, case_sensitive, ignore_empty).join(fields.select("field", "type"), "field")
    open_ = bound.where(~(F.col("value").startswith("encrypted:") | F.col("value").startswith("ENC[")))
    return open_.select(*keys, "field", "value", coerce.message(F.col("value"), F.col("type")).alias("message")).where("message is not null")


def constrained(bound: DataFrame, checks: dict[str, tuple[str, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, field, value, message) of bound values that fail a check of their field: an SQL condition on value, and what to say. No
    checks, no work."""
    out = None
    for field, (condition, said) in checks.items():
        bad = bound.where((F.col("field") == field) & ~F.coalesce(F.expr(condition), F.lit(False))).select(*keys, "field", "value", F.lit(said).alias("message"))
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else bound.select(*keys, "field", "value", F.lit("").alias("message")).limit(0)


def violations(variables: DataFrame, fields: DataFrame, keys: tuple[str, ...] = (), extra_policy: str = "forbid", check_encryption: bool = True, case_sensitive: bool = False, ignore_empty: bool = False, files: DataFrame | None = None) -> DataFrame:
    """(keys, kind, level, name, message) of all checks, in one pass: the names of each file meet the contract once, and all that concerns
    one name, then all that concerns one file, follows from that."""
    found = lambda kind, level, name, said: F.struct(kind.alias("kind"), level.alias("level"), name.alias("name"), said.alias("message"))
    text = lambda s, name: F.format_string(s, name)
    error, warning = F.lit("error"), F.lit("warning")
    met = bindings(fields, case_sensitive).groupBy("lookup").agg(F.collect_list(F.struct("field", "pos", "type")).alias("binds"), F.bool_or("sensitive").alias("sensitive"))
    # the spellings of one name, in order of their line
    one = variables.groupBy(*keys, folded(F.col("name"), case_sensitive).alias("lookup")).agg(F.array_sort(F.collect_list(F.struct("line_number", "name", "value"))).alias("all"))
    named = one.join(met, "lookup", "left").withColumn("sensitive", F.coalesce("sensitive", F.lit(False)))

    def of_name(x: Column) -> Column:
        plain, public, sensitive = classify.status(x.value) == "plaintext", classify.public_key_name(x["name"]), F.col("sensitive")
        checks = []
        if extra_policy != "ignore":
            checks.append(F.when(F.col("binds").isNull() & ~public, found(F.lit("extra"), error if extra_policy == "forbid" else warning, x["name"], text("Extra variable '%s' not in schema", x["name"]))))
        if check_encryption:
            said = text("'%s' looks like a secret but isn't marked sensitive", x["name"])
            doubt = ~sensitive & plain & ~public
            checks.append(F.when(sensitive & plain, found(F.lit("unencrypted"), warning, x["name"], text("'%s' is sensitive but not encrypted", x["name"]))))
            checks.append(F.when(doubt & classify.suspicious_value(x.value), found(F.lit("suspicious_value"), warning, x["name"], said)))
            checks.append(F.when(doubt & classify.sensitive_name(x["name"]), found(F.lit("suspicious_name"), warning, x["name"], said)))
        return F.array_compact(F.array(*checks))

    parts = [F.flatten(F.transform("all", of_name))] if extra_policy != "ignore" or check_encryption else []
    if not case_sensitive:
        several = F.size(F.array_distinct(F.transform("all", lambda x: x["name"]))) > 1
        parts.append(F.array_compact(F.array(F.when(several, found(F.lit("collision"), warning, F.col("lookup"), text("Case-insensitive name collision for '%s'", F.col("lookup")))))))
    # of each field the first binding that is set, and then all fields of a file
    last = F.element_at("all", -1).value
    bound = named.where(F.col("binds").isNotNull() & (last != "" if ignore_empty else F.lit(True))).select(*keys, last.alias("value"), F.inline("binds"))
    first = bound.groupBy(*keys, "field").agg(F.min_by(F.struct("value", "type"), "pos").alias("b"))
    open_ = ~(F.col("b.value").startswith("encrypted:") | F.col("b.value").startswith("ENC["))
    said = F.when(open_, coerce.message(F.col("b.value"), F.col("b.type")))
    whole = first.groupBy(*keys).agg(F.collect_list(F.struct("field", said.alias("said"))).alias("bound"))
    if keys:
        whole = (files if files is not None else variables).select(*keys).distinct().join(whole, [*keys], "left")
    wanted = fields.agg(F.collect_list(F.struct("field", "required"))).scalar()
    whole = whole.withColumn("wanted", wanted).withColumn("bound", F.coalesce("bound", F.array().cast("array<struct<field:string,said:string>>")))
    gone = F.filter("wanted", lambda w: ~F.exists("bound", lambda x: x.field == w.field))
    missed = F.transform(gone, lambda w: found(F.when(w.required, "missing_required").otherwise("missing_optional"), F.when(w.required, "error").otherwise("warning"), w.field, text("Missing variable '%s'", w.field)))
    wrong = F.transform(F.filter("bound", lambda x: x.said.isNotNull()), lambda x: found(F.lit("type"), error, x.field, x.said))
    out = whole.select(*keys, F.inline(F.concat(missed, wrong)))
    return named.select(*keys, F.inline(F.concat(*parts))).unionByName(out) if parts else out


def verdict(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Errors, warnings and whether the file is valid; files without any violation have no row here."""
    return found.groupBy(*keys).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings")).withColumn("valid", F.col("errors") == 0)


def fix_template(gone: DataFrame, fields: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, template): assignments for what is missing, required ones first, in order of name."""
    rows = gone.join(fields.select("field", "sensitive", "default", "description"), "field")
    note = F.when(F.col("description").isNotNull(), F.concat(F.lit("# "), "description", F.lit("\n"))).otherwise("")
    line = F.when(F.col("required") & F.col("sensitive"), F.concat("field", F.lit('="encrypted:YOUR_VALUE_HERE"'))).when(F.col("required"), F.concat("field", F.lit("="))).otherwise(F.concat(F.lit("# "), "field", F.lit("="), F.coalesce("default", F.lit(""))))
    part = lambda want, head: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("required") == want, F.struct("field", F.concat(note, line).alias("t"))))), lambda x: F.concat(x.t, F.lit("\n"))), "\n")
    grouped = rows.groupBy(*keys).agg(part(True, "").alias("a"), part(False, "").alias("b"))
    headed = lambda c, head: F.when(F.col(c) != "", F.concat(F.lit(head + "\n"), F.col(c)))
    return grouped.select(*keys, F.concat_ws("\n", headed("a", "# Missing required variables:"), headed("b", "# Missing optional variables (have defaults):")).alias("template"))


def encryption_report(variables: DataFrame, keys: tuple[str, ...] = (), sensitive: DataFrame | None = None, names: bool = True) -> DataFrame:
    """By file: sets of encrypted, plaintext and empty names and of plaintext secrets, the ratio, whether all is encrypted, the one
    backend if there is exactly one, and whether a commit should be blocked. Public keys and metadata don't count. Without names the
    sets are their sizes, of rows with a name each, and nothing is gathered however many a file has."""
    rows = variables.where(~classify.public_key_name(F.col("name")) & ~classify.sops_key(F.col("name")))
    marked = F.lit(False)
    if sensitive is not None:
        rows = rows.join(sensitive.select(F.col("field").alias("name"), F.lit(True).alias("__marked")), "name", "left")
        marked = F.coalesce("__marked", F.lit(False))
    name, value = F.col("name"), F.col("value")
    state = classify.status(value)
    secret = (state == "plaintext") & (classify.suspicious_value(value, classify.REPORTED_VALUES) | classify.sensitive_name(name, classify.REPORTED_NAMES) | marked)
    tests = {"encrypted": state == "encrypted", "plaintext": state == "plaintext", "empty": state == "empty", "plaintext_secrets": secret}
    counts = [F.count_if(test).alias(f"__{k}") for k, test in tests.items()]
    sets = [F.sort_array(F.collect_set(F.when(test, name))).alias(k) for k, test in tests.items()] if names else []
    # there are only so many back ends
    grouped = rows.groupBy(*keys).agg(*counts, *sets, F.sort_array(F.collect_set(classify.value_backend(value))).alias("__backends"))
    n = F.col("__encrypted") + F.col("__plaintext")
    return grouped.select(
        *keys,
        *(F.col(k if names else f"__{k}").alias(k) for k in tests),
        F.when(n > 0, F.col("__encrypted") / n).otherwise(0.0).alias("ratio"),
        ((n > 0) & (F.col("__plaintext") == 0)).alias("fully_encrypted"),
        F.when(F.size("__backends") == 1, F.get("__backends", F.lit(0))).alias("backend"),
        (F.col("__plaintext_secrets") > 0).alias("should_block"),
    )


def recommendations(reported: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What to do about an encryption report, a row for each advice."""
    advice = F.array_compact(
        F.array(
            F.when(F.size("plaintext_secrets") > 0, F.concat(F.lit("Encrypt: "), F.array_join("plaintext_secrets", ", "))),
            F.when((F.size("encrypted") > 0) & (F.size("plaintext") > 0), F.lit("The file is encrypted in part; encrypt the rest")),
            F.when((F.size("encrypted") == 0) & (F.size("plaintext") > 0), F.lit("The file isn't encrypted")),
        )
    )
    return reported.select(*keys, F.explode(advice).alias("advice"))


def infer(variables: DataFrame, detect_sensitive: bool = True) -> DataFrame:
    """FIELDS from the variables of one or many files: of each name the widest type that its values need, and whether name or value says
    secret. A name that some file lacks a value for is still required."""
    value = F.col("value")
    one = F.when(F.lower(value).isin("true", "false"), "bool").when(value.rlike("^[0-9]+$"), "int").otherwise("str")
    secret = classify.sensitive_name(F.col("name"), classify.REPORTED_NAMES) | classify.suspicious_value(value, classify.REPORTED_VALUES)
    grouped = variables.groupBy("name").agg(F.collect_set(one).alias("kinds"), F.bool_or(secret).alias("secret"))
    kind = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise("str")
    return grouped.select(
        F.col("name").alias("field"),
        kind.alias("type"),
        F.lit(True).alias("required"),
        (F.col("secret") & F.lit(detect_sensitive)).alias("sensitive"),
        F.lit(None).cast("string").alias("default"),
        F.array("name").alias("binding_names"),
        F.lit(None).cast("string").alias("description"),
    )
