"""Column expressions that classify names, values and lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import SEVERITIES

# Patterns of sensitive names and of values that look like secrets, for checks against a contract
# (CHECKED_*) and for encryption reports (REPORTED_*); the two lists differ on purpose.
CHECKED_NAMES = ("_KEY$", "_SECRET$", "_TOKEN$", "_PASSWORD$", "_PASS$", "_CREDENTIAL", "_API_KEY$", "^JWT_", "^AUTH_", "_DSN$")
REPORTED_NAMES = ("_KEY$", "_SECRET$", "_TOKEN$", "_PASSWORD$", "_PASS$", "_CREDENTIAL", "_API_KEY$", "^JWT_", "^AUTH_", "^PRIVATE_", "_DSN$")
CHECKED_VALUES = (
    "(?i)^sk[-_]",
    "(?i)^pk[-_]",
    "(?i)password",
    "(?i)secret",
    "^ghp_",
    "^gho_",
    "^ghu_",
    "^xox[baprs]-",
    "^AKIA[0-9A-Z]{16}$",
    "^postgres://.*:.*@",
    "^postgresql://.*:.*@",
    "^mysql://.*:.*@",
    "^redis://.*:.*@",
    "^mongodb://.*:.*@",
    r"^mongodb\+srv://.*:.*@",
    r"eyJ[A-Za-z0-9_-]+\.eyJ",
)
REPORTED_VALUES = (
    "(?i)^sk[-_]",
    "(?i)^pk[-_]",
    "^ghp_",
    "^gho_",
    "^xox[baprs]-",
    "^AKIA[0-9A-Z]{16}$",
    r"^eyJ[A-Za-z0-9_-]+\.eyJ",
    "^postgres(ql)?://[^:]+:[^@]+@",
    "^mysql://[^:]+:[^@]+@",
    "^redis://[^:]+:[^@]+@",
    r"^mongodb(\+srv)?://[^:]+:[^@]+@",
)
PUBLIC_KEY = "DOTENV_PUBLIC_KEY"
SOPS_KEYS = (
    "sops_version",
    "sops_mac",
    "sops_lastmodified",
    "sops_unencrypted_suffix",
    "sops_encrypted_suffix",
    "sops_unencrypted_regex",
    "sops_encrypted_regex",
    "sops_unencrypted_comment_regex",
    "sops_encrypted_comment_regex",
    "sops_mac_only_encrypted",
    "sops_shamir_threshold",
)
SOPS_GROUPS = "^sops_(age|pgp|kms|gcp_kms|azure_kv|hc_vault)__"
AGENT_SOPS_GROUPS = "^sops_(age|pgp|kms|gcp_kms|azure_kv|hc_vault)(_|__|$)"
TEMPLATE_WORDS = ("Timestamp", "Message", "Exception", "NewLine", "Level", "Logger", "Thread", "Source", "Event", "Date", "Time")

#: What Python's str.strip() takes off, as a class for java.util.regex.
PY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(col: Column) -> Column:
    """All white space off both ends, by Unicode; trim() takes off the ASCII space alone."""
    return F.regexp_replace(col, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def status(value: Column) -> Column:
    return F.when(value == "", "empty").when(value.startswith("encrypted:") | value.startswith("ENC[AES256_GCM,"), "encrypted").when(value.isNotNull(), "plaintext")


class Backend(NamedTuple):
    """What tells the values and the files of a way to encrypt; encrypting itself is none of this library's business."""

    name: str
    value: Callable[[Column], Column]
    content: Callable[[Column], Column]


#: In the order in which they are tried. Others may be given to value_backend and backend.
BACKENDS = (
    Backend(
        "dotenvx",
        lambda v: v.startswith("encrypted:"),
        lambda c: c.rlike(r"""(?m)^\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*["']?encrypted:""") | c.contains("#/---BEGIN DOTENV ENCRYPTED---/") | c.rlike(rf"(?m)^{PUBLIC_KEY}(_\w+)?="),
    ),
    Backend("sops", lambda v: v.startswith("ENC[AES256_GCM,"), lambda c: c.contains("ENC[AES256_GCM,") | c.rlike(r'(?m)^(sops:|\s*"sops":|sops_version=|sops_mac=)')),
)


def value_backend(value: Column, backends: tuple[Backend, ...] = BACKENDS) -> Column:
    return F.coalesce(*(F.when(b.value(value), b.name) for b in backends))


def sensitive_name(name: Column, patterns: tuple[str, ...] = CHECKED_NAMES) -> Column:
    return name.rlike("(?i)" + "|".join(patterns))


def suspicious_value(value: Column, patterns: tuple[str, ...] = CHECKED_VALUES) -> Column:
    return any_of(*(value.rlike(p) for p in patterns))


def public_key_name(name: Column) -> Column:
    return (name == PUBLIC_KEY) | name.startswith(PUBLIC_KEY + "_")


def sops_key(name: Column) -> Column:
    return name.isin(*SOPS_KEYS) | name.rlike(SOPS_GROUPS)


def encrypted_line(line: Column) -> Column:
    """A value in its place, or an envelope anywhere; not a line that only mentions one."""
    return line.rlike(r"""^\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*["']?encrypted:""") | line.contains("ENC[AES256_GCM,")


def sops_line(line: Column) -> Column:
    return line.rlike(r'^(sops:\s*$|\s*"sops"\s*:|sops_version\s*=|sops_mac\s*=)')


def comment_line(line: Column) -> Column:
    return line.rlike(f"^{PY_SPACE}*#")


def encrypted_content(lines: Column) -> Column:
    """Whether any line that is no comment is ciphertext or metadata."""
    return F.exists(lines, lambda x: ~comment_line(x) & (encrypted_line(x) | sops_line(x)))


def _agent_parts(line: Column) -> tuple[Column, Column]:
    """Name and unquoted value of a line, cut at its first equals sign, as ciphertext often ends in some."""
    value = F.substring(line, F.instr(line, "=") + 1, F.length(line))
    return strip(F.substring_index(line, "=", 1)), strip(unquote(value))


def agent_skipped_name(name: Column) -> Column:
    return name.startswith(PUBLIC_KEY) | name.isin(*SOPS_KEYS) | name.rlike(AGENT_SOPS_GROUPS)


def _agent_assignment(line: Column) -> Column:
    return line.contains("=") & ~comment_line(line) & ~agent_skipped_name(_agent_parts(line)[0])


def agent_encrypted_line(line: Column) -> Column:
    """The agent's variant: any ENC[ envelope, the other prefix in any case; no comment, no metadata, no name that starts like a
    public key."""
    value = _agent_parts(line)[1]
    return _agent_assignment(line) & (F.lower(value).startswith("encrypted:") | value.startswith("ENC["))


def agent_encrypted(lines: Column) -> Column:
    """The agent's verdict on a file: some value is ciphertext, and none that isn't empty is anything else."""
    plain = lambda x: _agent_assignment(x) & ~agent_encrypted_line(x) & (_agent_parts(x)[1] != "")
    return F.exists(lines, agent_encrypted_line) & ~F.exists(lines, plain)


def editor_encrypted(lines: Column) -> Column:
    """The editor's variant: the assignment of a public key alone counts."""
    return F.exists(lines, lambda x: ~comment_line(x) & (encrypted_line(x) | x.rlike(rf"^\s*{PUBLIC_KEY}(_\w+)?\s*=")))


def backend(content: Column, backends: tuple[Backend, ...] = BACKENDS) -> Column:
    """Whose marks the content has; those of the first back end are looked for first."""
    return F.coalesce(*(F.when(b.content(content), b.name) for b in backends))


def plaintext_secret_line(line: Column) -> Column:
    """An assignment whose value is neither empty nor ciphertext, and that is no metadata."""
    name = F.regexp_extract(line, r"^\s*(?:export\s+)?([^\s=#]+)\s*=", 1)
    value = unquote(F.regexp_extract(line, r"^[^=]*=(.*)$", 1))
    return ~comment_line(line) & (name != "") & (value != "") & ~encrypted_line(line) & ~sops_key(name) & ~public_key_name(name)


def unquote(value: Column) -> Column:
    """Trimmed, without a comment after the closing quote, and without one pair of quotes."""
    v = strip(value)
    closed = F.regexp_extract(v, r"""^(["'])(.*?)\1\s*(?:#.*)?$""", 2)
    quoted = v.rlike(r"""^(["']).*?\1\s*(?:#.*)?$""")
    return F.when(quoted, closed).otherwise(v)


def redact(secret: Column, visible: int = 4) -> Column:
    n = F.length(secret)
    return F.when(n <= 2 * visible, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(secret, 1, visible), F.repeat(F.lit("*"), n - 2 * visible), F.right(secret, F.lit(visible))))


def secret_hash(secret: Column) -> Column:
    return F.sha2(secret.cast("binary"), 256)


def redact_keyed(value: Column, salt: str) -> Column:
    """Null stays null; else the length and a short keyed digest, which shows equality and nothing else."""
    digest = F.substring(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 1, 8)
    return F.when(value == "", "<empty>").when(value.isNotNull(), F.concat(F.lit("<"), F.length(value).cast("string"), F.lit(" chars, "), digest, F.lit(">")))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for an empty text."""
    chars = F.array_sort(F.filter(F.split(value, ""), lambda c: c != ""))
    n = F.length(value).cast("double")
    term = lambda run: F.when(run > 0, -(run / n) * F.log2(run / n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("h"))
    step = lambda s, c: F.when(s.c == c, F.struct(s.c.alias("c"), (s.run + 1).alias("run"), s.h.alias("h"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (s.h + term(s.run)).alias("h")))
    return F.when(value == "", 0.0).otherwise(F.aggregate(chars, start, step, lambda s: s.h + term(s.run)))


def member_access(value: str) -> bool:
    """Whether a value is code that reaches into something, such as config.password or reader->next(), and not noise with dots.

    It is taken apart at the access operators. Each piece must be a name, all but the first may be calls without arguments, and none
    may look random: a call, up to four characters, or a vowel in at least every sixth."""
    first, *rest = value.replace("?.", ".").replace("->", ".").split(".")
    if not rest or value != value.strip():
        return False
    for k, piece in enumerate((first, *rest)):
        piece = piece.strip()
        name, call, inside = piece.partition("(")
        if not (name.isascii() and name.replace("$", "_").isidentifier()) or call and (k == 0 or inside.strip() != ")"):
            return False
        if not piece.endswith("()") and len(piece) > 4 and 6 * sum(c in "AEIOUaeiou" for c in piece) < len(piece):
            return False
    return True


def template_score(value: Column) -> Column:
    count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
    braces = F.when((count("{") >= 2) & (count("}") >= 2), 2).otherwise(0)
    return braces + (value.contains(":") & value.rlike("[GgDdSsFfXxNn]")).cast("int") + (count("|") >= 3).cast("int") + any_of(*(value.contains(w) for w in TEMPLATE_WORDS)).cast("int")


def ec_public_key(value: Column) -> Column:
    return value.rlike("^0[23][0-9a-fA-F]{64}$")


def severity_rank(severity: Column) -> Column:
    """0 to 4; null for no severity at all."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def location(path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", path, F.when(line.isNotNull(), line.cast("string")), F.when(line.isNotNull(), column.cast("string")))


def noisy_rule(rule: Column) -> Column:
    return rule.rlike("generic|entropy|keyword")


def env_file_name(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.startswith(".env.") | name.endswith(".env")


def clear_file(path: Column, allowed: tuple[str, ...] = ()) -> Column:
    """A file that is meant to be plain: by its suffix, or listed by path or by the end of it."""
    return any_of(path.endswith(".clear"), *((path == a) | path.endswith("/" + a) for a in allowed))


def secret_file(path: Column) -> Column:
    return path.endswith(".secret")


def keys_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1) == ".env.keys"


def name_encodes(name: Column, environment: Column, default: str = "production") -> Column:
    """Whether a file name says that it is for an environment; a name that says none is for the default one."""
    ends = (F.concat(F.lit(head), environment, F.lit(tail)) for head, tail in ((".env.", ""), ("-", ".env"), (".", ".env"), ("_", ".env")))
    return any_of(name == F.concat(environment, F.lit(".env")), *(name.endswith(e) for e in ends)) | ((environment == default) & name.endswith(".env"))
