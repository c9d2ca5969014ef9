"""From the text of configuration files to assignments.

A file is read once, front to back, by a cursor: a binding may span lines (quoted keys and values), and interpolation looks
back at what the same file has set before. Files are independent, so the work is spread by file, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a backslash and a letter stand for between double quotes; between single quotes only the first two do.
ESCAPES = {"\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
ASSIGNMENT = "struct<name:string,value:string,line_number:int,status:string,raw_line:string,backend:string>"
PARSED = f"assignments array<{ASSIGNMENT}>, bare array<struct<name:string,line_number:int>>, comments array<string>, unparsed_lines array<int>, leading_bom boolean"

_NEWLINE = re.compile("\r\n|\r|\n")
_EXPORT = re.compile(r"export[^\S\n]+")
_KEY = re.compile(r"[^=#\s]+")
_STRICT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_REST = re.compile(r"[^\S\n]*(?:#[^\n]*)?(?=\n|\Z)")
_BODY = {q: re.compile(rf"{q}((?:\\(?:.|\n)|[^{q}\\])*){q}") for q in "\"'"}
_ESCAPED = {'"': re.compile(r"\\([\\'\"abfnrtv])"), "'": re.compile(r"\\([\\'])")}
_REFERENCE = re.compile(r"\$\{([^}:]*)(?::-([^}]*))?\}")
_COMMENT = re.compile(r"\s+#.*")


class Assignment(NamedTuple):
    name: str
    value: str
    line_number: int
    status: str
    raw_line: str
    backend: str | None


class Parsed(NamedTuple):
    assignments: list[Assignment]
    bare: list[tuple[str, int]]
    comments: list[str]
    unparsed_lines: list[int]
    leading_bom: bool


def classify(value: str) -> tuple[str, str | None]:
    if not value:
        return "empty", None
    found = "dotenvx" if value.startswith("encrypted:") else "sops" if value.startswith("ENC[AES256_GCM,") else None
    return ("encrypted" if found else "plaintext"), found


def parse(content: str, lenient: bool = True, environ: dict[str, str] | None = None) -> Parsed:
    """All bindings of a text, in order. lenient: keys need not be identifiers."""
    bom = content.startswith("\ufeff")
    text = _NEWLINE.sub("\n", content[1:] if bom else content)
    out = Parsed([], [], [], [], bom)
    known: dict[str, str | None] = {}  # None: a bare key
    at, number = 0, 1
    while at < len(text) or (at == 0 and not text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        end = stop
        if line.strip().startswith("#"):
            out.comments.append(line.strip())
        elif line.strip():
            key, value, end = _binding(text, at + len(line) - len(line.lstrip()), stop, lenient)
            if key is None:
                out.unparsed_lines.append(number)
            elif value is None:
                known[key] = None
                out.bare.append((key, number))
            else:
                value = _REFERENCE.sub(lambda m: _resolve(m, known, environ or {}), value)
                known[key] = value
                out.assignments.append(Assignment(key, value, number, classify(value)[0], text[at:end], classify(value)[1]))
        number += text.count("\n", at, end) + 1
        at = end + 1
    return out


def _binding(text: str, at: int, stop: int, lenient: bool) -> tuple[str | None, str | None, int]:
    """(key, value, end of its last line): no key if it is malformed, no value if it is bare."""
    if export := _EXPORT.match(text, at, stop):
        at = export.end()
    if text.startswith("'", at):
        close = text.find("'", at + 1)
        if close < 0:
            return None, None, stop
        if close == at + 1:
            return None, None, stop
        key, at = text[at + 1 : close], close + 1
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
    else:
        found = _KEY.match(text, at, stop)
        if not found or not (lenient or _STRICT.match(found.group())):
            return None, None, stop
        key, at = found.group(), found.end()
    tail = text[at:stop].lstrip()
    if not tail.startswith("="):
        return (key if _REST.match(text, at) else None), None, stop
    at = text.index("=", at) + 1
    raw = text[at:stop]
    if raw.strip()[:1] in ("'", '"') and raw.strip():
        quote = raw.strip()[0]
        body = _BODY[quote].match(text, text.index(quote, at))
        if not body:
            return None, None, stop
        rest = _REST.match(text, body.end())
        last = text.find("\n", body.end())
        last = len(text) if last < 0 else last
        if not rest:
            return None, None, last
        return key, _ESCAPED[quote].sub(lambda m: ESCAPES[m.group(1)], body.group(1)), last
    return key, _COMMENT.sub("", raw.lstrip()).rstrip(), stop


def _resolve(m: re.Match, known: dict[str, str | None], environ: dict[str, str]) -> str:
    """What the file has set before, else the environment, else the default; a bare key is empty in any case."""
    name, default = m.group(1), m.group(2)
    return known[name] or "" if name in known else environ.get(name, default or "")


def loose_value(raw: str) -> str:
    """The value of a right-hand side by itself, also of a malformed one: then without its comment and one pair of quotes."""
    key, value, _ = _binding(f"K={raw}", 0, len(raw) + 2, False) if "\n" not in raw else _binding(f"K={raw}", 0, raw.index("\n") + 2, False)
    if key is not None:
        return value or ""
    quote, at, text = "", 0, raw
    while at < len(raw):
        c = raw[at]
        if c == "\\" and at + 1 < len(raw):
            at += 1
        elif c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        elif c == "#" and not quote and at and raw[at - 1].isspace():
            text = raw[:at]
            break
        at += 1
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse_files(files: DataFrame, lenient: bool = True, environ: dict[str, str] | None = None, content: str = "content") -> DataFrame:
    """The other columns of files, and what its text parses to. A null text is an empty one."""
    others = [f for f in files.schema if f.name != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), PARSED])
    kinds = {
        "assignments": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("line_number", pa.int32()), ("status", pa.string()), ("raw_line", pa.string()), ("backend", pa.string())])),
        "bare": pa.list_(pa.struct([("name", pa.string()), ("line_number", pa.int32())])),
        "comments": pa.list_(pa.string()),
        "unparsed_lines": pa.list_(pa.int32()),
        "leading_bom": pa.bool_(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [parse(x or "", lenient, environ) for x in batch.column(content).to_pylist()]
            new = {
                "assignments": [[a._asdict() for a in p.assignments] for p in done],
                "bare": [[{"name": n, "line_number": k} for n, k in p.bare] for p in done],
                "comments": [p.comments for p in done],
                "unparsed_lines": [p.unparsed_lines for p in done],
                "leading_bom": [p.leading_bom for p in done],
            }
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in others} | {k: pa.array(v, kinds[k]) for k, v in new.items()})

    return files.select(*(f"`{f.name}`" for f in others), content).mapInArrow(run, schema)


def assignments(parsed: DataFrame) -> DataFrame:
    """A row for each assignment of each file, those that a later one hides included."""
    return parsed.select("*", F.inline("assignments")).drop("assignments", "bare", "comments", "unparsed_lines", "leading_bom")


def events(parsed: DataFrame) -> DataFrame:
    """Assignments, and bare keys as rows without a value."""
    others = [c for c in parsed.columns if c not in ("assignments", "bare", "comments", "unparsed_lines", "leading_bom")]
    bare = parsed.select(*others, F.inline("bare"))
    return assignments(parsed).unionByName(bare, allowMissingColumns=True)


def latest(events: DataFrame, keys: tuple[str, ...] = ("path",), order: str = "line_number") -> DataFrame:
    """Of each name the last event, unless that is a bare key."""
    by = [*keys, "name"]
    rest = [c for c in events.columns if c not in by]
    last = events.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return last.select(*by, "__last.*").where(F.col("value").isNotNull()).select(*events.columns)


def physical_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for each line, by the three line ends that configuration files know."""
    lines = F.split(F.col(content), "\r\n|\r|\n", -1)
    return files.select(*(c for c in files.columns if c != content), F.posexplode(lines).alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


def text_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """A row for each line, by all line ends that Unicode knows; no empty last line."""
    lines = F.split(F.regexp_replace(F.col(content), "(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])$", ""), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    rows = files.where(F.col(content) != "").select(*(c for c in files.columns if c != content), F.posexplode(lines).alias("line_number", "line"))
    return rows.withColumn("line_number", F.col("line_number") + 1)


def first_key(files: DataFrame, key: str) -> DataFrame:
    """(path, value): of each file the first line KEY=, without one layer of quotes; null if there is none, '' if it is empty."""
    lines = physical_lines(files).where(F.trim("line").startswith(key + "="))
    raw = F.trim(F.substring(F.trim("line"), len(key) + 2, 1 << 30))
    value = F.when(raw.rlike("""^(["']).*\\1$""") & (F.length(raw) > 1), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    found = lines.groupBy("path").agg(F.min_by(value, "line_number").alias("value"))
    return files.select("path").distinct().join(found, "path", "left")
