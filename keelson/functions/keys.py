"""Key material as vaults hold it: from a bare key, a KEY=value line, a file of such lines, or a JSON document."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "DOTENV_PRIVATE_KEY_"
SHAPE = T.StructType([T.StructField(n, T.StringType()) for n in ("value", "suffix", "error")])
_LINE = re.compile(r"\s*(?:export\s+)?DOTENV_PRIVATE_KEY_([A-Za-z0-9_]+)\s*=(.*)", re.DOTALL)


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _one(entries: list[tuple[str, str]], environment: str | None, repeated: bool) -> tuple[str, str] | str | None:
    """Of (suffix, value) the one of the environment, else the only one; a text says why there is none."""
    mine = [e for e in entries if environment is not None and e[0].upper() == environment.upper()]
    if len(mine) == 1:
        return mine[0][1], mine[0][0]
    if len(mine) > 1 and repeated:
        return "several lines for the environment"
    if len(entries) == 1:
        return entries[0][1], entries[0][0]
    return "several keys, none for the environment" if entries else None


def normalized(raw: str | None, environment: str | None = None) -> tuple[str | None, str | None, str | None]:
    """(value, suffix, error): the key without white space, quotes and label, and the environment of its label."""
    if raw is None:
        return None, None, None
    text = _bare(raw)
    document = None
    if text[:1] in ("{", "["):
        try:
            document = json.loads(text)
        except ValueError:
            if "\n" not in text:
                return text, None, None
        else:
            if not isinstance(document, dict):
                return None, None, "a JSON document that is no object"
    if document is not None:
        fields = []
        for key, value in document.items():
            if re.fullmatch(NAME + r"[A-Za-z0-9_]+", key) and isinstance(value, str):
                suffix, inner = key[len(NAME) :], _bare(value)
                line = _LINE.fullmatch(inner)
                fields.append((suffix, _bare(line.group(2)) if line and line.group(1).upper() == suffix.upper() else inner))
        found = _one(fields, environment, False)
        if isinstance(found, tuple):
            return *found, None
        if len(document) == 1 and isinstance(document.get("value"), str):
            return normalized(document["value"], environment)
        return None, None, "a JSON document without a usable key"
    if "\n" in text:
        lines = [m for line in text.splitlines() if not _bare(line).startswith("#") and (m := _LINE.fullmatch(_bare(line)))]
        found = _one([(m.group(1), _bare(m.group(2))) for m in lines], environment, True)
        return (*found, None) if isinstance(found, tuple) else (None, None, found or "several lines without a key")
    line = _LINE.fullmatch(text)
    return (_bare(line.group(2)), line.group(1), None) if line else (text, None, None)


@F.pandas_udf(SHAPE)
def normalize(raw: pd.Series, environment: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normalized(r, e) for r, e in zip(raw, environment, strict=True)], columns=["value", "suffix", "error"])


def shape_error(value: Column) -> Column:
    """Why a value can't be a key; null if it can."""
    return (
        F.when(value == "", "empty")
        .when(value.rlike(r"(?U)\s"), "has white space")
        .when(value.rlike(f"^{NAME}[A-Za-z0-9_]+="), "has a label")
        .when(value.rlike(r"^[\[{]"), "is a document")
        .when(value.startswith("base64:"), "is marked as binary")
    )


def effective_environment(environment: Column, profile: Column) -> Column:
    return F.coalesce(environment, profile, F.lit("production"))


def key_name(environment: Column) -> Column:
    return F.concat(F.lit(NAME), F.upper(environment))
