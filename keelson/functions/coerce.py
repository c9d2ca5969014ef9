"""Whether a text is a value of a type, as typed settings read it from the environment, and what value it is.

The rules are those of pydantic's lax string mode; SQL casts differ (underscores, aliases of true, full-width digits).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import is_dataclass
from types import UnionType
from typing import Annotated, Any, TypeAliasType, Union, get_args, get_origin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for true and for false.
TRUE, FALSE = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")
_INT = r"^\s*[+-]?[0-9]+(_[0-9]+)*([.]0+)?\s*$"
_FLOAT = r"(?i)^\s*[+-]?([0-9]+(_[0-9]+)*([.]([0-9]+(_[0-9]+)*)?)?(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
#: Types that are not decoded from JSON; a type may be optional by a leading ?.
SCALARS = ("str", "int", "float", "bool")


def _structured(kind: Any) -> bool:
    """Whether a class holds other values: models, data classes and collections do, texts don't."""
    if not isinstance(kind, type) or issubclass(kind, (str, bytes)):
        return False
    return issubclass(kind, (Mapping, Sequence, set, frozenset, deque)) or hasattr(kind, "model_fields") or is_dataclass(kind)


def _decoded(kind: Any, marks: Sequence[Any]) -> bool:
    alias = next((x for x in (kind, get_origin(kind)) if isinstance(x, TypeAliasType)), None)
    kind = alias.__value__ if alias else kind
    root = getattr(kind, "model_fields", {}).get("root") if isinstance(kind, type) else None
    kind = root.annotation if root else kind  # a model of one value is what that is
    if any(getattr(m, "__name__", type(m).__name__) == "Json" for m in marks):
        return False  # the text goes to the type, which decodes it
    if get_origin(kind) is Annotated:
        return _decoded(get_args(kind)[0], get_args(kind)[1:])
    return _structured(kind) or _structured(get_origin(kind))


def complexity(kind: Any, marks: Sequence[Any] = ()) -> tuple[bool, bool]:
    """Of a field's annotation: whether its text is decoded from JSON, and whether a text that can't be is passed on as it is. A structured
    type must decode; a union with a structured member may."""
    while get_origin(kind) is Annotated:
        kind, marks = get_args(kind)[0], (*get_args(kind)[1:], *marks)
    if _decoded(kind, marks):
        return True, False
    some = get_origin(kind) in (Union, UnionType) and any(_decoded(x, marks) for x in get_args(kind))
    return some, some


def _shape(value: Column, prefix: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith(prefix), F.lit(False))


def accepted(value: Column, kind: Column) -> Column:
    """True if the text is a value of the type, false if not, null for types that say nothing (any, none, or unknown)."""
    k = F.regexp_replace(kind, "^[?]", "")
    return (
        F.when(k == "str", True)
        .when(k == "int", value.rlike(_INT))
        .when(k == "float", value.rlike(_FLOAT))
        .when(k == "bool", F.lower(value).isin(*TRUE, *FALSE))
        .when(k.startswith("list"), _shape(value, "ARRAY"))
        .when(k.startswith("map"), _shape(value, "OBJECT"))
        .when(k == "json", F.try_parse_json(value).isNotNull())
        .when(k == "str|list", True)  # a union tolerates what is no JSON
    )


def canonical(value: Column, kind: Column) -> Column:
    """A text that is the same for equal values of the type; null where accepted() isn't true. Structured types go by json_key()."""
    k = F.regexp_replace(kind, "^[?]", "")
    digits = F.regexp_replace(F.regexp_replace(F.trim(value), "_|[.]0*$", ""), "^[+]", "")
    whole = F.regexp_replace(F.regexp_replace(digits, "^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    real = F.regexp_replace(F.trim(value), "_", "").try_cast("double")
    key = F.when(k == "int", whole).when(k == "float", real.cast("string")).when(k == "bool", F.lower(value).isin(*TRUE).cast("string")).otherwise(value)
    return F.when(accepted(value, kind), key)


def message(value: Column, kind: Column) -> Column:
    """Why the text is no value of the type."""
    k = F.regexp_replace(kind, "^[?]", "")
    said = F.when(k == "int", F.format_string("Expected integer, got '%s'", value)).when(k == "float", F.format_string("Expected float, got '%s'", value)).when(k == "bool", F.format_string("Expected boolean, got '%s'", value))
    return F.when(~accepted(value, kind), said.otherwise(F.format_string("Expected valid JSON for complex type, got '%s'", value)))


def loose(text: str) -> object:
    """A collection in JSON or in Python's own notation, or None."""
    import ast

    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return None


def _same(a: str | None, b: str | None) -> bool | None:
    if a is None or b is None:
        return None
    x, y = loose(a), loose(b)
    return None if x is None or y is None else x == y


@F.pandas_udf(T.BooleanType())
def same_collection(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two collections are equal whatever the order of their keys; null where either can't be read. Null rows cost nothing."""
    return pd.Series([_same(x, y) for x, y in zip(a, b, strict=True)], dtype="object")
