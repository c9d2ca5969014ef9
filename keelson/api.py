"""The public functions over files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import contract, drift, findings
from .sources import dotenv


def variables(files: DataFrame, lenient: bool = True, environ: dict[str, str] | None = None) -> DataFrame:
    """(path, name, value, line_number): of each name of each file the last assignment that counts."""
    parsed = dotenv.parse_files(files.select("path", "content"), lenient, environ)
    return dotenv.latest(dotenv.events(parsed)).select("path", "name", "value", "line_number")


def diff(files: DataFrame, left: str, right: str, fields: DataFrame | None = None, mask: bool = True, include_unchanged: bool = False, normalize: bool = True) -> DataFrame:
    """What differs from one file to another."""
    found = variables(files.where(F.col("path").isin(left, right)))
    side = lambda path: found.where(F.col("path") == path).drop("path")
    return drift.drift(side(left), side(right), fields, mask=mask, include_unchanged=include_unchanged, normalize=normalize, collections=True)


def validate(files: DataFrame, fields: DataFrame, extra_policy: str = "forbid", check_encryption: bool = True, lenient: bool = True) -> DataFrame:
    """All violations of a contract, by file; also of files that set nothing."""
    return contract.violations(variables(files, lenient), fields, ("path",), extra_policy, check_encryption, files=files)


def init(files: DataFrame, detect_sensitive: bool = True) -> DataFrame:
    """The contract that the files keep."""
    return contract.infer(variables(files), detect_sensitive)


def guard(files: DataFrame, **options) -> DataFrame:
    """All findings of files (path, content, tracked)."""
    return findings.guard(files, **options)
