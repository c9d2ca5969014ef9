"""Files, listings, snapshots, registries and configurations as DataFrames."""

from __future__ import annotations

import codecs
import json
import re
import tomllib
from datetime import timedelta
from difflib import get_close_matches
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify

#: Larger files are not read.
MOST_BYTES = 10 << 20
# What companions of environment files end in, folders that a walk doesn't enter, and the bytes that text has.
COMPANIONS = (".example", ".sample", ".template", ".keys")
PRUNED = (
    "node_modules", ".git", ".venv", "venv", "__pycache__", ".next", "dist", "build", ".tox", ".nox", "coverage", ".gradle", "target",
    "vendor", ".idea", ".vscode", ".terraform", "bin", "obj", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", "htmlcov", ".svn", ".hg",
)
# What a collection leaves out unless told otherwise.
IGNORED = (
    ".env.example", ".env.sample", ".env.template", "*.md", "*.rst", "*.adoc", "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js",
    "__pycache__/**", "*.pyc", "*.pyo", "*.pyd", ".Python", ".venv/**", "venv/**", "env/**", "ENV/**", ".tox/**", ".nox/**",
    ".pytest_cache/**", ".mypy_cache/**", ".ruff_cache/**", ".hypothesis/**", "*.egg-info/**", "*.egg", "dist/**", "build/**", "*.whl",
    ".coverage", "htmlcov/**", ".cache/**", "node_modules/**", ".npm/**", ".yarn/**", ".pnp.*", "*.log", "npm-debug.log*",
    "yarn-debug.log*", "yarn-error.log*", "lerna-debug.log*", ".pnpm-debug.log*", ".next/**", "out/**", ".nuxt/**", ".parcel-cache/**",
    ".svelte-kit/**", "coverage/**", ".turbo/**", "target/**", "*.class", "*.jar", "*.war", "*.ear", ".gradle/**", ".mvn/**", "bin/**",
    "obj/**", "*.dll", "*.exe", "*.pdb", "packages/**", ".vs/**", "*.user", "*.suo", "vendor/**", "[!.]*.test", "*.out", ".bundle/**",
    "vendor/bundle/**", "*.gem", ".git/**", ".svn/**", ".hg/**", ".bzr/**", ".idea/**", ".vscode/**", "*.swp", "*.swo", "*~",
    ".project", ".classpath", ".settings/**", "*.sublime-*", ".DS_Store", "Thumbs.db", "desktop.ini", ".docker/**", ".terraform/**",
    "*.tfstate", "*.tfstate.*", "*.zip", "*.tar", "*.tar.gz", "*.rar", "*.7z", "*.iso", "*.dmg", "*.pkg", "*.jpg", "*.jpeg", "*.png",
    "*.gif", "*.bmp", "*.ico", "*.svg", "*.mp3", "*.mp4", "*.avi", "*.mov", "*.pdf", "*.woff", "*.woff2", "*.ttf", "*.eot", "logs/**",
    "tmp/**", "temp/**", "*.tmp", "*.temp", "*.bak", "*.backup",
)
TEXT = np.isin(np.arange(256), [8, 9, 10, 11, 12, 13, *range(0x20, 0x100)])
BOMS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"), (codecs.BOM_UTF8, "utf-8-sig"))


def _utf16(head: bytes) -> str | None:
    """ASCII in UTF-16 has zeros in one of two planes only."""
    half = len(head) // 2
    if half < 4:
        return None
    planes = [head[k : 2 * half : 2].count(0) / half for k in (0, 1)]
    return next((name for name, zero, full in (("utf-16-le", planes[1], planes[0]), ("utf-16-be", planes[0], planes[1])) if zero > 0.7 and full < 0.05), None)


def decoded(raw: bytes | None) -> str | None:
    """The text of a file, or None for binaries and blank files."""
    if raw is None:
        return None
    head = raw[:8192]
    name = next((codec for bom, codec in BOMS if raw.startswith(bom)), None) or _utf16(head)
    if name:
        text = raw.decode(name, "replace")
    elif head and (~TEXT[np.frombuffer(head, np.uint8)]).mean() > 0.05:
        return None
    else:
        text = raw.decode("utf-8", "ignore")
    text = text.replace("\0", "")
    return text if text.strip() else None


@F.pandas_udf(T.StringType())
def decode_text(raw: pd.Series) -> pd.Series:
    return raw.map(decoded)


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path, content) of all text files below a path. Size and folders are filtered before any content is read; of folders only those
    below the path count, not those on the way to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most_bytes)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    above = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).depth()
    parts = F.split(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")  # the first is empty
    folders = F.slice(parts, above + 2, F.greatest(F.size(parts) - above - 2, F.lit(0)))
    files = files.where(~F.exists(folders, lambda part: part.isin(*pruned)))
    return files.select("path", decode_text("content").alias("content")).where("content is not null")


def read_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the files that are UTF-8, and (path, error) of the others."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.where(valid).select("path", F.col("content").cast("string").alias("content")), files.where(~valid).select("path", F.lit("not UTF-8").alias("error"))


def listing(files: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """Of (path, tracked, ignored) what is to be scanned: tracked files, files that aren't ignored, ignored ones that look like
    environment files, and configured ones, each once and in order."""
    name = F.substring_index("path", "/", -1)
    env = (name.startswith(".env") | name.endswith(".env")) & (name != ".env.keys")
    wanted = F.col("tracked") | ~F.col("ignored") | env | F.col("path").isin(*configured)
    return files.where(wanted).select("path").distinct().orderBy("path")


def watch(spark: SparkSession, path: str, glob: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of (project, path, ts, op) of the files that appear or are rewritten below a folder; only their status is read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(path)
    return found.select(F.lit(path).alias("project"), "path", F.col("modificationTime").alias("ts"), F.lit("write").alias("op"))


def changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files that a change list (path, status) adds, copies, modifies or renames."""
    return files.join(changes.where(F.col("status").substr(1, 1).isin("A", "C", "M", "R")).select("path"), "path", "left_semi")


def snapshot(files: DataFrame, snapshot_id: str) -> DataFrame:
    """One version of a table of versions; the filter prunes partitions where the table is partitioned by snapshot_id."""
    return files.where(F.col("snapshot_id") == snapshot_id)


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for line ends and white space around."""
    plain = lambda c: classify.strip(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    return plain(a).eqNullSafe(plain(b))


def env_files(files: DataFrame, mappings: DataFrame, folders: DataFrame | None = None, default: str = "production") -> DataFrame:
    """For mappings (folder, environment, env_file) the file of (folder, name) that is meant, and a status: the configured one;
    else .env.<environment>; else one whose name encodes the environment; else a plain .env for the default one. found,
    multiple_found, not_found, or folder_not_found if folders lists the folders and this isn't one."""
    real = files.where(~classify.any_of(*(F.lower("name").endswith(c) for c in COMPANIONS)))
    name, environment = F.col("name"), F.col("environment")
    rank = (
        F.when(F.col("env_file").isNotNull(), F.when(name == F.col("env_file"), 0))
        .when(name == F.concat(F.lit(".env."), environment), 1)
        .when(classify.name_encodes(name, environment, default) & (name != ".env"), 2)
        .when((name == ".env") & (environment == default), 3)
    )
    met = mappings.join(real, "folder", "left").withColumn("rank", rank)
    best = met.groupBy("folder", "environment", "env_file").agg(F.min("rank").alias("best"), F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "name")))).alias("all"))
    chosen = F.filter("all", lambda x: x["rank"] == F.col("best"))
    status = F.when(F.size(chosen) == 1, "found").when(F.size(chosen) > 1, "multiple_found").otherwise("not_found")
    out = best.select("folder", "environment", "env_file", F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))["name"]).alias("name"), status.alias("status"))
    if folders is not None:
        out = out.join(folders.select("folder", F.lit(True).alias("__there")), "folder", "left").withColumn("status", F.when(F.col("__there").isNull(), "folder_not_found").otherwise(F.col("status"))).drop("__there")
    return out


def vault(secrets: DataFrame, prefix: str = "") -> DataFrame:
    """The secrets of a vault's snapshot (secret_name, value, version, metadata) whose names start with a prefix."""
    return secrets.where(F.col("secret_name").startswith(prefix))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a registry file; none if it can't be read."""
    read = spark.read.option("multiLine", True).schema("projects array<struct<path:string,added:string>>, _corrupt_record string").json(path)
    return read.where("_corrupt_record is null").select(F.inline("projects"))


def find_config(start: Path, names: tuple[str, ...] = ("keelson.toml", "pyproject.toml"), section: str = "keelson") -> Path | None:
    """The nearest configuration on the way up; a pyproject.toml counts if it has the section."""
    for folder in (start, *start.parents):
        for name in names:
            found = folder / name
            if found.is_file() and (name != "pyproject.toml" or section in tomllib.loads(found.read_text()).get("tool", {})):
                return found
    return None


def load_config(path: Path, section: str = "keelson") -> dict:
    read = tomllib.loads(path.read_text())
    return read.get("tool", {}).get(section, {}) if path.name == "pyproject.toml" else read


def unknown_keys(config: dict, known: dict, at: str = "") -> list[tuple[str, str | None]]:
    """(dotted key, the known key that it looks like) for what known doesn't have, on every level; known values are dicts, lists of
    one dict, or None for anything."""
    out = []
    for key, value in config.items():
        if key not in known:
            near = get_close_matches(key, list(known), 1, 0.6)
            out.append((at + key, near[0] if near else None))
            continue
        shape = known[key][0] if isinstance(known[key], list) else known[key]
        for entry in value if isinstance(value, list) else [value]:
            if isinstance(entry, dict) and isinstance(shape, dict):
                out += unknown_keys(entry, shape, f"{at}{key}.")
    return out


def idle_timeout(text: str, default: timedelta = timedelta(minutes=5)) -> timedelta:
    """30s, 5m, 2h, 1d, or several units in a row such as 1h30m; the default for anything else."""
    units = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        return default
    return timedelta(**{units[u]: sum(float(a) for a, b in parts if b == u) for u in {b for _, b in parts}})


def project_path(text: str) -> str:
    return str(Path(text).expanduser().resolve())


def contract_rows(module_fields: list[dict]) -> list[tuple]:
    """Rows for contract.FIELDS from plain descriptions; a field without binding names is bound by its alias or its name."""
    return [(f["name"], f.get("type"), f.get("required", "default" not in f), f.get("sensitive", False), None if f.get("default") is None else json.dumps(f["default"]) if not isinstance(f["default"], str) else f["default"], list(f.get("binding_names") or [f.get("alias") or f["name"]]), f.get("description")) for f in module_fields]
