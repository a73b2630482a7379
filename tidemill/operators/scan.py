"""Which files are indexed, and why others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.config import Config
from tidemill.functions import text as X

LONG_LINE = 20_000


def in_excluded_dir(path: Column, exclude: list[str]) -> Column:
    """Any folder on the way (not the file's own name) is excluded."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, exclude))) if exclude else F.lit(False)


def in_included_dir(path: Column, include: list[str]) -> Column:
    out = F.lit(not include)
    for folder in include:
        out = out | path.startswith(folder.rstrip("/") + "/")
    return out


def is_binary(content: Column) -> Column:
    """A NUL, or bytes that weren't UTF-8 (decoded as null)."""
    return content.isNull() | (F.instr(content, "\x00") > 0)


def is_minified(path: Column, content: Column) -> Column:
    lines = X.lines_of(content)
    longest = F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))
    name = F.lower(path)
    return name.endswith(".min.js") | name.endswith(".min.css") | (longest >= LONG_LINE) | ((F.size(lines) <= 5) & (F.length(content) >= LONG_LINE))


def skip_reason(config: Config) -> Column:
    """Over ``path, ext, size_bytes, content``: cheap tests first; null where a file is indexed."""
    path, ext, size, content = (F.col(c) for c in ("path", "ext", "size_bytes", "content"))
    return (
        F.when(in_excluded_dir(path, config.exclude_dirs), "excluded_dir")
        .when(~ext.isin(*config.include_extensions), "extension")
        .when(F.floor(size / 1024) > config.max_file_kb, "too_large")
        .when(is_binary(content), "binary")
        .when(is_minified(path, content), "minified")
    )


def classify(files: DataFrame, config: Config) -> DataFrame:
    """One narrow pass. A path stands for one file: sources give each path once, so contents needn't move to find repeats."""
    inside = files.where(in_included_dir(F.col("path"), config.include_dirs)) if config.include_dirs else files
    return inside.withColumn("skip_reason", skip_reason(config))


def indexable(files: DataFrame, config: Config) -> DataFrame:
    return classify(files, config).where("skip_reason is null").drop("skip_reason")


def skip_stats(files: DataFrame, config: Config) -> DataFrame:
    reasons = classify(files, config).select("path", F.coalesce("skip_reason", F.lit("indexed")).alias("reason"))
    return reasons.dropDuplicates(["path"]).groupBy("reason").agg(F.count("*").alias("n"))


def extension_tally(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("n"))


def should_index(path: str, config: Config) -> bool:
    """The same test for one path, for change events."""
    parts = path.split("/")
    ext = parts[-1].rpartition(".")[2].lower() if "." in parts[-1].lstrip(".") else ""
    inside = not config.include_dirs or any(path.startswith(d.rstrip("/") + "/") for d in config.include_dirs)
    return inside and not set(parts[:-1]) & set(config.exclude_dirs) and ext in config.include_extensions


def is_indexable_path(path: Column, config: Config) -> Column:
    """``should_index`` as a column."""
    name = F.element_at(F.split(path, "/"), -1)
    dotted = F.instr(F.regexp_replace(name, r"^\.+", ""), ".") > 0
    ext = F.when(dotted, F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return in_included_dir(path, config.include_dirs) & ~in_excluded_dir(path, config.exclude_dirs) & ext.isin(*config.include_extensions)


def resolve_in_root(path: str) -> str:
    """A relative path without upward steps; raises for any other."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"not below the root: {path}")
    return "/".join(p for p in path.split("/") if p not in ("", "."))
