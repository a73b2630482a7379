"""Incremental state: what changed, what vanished, and replacing rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.md5("content"))


def changeset(files: DataFrame, state: DataFrame) -> DataFrame:
    """``(path, status, hash)``: new, changed, deleted or same, from one full outer join on path."""
    new, old = hashed(files).select("path", F.col("hash").alias("new_hash")), state.select("path", F.col("hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") != F.col("old_hash"), "changed").otherwise("same")
    return new.join(old, "path", "full_outer").select("path", status.alias("status"), F.col("new_hash").alias("hash"))


def dirty(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Files to be indexed again: unknown, changed, or all if forced."""
    joined = hashed(files).join(state.select("path", F.col("hash").alias("stored")), "path", "left")
    return joined.where(F.lit(force) | ~F.col("hash").eqNullSafe(F.col("stored"))).drop("stored")


def stale(files: DataFrame, state: DataFrame) -> DataFrame:
    """Paths that are known but gone."""
    return state.join(files.select("path"), "path", "left_anti").select("path")


def replace_rows(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Rows of touched keys give way to the new ones."""
    gone = touched.select(F.col(touched.columns[0]).alias("_touched")).distinct()
    return old.join(gone, old[key] == F.col("_touched"), "left_anti").unionByName(new)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def without_consecutive(rows: DataFrame, partition: list[str], order: list[str], keys: list[str]) -> DataFrame:
    """Drops a row whose keys equal those of the row before it."""
    w = Window.partitionBy(*partition).orderBy(*order)
    same = None
    out = rows
    for k in keys:
        out = out.withColumn(f"_before_{k}", F.lag(k).over(w))
        one = F.col(k).eqNullSafe(F.col(f"_before_{k}"))
        same = one if same is None else same & one
    first = F.row_number().over(w) == 1
    return out.withColumn("_first", first).where(F.col("_first") | ~same).select(*rows.columns)


def prune(rows: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    wanted = keep.select(F.col("path").alias("_keep")).distinct()
    return rows.join(wanted, rows[key] == F.col("_keep"), "left_semi")


def pruned_count(rows: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """How many keys a prune removes."""
    wanted = keep.select(F.col("path").alias("_keep")).distinct()
    return rows.join(wanted, rows[key] == F.col("_keep"), "left_anti").agg(F.count_distinct(key).alias("pruned"))
