"""Upserts, deletes, change detection and statistics over tables without MERGE.

Each operator returns the new state as a DataFrame; the caller writes it to a new version of the
table. Of rows with equal keys the one that is last in the given order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`base` with the updates put in: a key of both has the row of the updates."""
    new = last_of(updates, keys, order)
    return new.unionByName(base.join(new.select(*keys), keys, "left_anti"))


def delete_matching(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in `gone`."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges neither end of which is among the (project, qn) of `gone`."""
    out = gone.select("project", F.col("qn").alias("src")).distinct()
    return edges.join(out, ["project", "src"], "left_anti").join(out.withColumnRenamed("src", "dst"), ["project", "dst"], "left_anti")


def versioned_upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """(key, version): a key of both counts up, a new one begins with 1, others stay."""
    new = updates.select(key).distinct().withColumn("_new", F.lit(1))
    joined = base.select(key, "version").join(new, key, "full")
    return joined.select(key, F.when(F.col("_new").isNull(), F.col("version")).otherwise(F.coalesce(F.col("version"), F.lit(0)) + 1).cast("int").alias("version"))


def changed_files(files: DataFrame) -> DataFrame:
    """file_id and whether the stored hash differs from the hash of the content; null content or hash counts as changed.

    Only hashes are shuffled; a redelivered file counts once.
    """
    return files.select("file_id", F.coalesce(F.sha2("content", 256) != F.col("content_hash"), F.lit(True)).alias("changed")).dropDuplicates(["file_id"])


def scan_statistics(files: DataFrame) -> DataFrame:
    """Per language: files, lines (newlines + 1) and characters of the contents; only these numbers are shuffled."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    rows = files.where("content is not null").select("file_id", "language", lines.alias("lines"), F.length("content").alias("size")).dropDuplicates(["file_id"])
    return rows.groupBy("language").agg(F.count("*").alias("file_count"), F.sum("lines").alias("total_lines"), F.sum("size").alias("total_size"))
