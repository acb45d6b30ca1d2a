"""Efficiency checks: one row each of label, passed, items and detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.functions import text
from layerlens.operators import relations, zonemap


def _check(df: DataFrame, label: str, passed: Column, hit: Column, name: Column) -> DataFrame:
    """One row: whether the check passes, how many names are hit, and the first of them.  Names are counted after a distinct,
    and only the first few meet in one row."""
    verdict = df.agg(passed.alias("passed"))
    names = relations.first_names(df.select(F.lit(label).alias("label"), F.when(hit, name).alias("name")), ["label"], "name")
    out = verdict.withColumn("label", F.lit(label)).join(names, "label", "left")  # one row each
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("label", "passed", n.alias("n_items"), F.coalesce(text.list_names(F.col("names"), F.col("n")), F.lit("")).alias("detail"))


def sorted_check(orders: DataFrame, column: str = "column") -> DataFrame:
    """Some column's row groups are in order."""
    return _check(orders, "Sorted", F.coalesce(F.bool_or(F.col("order") == "sorted"), F.lit(False)), F.col("order") == "sorted", F.col(column))


def compressed_check(storage: DataFrame, name: str) -> DataFrame:
    """No column has stored values that are uncompressed."""
    bad = (F.col("segment_type") != "VALIDITY") & (F.col("compression") == "Uncompressed") & (F.col("bytes") > 0)
    return _check(storage, "Compressed", F.count_if(bad) == 0, bad, F.col(name))


def full_groups_check(groups: DataFrame, keys: list[str], at: str, rows: str, full: int = zonemap.ROW_GROUP) -> DataFrame:
    """Only the last row group of a table may be short."""
    bad = zonemap.ragged(groups, keys, at, rows, full)
    return _check(bad, "Full row groups", F.count(F.lit(1)) == 0, F.lit(True), F.concat_ws(" ", *keys, F.col(at).cast("string")))


def compact_check(files: DataFrame) -> DataFrame:
    """At most a tenth of the files whose free list is known is free; unreadable ones pass and don't count."""
    known = F.when(F.col("free_bytes").isNotNull(), F.col("file_size"))
    ok = F.coalesce(F.sum("free_bytes") * 10 <= F.sum(known), F.lit(True))
    return _check(files, "Compact", ok, F.col("free_bytes") * 10 > F.col("file_size"), F.col("file"))


def checkpointed_check(files: DataFrame) -> DataFrame:
    """No log beside the file, and no pending updates in it."""
    bad = (F.coalesce("wal_size", F.lit(0)) > 0) | F.coalesce("has_updates", F.lit(False))
    return _check(files, "Checkpointed", F.count_if(bad) == 0, bad, F.col("file"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
