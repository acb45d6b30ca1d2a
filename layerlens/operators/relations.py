"""Lookups, rollups and set operations over catalog relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rollup_sizes(df: DataFrame, levels: list[str], size: str) -> DataFrame:
    """Sizes of every level and the total, with the level's depth."""
    grouped = df.rollup(*levels).agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("parts"), F.grouping_id().alias("__g"))
    depth = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin("__g"), "0", ""))
    return grouped.withColumn("depth", depth.cast("long")).drop("__g")


def with_default(df: DataFrame, names: DataFrame, on: list[str], name: str, default: Column) -> DataFrame:
    """df with names looked up, default where there is none."""
    return df.join(names, on, "left").withColumn(name, F.coalesce(F.col(name), default))


def lookup(column: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small fixed dimension as a map."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(pairs[column], default if default is not None else column)


def display_paths(columns: DataFrame, schema: str, table: str, column: str) -> DataFrame:
    """The bare column name if there is one table only, in schema main; else schema.table.column."""
    tables = columns.select(schema, table).distinct().agg(F.count(F.lit(1)).alias("__tables"), F.min(schema).alias("__schema"))
    bare = (F.col("__tables") == 1) & (F.col("__schema") == "main")
    return columns.crossJoin(F.broadcast(tables)).withColumn("path", F.when(bare, F.col(column)).otherwise(F.concat_ws(".", schema, table, column))).drop("__tables", "__schema")


def numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def shares(df: DataFrame, keys: list[str], order: list, size: str) -> DataFrame:
    """Where each part of a stacked bar starts and ends, 0 to 1; 0 for an empty bar."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(size).over(Window.partitionBy(*keys))
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), total.cast("double")), F.lit(0.0))
    return df.withColumn("from_share", share(upto - F.col(size))).withColumn("to_share", share(upto))


def best_of(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each group; the smallest tie wins."""
    return df.groupBy(*keys).agg(F.max_by(tie, F.struct(F.col(value), -F.col(tie))).alias(tie), F.max(value).alias(value))


def encoded(df: DataFrame, value: str, letters: int = 3) -> tuple[DataFrame, DataFrame]:
    """Dictionary encoding of a text column: df with code instead of value, and the dictionary (code, value), codes in value
    order.

    Distinct values are numbered within their first letters; only one row for each beginning meets in one task, for offsets.
    """
    words = df.select(value).where(F.col(value).isNotNull()).distinct().withColumn("__head", F.substring(value, 1, letters))
    sizes = words.groupBy("__head").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    codes = words.withColumn("__at", F.row_number().over(Window.partitionBy("__head").orderBy(value)) - 1).join(sizes.withColumn("__before", before).drop("__n"), "__head")
    codes = codes.select(value, (F.col("__before") + F.col("__at")).cast("long").alias("code"))
    return df.join(codes, value, "left").drop(value), codes


def first_names(df: DataFrame, keys: list[str], name: str, limit: int = 8) -> DataFrame:
    """keys, names (the first `limit` distinct ones), n (how many there are); ranks are cut in each task before the shuffle."""
    names = df.select(*keys, name).where(F.col(name).isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
    few = names.withColumn("__rank", rank).where(F.col("__rank") <= limit).groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias("names"))
    return names.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(few, keys)


def decoded(df: DataFrame, codes: DataFrame) -> DataFrame:
    return df.join(codes, "code", "left").drop("code")


def exists_flags(df: DataFrame, keys: list[str], **flags: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()))
