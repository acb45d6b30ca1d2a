"""Zone maps: bounds of row groups, their order, positions and fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_GROUP = 122_880


def bounds(df: DataFrame, group: Column, columns: dict[str, Column]) -> DataFrame:
    """(rg, column, rows, low, high, has_null) of each row group and column, as doubles.

    One aggregation over the table gives every column's bounds; only its result, a row a group, is unpivoted.  A group of
    nulls alone has no bounds.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, c in columns.items():
        aggs += [F.min(c.cast("double")).alias(f"{name}__low"), F.max(c.cast("double")).alias(f"{name}__high"), F.bool_or(c.isNull()).alias(f"{name}__null")]
    wide = df.groupBy(group.cast("long").alias("rg")).agg(*aggs)
    each = [F.struct(F.lit(n).alias("column"), F.col(f"{n}__low").alias("low"), F.col(f"{n}__high").alias("high"), F.col(f"{n}__null").alias("has_null")) for n in columns]
    return wide.select("rg", "rows", F.explode(F.array(*each)).alias("x")).select("rg", "x.column", "rows", "x.low", "x.high", "x.has_null")


def merged(bound: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds over several groups: null if there are none or any group lacks them; has_null ignores unknowns."""
    whole = lambda c, f: F.when(F.count(F.lit(1)) == F.count(c), f(c))
    return bound.groupBy(*keys).agg(whole("low", F.min).alias("low"), whole("high", F.max).alias("high"), F.bool_or("has_null").alias("has_null"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("low").isNull()).alias("missing"))


def order_of(bound: DataFrame, keys: list[str], at: str = "rg") -> DataFrame:
    """keys, order: missing, single, constant, sorted or overlapping, in that precedence.

    Sorted: each group's low is not under the high of the one before; equal edges count.  Constant: all bounds are one value.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    steps = bound.withColumn("ok", F.col("low") >= F.lag("high").over(w))
    verdict = steps.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > F.count("low"), "missing")
        .when(F.count(F.lit(1)) == 1, "single")
        .when(F.min("low") == F.max("high"), "constant")
        .when(F.bool_and(F.coalesce("ok", F.lit(True))), "sorted")
        .otherwise("overlapping")
        .alias("order")
    )
    return verdict


def positions(bound: DataFrame, keys: list[str], value: str = "low") -> DataFrame:
    """Where each value lies between the least and the greatest of keys, 0 to 1; 0 where all are equal."""
    whole = Window.partitionBy(*keys)
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    return bound.withColumn("position", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.when(F.col(value).isNotNull(), 0.0)))


def rank_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For text: dense rank less one, over the number of distinct values less one; 0 where there is one."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1
    ranked = df.withColumn("rank", rank)
    return ranked.withColumn("position", F.coalesce(F.try_divide(F.col("rank").cast("double"), F.max("rank").over(Window.partitionBy(*keys)).cast("double")), F.lit(0.0)))


def ragged(groups: DataFrame, keys: list[str], at: str, rows: str, full: int = ROW_GROUP) -> DataFrame:
    """Groups other than the last of keys with fewer rows than full."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc()))
    return groups.withColumn("__back", last).where((F.col("__back") > 1) & (F.col(rows) < full)).drop("__back")


def group_rows(storage: DataFrame, keys: list[str], column: str, count: str) -> DataFrame:
    """Rows of a row group: the greatest over columns of the column's summed segment counts, 0 at least."""
    return storage.groupBy(*keys, column).agg(F.sum(count).alias("n")).groupBy(*keys).agg(F.greatest(F.lit(0), F.max("n")).cast("long").alias("rows"))


def skippable(bound: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """How many row groups a filter on [low, high] could skip by their bounds."""
    out = F.col("low").isNotNull() & ((F.col("high") < low) | (F.col("low") > high))
    return bound.groupBy(*keys).agg(F.count_if(out).alias("skipped"), F.count(F.lit(1)).alias("groups"))


def spans(bound: DataFrame, keys: list[str]) -> DataFrame:
    """Where each group's bounds lie between the least and the greatest of keys, 0 to 1; null where all are equal.  The range
    is one small row a key, joined back."""
    whole = bound.groupBy(*keys).agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
    both = bound.join(whole, keys) if keys else bound.crossJoin(F.broadcast(whole))  # one row
    at = lambda c: F.try_divide(F.col(c) - F.col("__low"), F.when(F.col("__high") != F.col("__low"), F.col("__high") - F.col("__low")))
    return both.withColumn("from_share", at("low")).withColumn("to_share", at("high")).drop("__low", "__high")
