"""Append-only logs: transaction numbers, uncommitted tails, fail-stop replay and carried context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _log(keys: list[str], at: str):
    return Window.partitionBy(*keys).orderBy(at)


def transactions(log: DataFrame, keys: list[str], at: str, commit: Column) -> DataFrame:
    """log with txn: one more than the commits before; a commit keeps the number of what it ends."""
    before = _log(keys, at).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("txn", (F.coalesce(F.sum(F.when(commit, 1).otherwise(0)).over(before), F.lit(0)) + 1).cast("long"))


def uncommitted(log: DataFrame, keys: list[str], at: str, commit: Column, partial: Column | None = None) -> DataFrame:
    """Rows after the last commit of their log; all rows of a log without one.  A log read in part has no known tail."""
    last = F.max(F.when(commit, F.col(at))).over(Window.partitionBy(*keys))
    read = log if partial is None else log.where(~F.coalesce(partial, F.lit(False)))
    return read.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(at) > F.col("__last"))).drop("__last")


def replayable(logs: DataFrame, databases: DataFrame, key: str) -> DataFrame:
    """logs (key, iteration) with `replayed` and `note`: a log written after another checkpoint than the database's isn't
    replayed; where either is unknown, it is."""
    both = logs.join(databases.select(key, F.col("iteration").alias("__now")), key, "left")
    other = F.coalesce(F.col("iteration") != F.col("__now"), F.lit(False))
    note = F.when(other, F.concat(F.lit("written after checkpoint "), F.col("iteration").cast("string"), F.lit(", the database is at "), F.col("__now").cast("string")))
    return both.withColumn("replayed", ~other).withColumn("note", note).drop("__now")


def replayed(log: DataFrame, keys: list[str], at: str, damaged: Column) -> DataFrame:
    """log up to and with its first damaged row, with its state: ok or damaged; what follows is never read."""
    first = F.min(F.when(damaged, F.col(at))).over(Window.partitionBy(*keys))
    marked = log.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(at) <= F.col("__first")))
    return marked.withColumn("state", F.when(F.col(at) == F.col("__first"), "damaged").otherwise("ok")).drop("__first")


def committed(log: DataFrame, keys: list[str], at: str, commit: Column, damaged: Column) -> DataFrame:
    """What a replay applies: the rows of transactions that end in a commit before the first damage."""
    sound = replayed(log, keys, at, damaged).where("state = 'ok'").drop("state")
    last = F.max(F.when(commit, F.col(at))).over(Window.partitionBy(*keys))
    return transactions(sound.withColumn("__last", last).where(F.col(at) <= F.col("__last")).drop("__last"), keys, at, commit)


def carried(log: DataFrame, keys: list[str], at: str, value: Column, out: str) -> DataFrame:
    """log with the latest value that is not null, the row's own included: a data entry's current table."""
    return log.withColumn(out, F.last(value, ignorenulls=True).over(_log(keys, at).rowsBetween(Window.unboundedPreceding, 0)))


def counts(log: DataFrame, keys: list[str], commit: Column, change: Column, incomplete: Column) -> DataFrame:
    return log.groupBy(*keys).agg(F.count_if(commit).alias("commits"), F.count_if(change).alias("changes"), F.count_if(incomplete).alias("incomplete"), F.count(F.lit(1)).alias("entries"))
