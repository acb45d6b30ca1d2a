"""Files as relations: what there is, what it is by its first bytes, which belong together, and what is wrong with them.

Files come from Spark's binaryFile reader, so any store that Spark reads will do.  Listing reads no content; sniffing reads
whole files, of at most 2 GB each, since the reader has no ranges.  The pages inside a file are another engine's format and
aren't decoded: layout and log functions take relations that an export of that engine's catalog gives, see `catalog`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.functions import text

#: Fixed values of the file formats: magic bytes, where a file's blocks start.
DATABASE_MAGIC, DATABASE_AT, LOG_MAGIC = b"DUCK", 8, b"\x64\x00"
BLOCKS_START = 12_288


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """file, size and modified of the files; their content isn't read.  The reader leaves empty files out."""
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def kind_of(content: Column) -> Column:
    """database, wal or null, by the first bytes."""
    magic = F.substring(content, DATABASE_AT + 1, len(DATABASE_MAGIC)) == F.lit(DATABASE_MAGIC)
    return F.when(magic, "database").when(F.substring(content, 1, len(LOG_MAGIC)) == F.lit(LOG_MAGIC), "wal")


def sniffed(spark: SparkSession, *paths: str) -> DataFrame:
    """file, size and kind."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), kind_of(F.col("content")).alias("kind"))


def picked(files: DataFrame, keys: list[str], name: str = "name", at: str = "at") -> DataFrame:
    """keys, database, log of each selection: the first file that isn't a log by its name; the log beside it, else the first.

    Null where there is none; `at` orders a selection.
    """
    is_log = F.col(name).endswith(".wal")
    first = lambda hit: F.min_by(F.when(hit, F.col(name)), F.when(hit, F.col(at)))
    bases = files.groupBy(*keys).agg(first(~is_log).alias("database"), first(is_log).alias("any_log"))
    beside = files.join(bases.select(*keys, "database"), keys).where(F.col(name) == F.concat("database", F.lit(".wal"))).select(*keys, F.col(name).alias("beside")).distinct()
    return bases.join(beside, keys, "left").select(*keys, "database", F.coalesce("beside", "any_log").alias("log"))


def problems(files: DataFrame) -> DataFrame:
    """files with `problems`, an array of texts, empty for a sound file.

    files: size, alloc, block_count, checksum_ok, opened, message; nulls are unknown and no problem.
    """
    expected = BLOCKS_START + F.col("block_count") * F.col("alloc")
    whole = F.greatest(F.lit(0), F.floor((F.col("size") - BLOCKS_START) / F.col("alloc"))).cast("long")
    cut = F.when(F.col("size") < expected, F.concat(F.lit("cut off: "), whole.cast("string"), F.lit(" of "), text.plural(F.col("block_count"), "block"), F.lit(" are whole")))
    torn = F.when(~F.col("checksum_ok"), "the active header fails its checksum")
    shut = F.when(~F.col("opened"), F.concat(F.lit("the catalog can't be read: "), F.coalesce("message", F.lit("no reason given"))))
    return files.withColumn("problems", F.array_compact(F.array(cut, torn, shut)))


def out_of_range(blocks: DataFrame) -> DataFrame:
    """blocks (block, block_count) with `problem` for numbers that the file has no block for; null where all is well."""
    bad = F.col("block").isNull() | (F.col("block") < 0) | (F.col("block") >= F.col("block_count"))
    return blocks.withColumn("problem", F.when(bad, F.concat(F.lit("no block "), F.coalesce(F.col("block").cast("string"), F.lit("null")), F.lit(" of "), F.col("block_count").cast("string"))))


def error_kind(message: Column, not_a_database: Column) -> Column:
    """cut off, not a database, unreachable, too new or other, by an error's text and whether the format check raised it."""
    cut = message.startswith("the file is cut off")
    return F.when(not_a_database & cut, "cut off").when(not_a_database, "not a database").when(message.rlike("(?i)fetch"), "unreachable").when(message.rlike("(?i)newer version of DuckDB|storage version"), "too new").otherwise("other")
