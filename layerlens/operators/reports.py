"""Reports on columns, row groups and pieces: rows that a viewer or a dashboard shows as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from layerlens.functions import text
from layerlens.operators import zonemap


def column_report(chunks: DataFrame, keys: list[str], at: str = "rg") -> DataFrame:
    """One row a column: bytes, share of all bytes in its table, compressions, order of its row groups, groups, missing, low,
    high.

    chunks: the last of keys names the column, the others its table; rg, bytes, compression, low, high, has_null.
    """
    bound = chunks.select(*keys, at, "low", "high", "has_null")
    sums = chunks.groupBy(*keys).agg(F.sum("bytes").cast("long").alias("bytes"), F.sort_array(F.collect_set("compression")).alias("compressions"))
    whole = Window.partitionBy(*keys[:-1]) if keys[1:] else Window.partitionBy(F.lit(0))
    out = sums.join(zonemap.merged(bound, keys), keys).join(zonemap.order_of(bound, keys, at), keys)
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("bytes").cast("double"), F.sum("bytes").over(whole).cast("double")), F.lit(0.0)))


def chunk_rows(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row a row group's column: stored and constant segments, compressions, nulls, bytes, and the bounds over them.

    segments: stored (it has bytes of its own), compression, bytes, low, high, has_null; unknown nulls don't count.
    """
    stored = F.coalesce("stored", F.lit(False))
    whole = lambda c, f: F.when(F.count(F.lit(1)) == F.count(c), f(c))
    return segments.groupBy(*keys).agg(
        F.count_if(stored).alias("stored"), F.count_if(~stored).alias("constant"), F.sort_array(F.collect_set("compression")).alias("compressions"),
        F.coalesce(F.bool_or("has_null"), F.lit(False)).alias("has_null"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), whole("low", F.min).alias("low"), whole("high", F.max).alias("high"),
    )


def row_groups(chunks: DataFrame, table: list[str], rg: str, rows: str) -> DataFrame:
    """One row a row group: rows, bytes, columns, and its size as a share of the largest of its table."""
    groups = chunks.groupBy(*table, rg).agg(F.max(rows).cast("long").alias("rows"), F.sum("bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("columns"))
    most = F.greatest(F.lit(1), F.max("bytes").over(Window.partitionBy(*table)))
    return groups.withColumn("of_largest", F.col("bytes").cast("double") / most)


def present_kinds(pieces: DataFrame, keys: list[str]) -> DataFrame:
    return pieces.select(*keys, "kind").distinct()


def read_order(blocks: DataFrame, keys: list[str], shared: str, block: str) -> DataFrame:
    """Blocks in the order they are worth reading in: those most segments share first."""
    return blocks.withColumn("turn", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(shared), block)) - 1).cast("long"))


def in_path_order(segments: DataFrame, keys: list[str], path: str, start: str) -> DataFrame:
    """Segments by depth, then path, then start: a column's values before its parts."""
    order = Window.partitionBy(*keys).orderBy(F.size(path), path, start)
    return segments.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))


def first_match(rows: DataFrame, keys: list[str], hit: Column, at: str, value: str) -> DataFrame:
    """keys and the value of their first row that is hit, by at; null where none is."""
    return rows.groupBy(*keys).agg(F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col(at))).alias(value))


def _where() -> Column:
    block = F.concat(F.lit("block "), F.col("block").cast("string"))
    return F.when(F.col("kind") == "mainHeader", "start of file").when(F.col("kind") == "tail", "end of file").when(F.col("kind") == "dbHeader", F.concat(F.lit("header at "), text.format_number(F.col("start")))).when(F.col("qualified").isNotNull(), F.concat(F.col("qualified"), F.lit(" row group "), F.col("rg").cast("string"))).otherwise(block)


def describe(pieces: DataFrame, keys: list[str], file_size: Column) -> DataFrame:
    """(keys, place, label, value): what there is to say of each piece, one row a line.

    pieces: kind, start, end, block, extent, shared, qualified, rg, first_row, count, compression, segment_type, low, high,
    has_null, block_offset, from, to; what a kind lacks is null and gives no line.
    """
    size, of = F.col("end") - F.col("start"), lambda *kinds: F.col("kind").isin(*kinds)
    held, meta, plain = of("segment", "validity"), of("metadata", "metadataFree"), lambda c: F.col(c).cast("string")
    sized = F.when(F.col("extent") == "blockEnd", F.concat(F.lit("up to "), text.format_bytes(size))).when(F.col("extent") == "measured", F.concat(text.format_bytes(size), F.lit(" measured"))).otherwise(F.concat(text.format_bytes(size), F.lit(" · "), text.percent(size, file_size), F.lit(" of file")))
    subs = F.concat(F.when(F.col("from") == F.col("to"), plain("from")).otherwise(F.concat_ws("–", plain("from"), plain("to"))), F.lit(" of 64"))
    lines = {
        "Where": _where(),
        "Bytes": F.concat_ws(" – ", text.format_number(F.col("start")), text.format_number(F.col("end"))),
        "Size": sized,
        "Rows": F.when(held, text.row_range(F.col("first_row"), F.col("count"))),
        "Compression": F.when(held | of("overflow"), F.col("compression")),
        "Type": F.when(of("segment"), F.col("segment_type")),
        "min": F.when(held, F.col("low")),
        "max": F.when(held, F.col("high")),
        "NULLs": F.when(held & F.col("has_null").isNotNull(), F.when(F.col("has_null"), "some").otherwise("none")),
        "Block": F.when(held, F.concat(plain("block"), F.lit(" · offset "), text.format_number(F.col("block_offset")))).otherwise(plain("block")),
        "Shared": F.when(held & (F.col("shared") > 1), F.concat(F.lit("with "), text.plural(F.col("shared") - 1, "other segment"))),
        "Sub-blocks": F.when(meta, subs),
    }
    each = F.array(*(F.struct(F.lit(i).cast("long").alias("place"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(lines.items())))
    return pieces.select(*keys, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("x")).select(*keys, "x.*")
