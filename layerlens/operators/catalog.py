"""Catalog relations: tables, columns, segments, views, indexes, sequences and metadata blocks of many databases at once.

They come from an export of each database's catalog, a folder with one Parquet dataset a relation; functions here filter,
type, join and order them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Columns of each relation, named as the catalog functions of the database name them.
RELATIONS = {
    "tables": "database_name string, schema_name string, table_name string, estimated_size long",
    "columns": "database_name string, schema_name string, table_name string, column_name string, column_index int, data_type string, is_nullable boolean",
    "segments": "database_name string, schema_name string, table_name string, row_group_id long, column_name string, column_id long, column_path string, segment_type string, start long, count long, compression string, stats string, has_updates boolean, persistent boolean, block_id long, block_offset long, segment_info string, additional_block_ids array<long>",
    "views": "database_name string, schema_name string, view_name string, sql string, internal boolean",
    "indexes": "database_name string, schema_name string, table_name string, index_name string, sql string",
    "constraints": "database_name string, schema_name string, table_name string, constraint_type string, constraint_text string, constraint_column_names array<string>",
    "sequences": "database_name string, schema_name string, sequence_name string, sql string",
    "metadata": "database_name string, block_id long, free_list array<long>",
}


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every relation of the export in folder; one that isn't there is empty, columns that aren't there are null."""
    return {name: _read(spark, f"{folder}/{name}", schema) for name, schema in RELATIONS.items()}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return held.select(*((F.col(f.name) if f.name in held.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))


def of_database(relation: DataFrame, name: str | Column) -> DataFrame:
    return relation.where(F.col("database_name") == name)


def in_order(relation: DataFrame, out: str, keys: list[str], *order: str) -> DataFrame:
    """relation with a number from 0 in catalog order within keys."""
    from layerlens.operators.relations import numbered

    return numbered(relation, keys, list(order), out)


def segments(rows: DataFrame) -> DataFrame:
    """Segments with their path as whole numbers: '[2, 0]' is the first part of column 2.  A path that can't be read is null."""
    return rows.withColumn("path", F.from_json("column_path", "array<int>")).drop("column_path")


def table_columns(tables: DataFrame, columns: DataFrame, keys: list[str], order: str, name: str, kind: str, nullable: str) -> DataFrame:
    """tables with `columns`, an array of (name, type, nullable) in order; columns without a table are left out."""
    one = F.struct(F.col(order).alias("at"), F.col(name).alias("name"), F.col(kind).alias("type"), F.coalesce(nullable, F.lit(True)).alias("nullable"))
    held = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("columns"))
    plain = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["nullable"].alias("nullable")))
    return tables.join(held, keys, "left").withColumn("columns", F.coalesce(plain, F.array()))


def by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of left with the n-th of right, within keys; what one side lacks is null."""
    from layerlens.operators.relations import numbered

    return numbered(left, keys, left_order, "position").join(numbered(right, keys, right_order, "position"), [*keys, "position"], "full")


def visible_views(views: DataFrame) -> DataFrame:
    return views.where(~F.coalesce("internal", F.lit(False))).drop("internal")


def key_indexes(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes, and the primary key and unique constraints, which keep one too; a constraint goes by its text."""
    keys = constraints.where(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE"))
    named = keys.select("database_name", "schema_name", "table_name", F.col("constraint_text").alias("index_name"), F.col("constraint_text").alias("sql"))
    return indexes.select("database_name", "schema_name", "table_name", "index_name", "sql").unionByName(named)


def not_null(columns: DataFrame, constraints: DataFrame, keys: list[str], names: str, name: str) -> DataFrame:
    """columns with `required`: some constraint of their table (keys, an array of names) is on them."""
    held = constraints.select(*keys, F.explode(names).alias(name)).distinct().withColumn("required", F.lit(True))
    return columns.join(held, [*keys, name], "left").withColumn("required", F.coalesce("required", F.lit(False)))
