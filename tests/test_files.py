import pytest
from pyspark.sql import functions as F

from layerlens.operators import catalog
from layerlens.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import duckdb

    d = tmp_path_factory.mktemp("db")
    con = duckdb.connect(str(d / "x.duckdb"))
    con.execute("CREATE TABLE t AS SELECT i, md5(i::VARCHAR) AS h FROM range(2000) r(i); CREATE VIEW v AS SELECT 1 AS one; CREATE SEQUENCE s; CREATE TABLE k (a INTEGER PRIMARY KEY, b VARCHAR NOT NULL)")
    for name, sql in {
        "tables": "SELECT database_name, schema_name, table_name, estimated_size FROM duckdb_tables()",
        "columns": "SELECT database_name, schema_name, table_name, column_name, column_index, data_type, is_nullable FROM duckdb_columns() WHERE NOT internal",
        "views": "SELECT database_name, schema_name, view_name, sql, internal FROM duckdb_views()",
        "sequences": "SELECT database_name, schema_name, sequence_name, sql FROM duckdb_sequences()",
        "constraints": "SELECT database_name, schema_name, table_name, constraint_type, constraint_text, constraint_column_names FROM duckdb_constraints()",
        "segments": "SELECT 'x' AS database_name, 'main' AS schema_name, 't' AS table_name, row_group_id, column_name, column_id, column_path, segment_type, start, count, compression, stats, has_updates, persistent, block_id, block_offset, NULL::VARCHAR AS segment_info, additional_block_ids FROM pragma_storage_info('t')",
    }.items():
        (d / "export" / name).mkdir(parents=True)
        con.execute(f"COPY ({sql}) TO '{d}/export/{name}/0.parquet'")
    con.close()
    (d / "y.duckdb.wal").write_bytes(b"\x64\x00rest")
    (d / "z.txt").write_bytes(b"hello")
    return d


def test_listing_and_kinds(spark, folder):
    got = {r.file.rsplit("/", 1)[1]: r for r in files.sniffed(spark, f"{folder}/*.duckdb*", f"{folder}/z.txt").collect()}
    assert {n: r.kind for n, r in got.items()} == {"x.duckdb": "database", "y.duckdb.wal": "wal", "z.txt": None}
    assert {r.file.rsplit("/", 1)[1]: r.size for r in files.listing(spark, f"{folder}/z.txt").collect()} == {"z.txt": 5}


def test_catalog_export(spark, folder):
    c = catalog.read(spark, f"{folder}/export")
    mine = {name: catalog.of_database(df, "x") for name, df in c.items()}
    assert c["metadata"].count() == 0 and c["indexes"].columns == ["database_name", "schema_name", "table_name", "index_name", "sql"]
    assert sorted(r.table_name for r in mine["tables"].collect()) == ["k", "t"]
    tables = catalog.table_columns(mine["tables"], mine["columns"], ["schema_name", "table_name"], "column_index", "column_name", "data_type", "is_nullable")
    assert {r.table_name: [tuple(x) for x in r.columns] for r in tables.collect()} == {"k": [("a", "INTEGER", False), ("b", "VARCHAR", False)], "t": [("i", "BIGINT", True), ("h", "VARCHAR", True)]}
    assert [r.view_name for r in catalog.visible_views(mine["views"]).collect()] == ["v"]
    assert [(r.table_name, r.index_name) for r in catalog.key_indexes(mine["indexes"], mine["constraints"]).collect()] == [("k", "PRIMARY KEY(a)")]
    paths = {tuple(r.path) for r in catalog.segments(mine["segments"]).collect()}
    assert {(0,), (0, 0), (1,), (1, 0)} <= paths
    required = catalog.not_null(mine["columns"], mine["constraints"].where("constraint_type = 'NOT NULL'"), ["table_name"], "constraint_column_names", "column_name")
    assert {(r.table_name, r.column_name) for r in required.where("required").collect()} >= {("k", "b")}


def test_problems_of_unknown_files(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None, None), (2, 5, 10, 3, True, True, None)], "k long, size long, alloc long, block_count long, checksum_ok boolean, opened boolean, message string")
    assert {r.k: r.problems for r in files.problems(rows).collect()} == {1: [], 2: ["cut off: 0 of 3 blocks are whole"]}
    none = files.picked(rows.limit(0).select("k", F.lit("a").alias("name"), F.lit(1).alias("at")), ["k"])
    assert none.count() == 0
