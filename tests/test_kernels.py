import time

from pyspark.sql import functions as F

from layerlens.functions import text
from layerlens.operators import checks, checksum, intervals, layout, logs, relations, zonemap


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_checksum_matches_words(spark):
    words = [0, 1, 2, 12_345_678_901, (1 << 63) - 1, -1, -(1 << 63), -987_654_321]
    signed = lambda x: (x & ((1 << 64) - 1)) - (1 << 64) * ((x >> 63) & 1)
    got = {r.w: r.p for r in spark.createDataFrame([(w,) for w in words], "w long").select("w", checksum.product(F.col("w")).alias("p")).collect()}
    assert got == {w: signed(w * checksum.FACTOR) for w in words}
    folded = checksum.SEED
    for w in words:
        folded ^= signed(w * checksum.FACTOR)
    assert spark.createDataFrame([(w,) for w in [*words, None]], "w long").agg(checksum.checksum(F.col("w"))).first()[0] == folded


def test_numbers_of_six_digits(spark):
    values = {"0.1": "0.1", "123456.789": "123457", "1234567.5": "1234570", "-0.0": "0", "3.0": "3", "1e-7": "1e-7", "2.5e22": "25,000,000,000,000,000,000,000", "0.000012345678": "0.0000123457", "nan": "nan", None: "–"}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.format_value(F.col("v"), F.lit("float")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == values


def test_large_shares(spark):
    assert one(spark, text.percent(F.lit(1 << 61), F.lit((1 << 62) + 1)), text.percent(F.lit(1), F.lit(0)), text.percent(F.lit(0), F.lit(5))) == ("50.0%", "0.0%", "0.00%")


def test_files_of_many_blocks(spark):
    files = spark.createDataFrame([("a", 3), ("b", 200_001), ("c", 0)], "file string, n long")
    got = layout.block_numbers(files, F.lit(0), F.col("n") - 1).groupBy("file").agg(F.count("*"), F.min("block"), F.max("block"), F.countDistinct("block"))
    assert rows(got, "file") == [("a", 3, 0, 2, 3), ("b", 200_001, 0, 200_000, 200_001)]


def test_dates_times_and_values(spark):
    L = lambda x: F.lit(x).cast("long")
    assert one(spark, text.date_text(L(0)), text.date_text(L(-719_528)), text.date_text(L(-719_529)), text.date_text(L(2_147_483_647))) == ("1970-01-01", "0001-01-01 (BC)", "0002-12-31 (BC)".replace("0002", "0002"), "infinity")
    assert one(spark, text.time_text(L(3_661_500_000), 6), text.timestamp_text(L(-1), 6), text.decimal_text(L(-5), 2)) == ("01:01:01.5", "1969-12-31 23:59:59.999999", "-0.05")
    assert one(spark, text.interval_text(L(-13), L(1), L(0)), text.interval_text(L(0), L(0), L(0))) == ("-1 year -1 month 1 day", "00:00:00")
    assert one(spark, text.uuid_text(F.lit("80000000000000000000000000000001")), text.blob_text(F.lit(b"a\\\x00")), text.blob_text(F.lit(b""))) == ("00000000-0000-0000-0000-000000000001", "a\\x5C\\x00", "")
    assert one(spark, text.format_value(F.lit("-0"), F.lit("integer")), text.format_value(F.lit("1234567"), F.lit("integer")), text.format_value(F.lit('a"b'), F.lit("text")), text.format_value(F.lit(None).cast("string"), F.lit("text"))) == ("0", "1,234,567", '"a\\"b"', "–")


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "k long, at long, v long")
    assert intervals.islands(none, ["k"], "at").count() == 0
    assert intervals.global_islands(none, "at").count() == 0
    assert logs.transactions(none, ["k"], "at", F.col("v") == 1).count() == 0
    assert zonemap.order_of(spark.createDataFrame([], "c string, rg long, low double, high double"), ["c"]).count() == 0
    missing = spark.createDataFrame([("a", 0, None, None, None), ("a", 1, 1.0, 2.0, True)], "c string, rg long, low double, high double, has_null boolean")
    assert rows(zonemap.order_of(missing, ["c"]), "c") == [("a", "missing")]
    merged = zonemap.merged(missing, ["c"]).first()
    assert (merged.low, merged.has_null, merged.missing) == (None, True, 1)


def test_islands_cross_buckets(spark):
    ids = spark.createDataFrame([(x,) for x in [*range(5, 40), 50, 51, 64, 100, 100]], "x long")
    for levels in (1, 2, 3):
        assert rows(intervals.global_islands(ids, "x", 16, levels), "first") == [(5, 39, 35), (50, 51, 2), (64, 64, 1), (100, 100, 1)]


def test_layout_of_a_file(spark):
    files = spark.createDataFrame([("f", 1000, 4, 12_288 + 4 * 1000 + 7, True)], "file string, alloc long, block_count long, file_size long, opened boolean")
    storage = spark.createDataFrame([("f", 0, 0, "DATA", True, []), ("f", 0, 100, "VALIDITY", True, [1]), ("f", -1, 0, "DATA", True, [])], "file string, block long, block_offset long, segment_type string, persistent boolean, additional_blocks array<long>")
    meta = spark.createDataFrame([("f", 2, [3])], "file string, block long, free array<int>")
    free = spark.createDataFrame([("f", 3)], "file string, block long")
    used = spark.createDataFrame([("f", 0, 150)], "file string, block long, used long")
    got = rows(layout.layout(files, storage, meta, free, used).select("kind", "start", "end"), "start", "end")
    assert got[:3] == [("mainHeader", 0, 4096), ("dbHeader", 4096, 8192), ("dbHeader", 8192, 12_288)]
    assert ("segment", 12_296, 12_396) in got and ("validity", 12_396, 12_446) in got and ("slack", 12_446, 13_288) in got
    assert ("overflow", 13_296, 14_288) in got and ("free", 15_288, 16_288) in got and ("tail", 16_288, 16_295) in got
    assert sum(k == "metadata" for k, _, _ in got) == 2 and sum(k == "metadataFree" for k, _, _ in got) == 1


def test_checks_pass_on_nothing_unknown(spark):
    files = spark.createDataFrame([("f", None, 100, None, None)], "file string, free_bytes long, file_size long, wal_size long, has_updates boolean")
    assert [r.passed for r in checks.report(checks.compact_check(files), checks.checkpointed_check(files)).collect()] == [True, True]


def test_display_path_of_a_single_table(spark):
    c = spark.createDataFrame([("main", "t", "a"), ("main", "t", "b")], "s string, t string, c string")
    assert [r.path for r in relations.display_paths(c, "s", "t", "c").orderBy("c").collect()] == ["a", "b"]


def test_sizes_of_any_long(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 10_239: "10.0 KB", 10_240: "10 KB", 104_857_599: "100.0 MB", 79_137_000_000_000_000: "73702074.59 GB", (1 << 63) - 1: "8589934592.00 GB"}
    rows_ = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.format_bytes(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows_} == sizes
    for n in range(1 << 30, 1 << 62, (1 << 62) // 40):
        scaled = (n * 200 + (1 << 30)) // (2 << 30)
        assert one(spark, text.format_bytes(F.lit(n))) == (f"{scaled // 100}.{scaled % 100:02d} GB",)


def test_measured_ends_past_the_limit(spark):
    items = spark.createDataFrame([(1, 5), (1, 30), (2, 30), (3, 5)], "k long, at long")
    got = intervals.extents(items, ["k"], "at", "at", F.lit(10).cast("long"), F.when(F.col("k") != 2, F.lit(0).cast("long")))
    assert rows(got.select("k", "at", "end", "extent", "slack"), "k", "at") == [(1, 5, 30, "next", 0), (1, 30, 31, "measured", -21), (2, 30, 10, "blockEnd", 0), (3, 5, 6, "measured", 4)]


def test_islands_of_a_large_key_are_found_in_buckets(spark):
    far = 1 << 60
    numbers = {"a": [-70_000, *range(-5, 3), *range(65_530, 65_540), 131_071, 131_072, far, far + 1], "b": [*range(0, 200_001), 7, 7], "c": [3, 3]}
    ids = spark.createDataFrame([(k, x) for k, v in numbers.items() for x in v], "k string, x long").unionByName(spark.createDataFrame([("d", None)], "k string, x long"))
    got = intervals.islands(ids, ["k"], "x")
    want = [("a", -70_000, -70_000, 1), ("a", -5, 2, 8), ("a", 65_530, 65_539, 10), ("a", 131_071, 131_072, 2), ("a", far, far + 1, 2), ("b", 0, 200_000, 200_001), ("c", 3, 3, 1)]
    assert rows(got, "k", "first") == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("__bucket" in line for line in plan.splitlines() if "Window" in line and "lag(first" in line), plan
    for width in (16, 1000):
        for levels in (1, 2, 3):
            assert rows(intervals.islands(ids, ["k"], "x", width, levels), "k", "first") == want


def test_states_of_pieces_equal_those_of_their_blocks(spark):
    pieces = spark.createDataFrame([("a", 1, "free", None), ("a", 1, "segment", 3), ("a", 2, "metadata", 9), ("b", 1, "header", None), ("b", 1, "validity", 2), (None, 4, "free", 1), ("b", 5, "header", 1)], "file string, block long, kind string, shared long")
    blocks = pieces.select("file", "block").distinct().where("file is not null")
    got = layout.piece_states(pieces, ["file", "block"]).select("file", "block", "state", "segments")
    assert rows(got.where("file is not null"), "file", "block") == rows(layout.block_states(blocks, pieces, ["file", "block"]).select("file", "block", "state", "segments"), "file", "block")
    assert rows(got.where("file is null"), "block") == [(None, 4, "free", 0)]
    assert layout.piece_states(pieces.limit(0), ["file", "block"]).count() == 0


def test_hex_lines_read_a_text_once(spark):
    """The bytes of a long text are made once, not once for each byte shown."""
    long = spark.range(24).coalesce(1).select(F.repeat(F.concat(F.lit("aé\x00~"), F.col("id").cast("string")), F.lit(600_000)).alias("t"))
    began = time.perf_counter()
    got = long.select(text.hex_lines(F.encode(F.col("t"), "UTF-8")).alias("x")).collect()
    assert time.perf_counter() - began < 30
    assert [len(r.x) for r in got] == [32] * 24 and tuple(got[0].x[1]) == ("00000010", "7e 30 61 c3 a9 00 7e 30 61 c3 a9 00 7e 30 61 c3", "~0a···~0a···~0a·")
    edges = spark.createDataFrame([(b"",), (None,), (bytes(range(256)) * 3,), (b"a" * 17,)], "b binary").select(text.hex_lines(F.col("b")).alias("x")).collect()
    assert [len(r.x) for r in edges] == [0, 0, 32, 2]
    whole = bytes(range(256)) * 2
    assert [tuple(x) for x in edges[2].x] == [(f"{i:08x}", whole[i : i + 16].hex(" "), "".join(chr(b) if 32 <= b < 127 else "·" for b in whole[i : i + 16])) for i in range(0, 512, 16)]
    assert tuple(edges[3].x[1]) == ("00000010", "61", "a")
