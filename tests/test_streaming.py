from layerlens.streaming.log_tail import committed_stream


def test_each_transaction_comes_once(spark, tmp_path):
    schema = "log string, at long, entry string, kind string"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = committed_stream(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("log string, txn long, at long, entry string").parquet(out).collect()))

    assert add([("a", 1, "x", "entry"), ("b", 1, "p", "entry"), ("b", 2, "c", "commit")]) == [("b", 1, 1, "p"), ("b", 1, 2, "c")]
    got = add([("a", 2, "y", "entry"), ("a", 3, "c", "commit"), ("a", 4, "z", "entry"), ("b", 3, "q", "damaged"), ("b", 4, "r", "entry"), ("b", 5, "c", "commit")])
    assert got == [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 1, 3, "c"), ("b", 1, 1, "p"), ("b", 1, 2, "c")]
