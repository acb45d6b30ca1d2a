"""Exact deduplication by a stateful stream whose keyed state lives on disk and never expires."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.llm.common import BLANK, Scratch, same, text_of

#: The state store of the stream: RocksDB on the executors' disks, changelogs in the shared checkpoint folder.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes megabytes ahead
}
#: Micro-batches the key log is replayed in at least, if it has the files: later ones find what earlier ones left.
BATCHES = 2


def normalised(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, f"[{BLANK}]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _replayed(work: Scratch, schema, files_per_trigger: int) -> DataFrame:
    """The stream over the key log: digest -> locator of the smallest id, size of its group."""
    spark, batches = work.spark, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work.path}/out/batch={number}")
        batches.append(number)

    with _settings(spark, STATE_STORE):
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{work.path}/keys")
        seen = log.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n_bytes")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{work.path}/state").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    found = "digest binary, first struct<none: boolean, id: long, n_bytes: long>, group_size long"
    if not batches:
        return spark.createDataFrame([], found)
    state_rows = spark.read.schema(found).parquet(*(f"{work.path}/out/batch={n}" for n in sorted(set(batches))))
    if len(set(batches)) > 1:  # a key comes again with each batch that touched it; its size only grows
        state_rows = state_rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))
    return state_rows


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """id, digest, n_bytes and the normalised text of each row."""
    text = normalised(text_of(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest; equal normalised texts form a group.

    Method: the narrow key log (digest, id, length) of the texts is written to the shared folder and replayed as a stream of
    micro-batches, `BATCHES` at least unless files_per_trigger says otherwise.  The stream's state holds, for each digest
    and without expiry, how often it came, the smallest id and the content locator (that id, by which the source table gives
    the text, and the length).  It is kept by RocksDB on disk, and partial aggregation before the shuffle keeps a group of
    any size to one row per task.

    Every digest that came more than once is then checked on full bytes: the texts of its rows, and no others while the
    digests are few enough to broadcast, are grouped as they are after partial aggregation, and a digest under which two
    texts hide is split by text.

    Defined results: a null text counts as empty; an empty table gives no rows; a null id never becomes keep_id while the
    group has an id, and is kept only where its group has none; repeated rows with one id share a verdict.  Other columns
    of docs, whatever their names, are not read.
    """
    work = Scratch(docs.sparkSession, "dedup")
    keyed = keyed_texts(docs, id_col, text_col, digest)
    keys = work.table(keyed.drop("text"), "keys")
    state = _replayed(work, keys.schema, files_per_trigger or max(1, -(-len(keys.inputFiles()) // BATCHES)))

    hits = work.table(state.where("group_size > 1").select("digest"), "hits")
    contents = same(keyed, hits, ["digest"], "left_semi").groupBy("digest", "text").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    split = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    verdict = keys.join(state.select("digest", F.col("first.id").alias("keep_id"), "group_size"), "digest").select("id", "keep_id", "group_size", "digest")
    split = work.table(split, "split")
    if split.take(1):  # two texts under one digest
        sound = verdict.join(split, "digest", "left_anti")
        parts = contents.join(split, "digest", "left_semi")
        verdict = sound.unionByName(keyed.join(split, "digest", "left_semi").join(parts, ["digest", "text"]).select("id", "keep_id", "group_size", "digest"))
    kept = verdict.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("id", id_col)
    return work.result(kept.select(id_col, "keep_id", "group_size", "kept", "digest"))
