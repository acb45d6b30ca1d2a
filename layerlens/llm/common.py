"""Helpers shared by the operators: the cluster's shared folder, written tables, fixed-size filters and bound expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation rules: space, and tab to carriage return.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
#: So many keys at most are broadcast by a join; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Characters of text that a Python task works on at a time, and bits of the largest membership filter (16 MB).
SLICE_CHARS, FILTER_BITS = 4_000_000, 27
_BUCKET = 1 << 15  # bits of one of Spark's bitmaps

_ROOT = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or one of our own where that is unset and there
    is one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOT:
        _ROOT[app] = f"file:///tmp/checkpoints/layerlens-{uuid.uuid4().hex}"
    return _ROOT[app]


class Scratch:
    """A run's own folder in the shared one.  Tables written there cut the lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.read(df.schema, name)

    def read(self, schema, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes what is no longer read: the tables named, or the whole folder."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for at in [f"{self.path}/{name}" for name in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)

    def result(self, df: DataFrame, into: Scratch | None = None) -> DataFrame:
        """df as a table that stays, in another folder; this one goes."""
        out = (into or Scratch(self.spark, "result")).table(df, f"rows-{uuid.uuid4().hex}")
        self.drop()
        return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often and however deep in lambdas body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(frame: pd.DataFrame, column: str = "text") -> Iterator[pd.DataFrame]:
    """frame in parts of at most SLICE_CHARS characters, a row at least: what a task holds of its batch at a time."""
    group = (frame[column].str.len().cumsum().to_numpy(np.int64) if len(frame) else np.zeros(0, np.int64)) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(frame)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield frame.iloc[a:b]


def joined(parts: Iterator[pd.Series | pd.DataFrame], empty: pd.Series | pd.DataFrame) -> pd.Series | pd.DataFrame:
    parts = list(parts)
    return pd.concat(parts, ignore_index=True) if parts else empty


def cell(value: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash as a place in a filter."""
    return F.shiftrightunsigned(value, 64 - bits)


def filter_bits(count: int) -> int:
    return min(FILTER_BITS, max(16, (16 * count).bit_length()))


def membership(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits places that says which hashes may be there; never more than 16 MB, whatever the count.

    A full bitmap lets everything through: it saves work, and an exact join follows wherever the answer hangs on it.
    """
    at = cell(F.col(column), bits) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():
        begin = (r.bucket - 1) * (_BUCKET // 8)
        out[begin : begin + _BUCKET // 8] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return out


def may_hold(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def same(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join on columns that may be null, nulls equal; right is broadcast where its counted rows stay under a
    fixed bound, else both sides are shuffled."""
    few = right.select(*(F.col(c).alias(f"__{c}") for c in on)).distinct()
    if few.count() <= BROADCAST_KEYS:
        few = F.broadcast(few)
    condition = None
    for c in on:
        equal = left[c].eqNullSafe(few[f"__{c}"])
        condition = equal if condition is None else condition & equal
    return left.join(few, condition, how)
