"""The corpus pipeline: from raw documents to packed token sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, same, text_of
from layerlens.llm.dedup import exact_dedup, normalised, sha256
from layerlens.llm.jaccard import jaccard_classes
from layerlens.llm.packing import pack_documents
from layerlens.llm.quality import quality_verdicts
from layerlens.llm.queries import vocabulary
from layerlens.llm.secrets import scan_secrets

#: Packing needs the tokenizer, which SQL doesn't have; a brute-force version is in the tests.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no quality rule rejects.  Null and empty texts go; repeated rows share a verdict; no rows give none."""
    return quality_verdicts(docs).where("kept").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose normalised texts are equal, one with the smallest id.

    Rows are told apart by id and text, so two texts under one id both stay.  Of rows that repeat both, the one with the
    smallest other columns stays; a text without any id counts as one document; no rows give none.
    """
    found = exact_dedup(docs)
    key = ["doc_id", "digest"]
    keyed = docs.withColumn("digest", sha256(normalised(text_of("text")))) if "digest" not in docs.columns else docs.withColumnRenamed("digest", "__digest").withColumn("digest", sha256(normalised(text_of("text"))))
    rest = same(keyed, found.where("not kept"), key, "left_anti")
    again = found.where("kept").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    if again.take(1):
        whole = F.struct(*(F.col(f"`{c}`") for c in keyed.columns))
        one = same(rest, again, key, "left_semi").groupBy(*key).agg(F.min(whole).alias("row")).select("row.*")
        rest = same(rest, again, key, "left_anti").unionByName(one)
    rest = rest.drop("digest").withColumnRenamed("__digest", "digest")
    return rest.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of equal 4-word shingles at 0.85, the one with the smallest id.

    Rows of one id are one document and stay together where it stays; a row without an id goes if its shingles equal those
    of a document with one; texts without words stay; no rows give none.
    """
    gone = jaccard_classes(docs).where("component_id is not null and not doc_id <=> component_id").select("doc_id", F.col("text_key").alias("__text_key"))
    return same(docs.withColumn("__text_key", F.xxhash64(text_of("text"))), gone, ["doc_id", "__text_key"], "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secret values masked in the text, and n_chars of the new text; null texts stay null."""
    found = scan_secrets(docs)
    text = F.coalesce(F.col("secrets")["redacted"], F.col("text"))
    masked = found.withColumn("n_chars", F.when(F.col("secrets")["redacted"].isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return masked.withColumn("text", text).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in sequences of at most 2048 tokens; a null text is one piece."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder before the next reads it; what a stage has read goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        work = Scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        docs = work.table(stage(spark, docs, sf_dir), "rows")
        if before:
            before.drop()
        before = work
    return docs
