"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.llm import dedup, html, jaccard, licenses, packing, pii, quality, secrets, subwords, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    one = F.col("secrets")
    return found.select("doc_id", *(one[c].alias(c) for c in ("n_assign", "n_access", "n_hex")), F.sha2(one["base_spans"], 256).alias("base_sha256"), one["spans"].alias("spans"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = subwords.encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), with_ids=False)
    return coded.select("doc_id", *(F.col("pieces")[c].alias(c) for c in ("n_ids", "n_fallback", "ids_crc32", "round_trip")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    base = pii.listed(F.col("base"))
    parts = [base, pii.listed(F.filter("terms", lambda t: ~pii.is_removed(t)), F.lit("generalise")), pii.listed(F.filter("terms", lambda t: pii.is_removed(t)), F.lit("remove"))]
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.array_remove(F.array(*parts), ""), ",").alias("spans"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = html.extract(pages, trees=html.fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rated = quality.quality_verdicts(documents(spark, sf_dir), metrics=asked)
    m = lambda name: F.col("measures")[name]
    return rated.select("doc_id", *(m(c).alias(c) for c in asked), quality.base_failed(m).alias("base_failed"), "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(documents(spark, sf_dir))
    lists = (F.array_join(c, ",").alias(c) for c in ("base_labels", "labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *lists, licenses.score(F.col("n_base"), F.col("matches")).alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(toxicity.fold() != 0))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_sentencepiece, op4_ngram_jaccard_join, op5_pii, op6_html_extraction, op7_quality_rules, op8_license_scan, op9_toxicity, op10_exact_dedup)}


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
  length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
  length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM t JOIN lines ON t.doc_id IS NOT DISTINCT FROM lines.doc_id LEFT JOIN cov ON t.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 2 * n_words OR 10 * n_marks > 6 * n_words
    OR 10 * n_capitals > 4 * word_chars OR 10 * n_digits > 5 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM m
"""

OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4_SQL, "op7_quality_rules": OP7_SQL, "op10_exact_dedup": OP10_SQL}
