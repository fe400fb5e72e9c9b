"""The operators applied to the driver's tables; each query reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontamination, filter_audit, huffman, near_dup, packing, pii, quality_model, quality_rules, secrets, suffix_index, toxicity

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID, PIECE_END_ID = 2, 1
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.3, 0.5

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_kind(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select("doc_id", *[count_kind("base", k) for k in kinds], F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(quality_model.scored(docs, quality_model.trained(docs, table(spark, sf_dir, "labels"))), QUALITY_THRESHOLD)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cleaned(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(table(spark, sf_dir, "documents")).drop("tail", "stands")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii.sanitised(table(spark, sf_dir, "documents")), pii.KINDS)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secrets.scanned(table(spark, sf_dir, "documents")), secrets.KINDS)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_index.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels"))), TOXIC_THRESHOLD)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), PIECE_END_ID)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OPERATORS = (
    op1_quality_model, op2_quality_rules, op3_near_duplicates, op4_pii, op5_bpe, op6_secrets, op7_token_files, op8_suffix_index, op9_toxicity,
    op10_decontamination, op11_filter_audit, op12_alignment, op13_packing,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op2_quality_rules": sql.quality_rules(), "op11_filter_audit": sql.filter_audit()}
