"""One query for each operator, over whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .chat_repair import repair_roles
from .conversation_repair import damage, repair_reports
from .filter_audit import filter_audit
from .license_rules import license_scan
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard_join
from .oracle import ORACLE
from .order_minhash import edited_fingerprints
from .packing import pack_sequences
from .pii import KINDS, pii_spans, span_digest
from .quality_rules import quality_rules
from .token_store import round_trip, token_checksums
from .toxicity import score_documents, train

#: name -> (spark, sf_dir) -> result; ORACLE has the SQL of those that SQL can express.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["ORACLE", "QUERIES"]


def query(name: str):
    def add(run):
        QUERIES[name] = run
        return run
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op8_ngram_jaccard")
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingle Jaccard of at least 0.75."""
    return ngram_jaccard_join(documents(spark, sf_dir)).documents


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the divergence verdict of every document."""
    judged = quality_rules(documents(spark, sf_dir), keep=["doc_id"])
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"))


@query("op5_pattern_packing")
def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 2048 tokens, with checksums of the packed ids."""
    return pack_sequences(documents(spark, sf_dir)).drop("ids")


@query("op7_water_filling_mix")
def op7_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix of all sources."""
    mixed = mix_sources(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "times")


@query("op9_token_store")
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written, read back and summed up."""
    return token_checksums(round_trip(documents(spark, sf_dir)))


@query("op10_license_rules")
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of every document."""
    return license_scan(documents(spark, sf_dir)).drop("detections")


@query("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(documents(spark, sf_dir))


@query("op1_contextual_pii")
def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, a checksum of the base spans and all spans."""
    found = pii_spans(documents(spark, sf_dir), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("row.doc_id", *map(count, KINDS), F.sha2(span_digest("spans", True), 256).alias("base_sha256"),
                        span_digest("spans", False).alias("spans"))


@query("op2_ordinal_toxicity")
def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document.

    Grades of the labelled documents: 0 not toxic, 1 toxic, 2 toxic and of low quality.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    docs = documents(spark, sf_dir)
    model = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")), n_grades=3)
    scored = score_documents(docs, model)
    return scored.select("doc_id", "grade", F.round("expected_severity", 6).alias("expected_severity"),
                         F.round("p_toxic", 6).alias("p_toxic"), (F.col("grade") > 0).alias("toxic"))


@query("op4_chat_repair")
def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in legal roles, rendered turn by turn."""
    return repair_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op11_filter_audit")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of every order, for each source."""
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair_reports(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query("op13_warc")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from WARC archives."""
    records = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    stored = F.col("warc_type") == "response"
    declared = F.regexp_replace(F.col("headers")["WARC-Payload-Digest"], "^sha1:", "")
    return records.select(
        F.col("headers")["Page-Id"].cast("long").alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(F.col("http_headers")["Content-Length"]).cast("long").alias("payload_bytes"),
        F.when(stored, warc.base32_sha1(F.col("payload"))).otherwise(declared).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.col("headers")["Refers-To-Page-Id"].cast("long").alias("refers_to"))
