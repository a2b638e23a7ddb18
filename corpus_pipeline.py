"""A corpus pipeline of the operators in ``cohortkit.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it again as the next stage's
documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.mixing import mix_sources
from cohortkit.llm.ngram_jaccard import ngram_jaccard_join
from cohortkit.llm.packing import pack_sequences
from cohortkit.llm.pii import redact
from cohortkit.llm.quality_rules import quality_rules
from cohortkit.llm.staging import staged


def unused(docs: DataFrame) -> str:
    """An ending that makes a name longer than any column's."""
    return "_" * max((len(c) for c in docs.columns), default=0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id (missing ids last).

    Rows are joined by a number of their own, in the order of the ids: the id
    (from 0 to 2^39) followed by 22 bits of a hash of id and text; for missing
    and other ids 61 bits of the hash, behind all others.  So different texts
    that share an id are judged each for itself, and copies without id are
    copies like others.  Of rows with one id and text the one with the smallest
    hash of all columns stays.  Texts without words are near no other text.
    """
    row, key, mixed = "row" + unused(docs), docs["doc_id"].cast("long"), F.xxhash64("doc_id", "text")
    number = F.when(key.between(0, (1 << 39) - 1), F.shiftleft(key, 22).bitwiseOR(mixed.bitwiseAND(F.lit((1 << 22) - 1))))
    named = docs.withColumn(row, F.coalesce(number, mixed.bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))))
    groups = ngram_jaccard_join(named, id_col=row).documents.select(F.col("doc_id").alias(row), "component_id").distinct()
    ids = named.select(row, F.col("doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", row))
    chosen = groups.join(ids, row).groupBy("component_id").agg(first.alias("first")).select(f"first.{row}")
    once = named.join(chosen, row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("one"))
    return once.select("one.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars to match."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix_sources(docs).where("times > 0")
    copy = "copy" + unused(docs)
    return taken.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias(copy)).drop(copy)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their ids, the pieces of a sequence behind one another."""
    return pack_sequences(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", mixture),
    ("best-fit packing", packing),
]

#: Tokenizing has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
