"""The corpus pipeline: quality classifier, quality rules, near-duplicates, PII, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronowave.llm import near_dup, packing, pii, quality_classifier, quality_rules
from chronowave.llm.bpe import vocabulary_path
from chronowave.llm.common import drop_tables, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others; extra columns stay as they are."""
    return quality_classifier.accepted(docs, quality_classifier.trained(spark, sf_dir))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go, null and empty texts among them; extra columns stay as they are."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five words and 0.8, the one with the smallest id stays; of rows with one id, each is judged by its
    own text. Texts without words stay."""
    return near_dup.keep_one(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind; ``n_chars`` follows the text. Null and empty texts stay."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is its closing id alone."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), vocabulary_path()))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]
#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(*used)
        used = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
