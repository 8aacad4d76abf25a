"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import common, decontaminate, pieces, queries, simhash, surrogates, toxicity
from custodia.session import new_path

TOKENIZER = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    return toxicity.remove(docs, queries.toxicity_model(docs, spark, sf_dir), threshold=queries.TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_first(docs, words=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"), words=10)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    return surrogates.pseudonymize(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, the ids' count, and whether decoding them gives the text back."""
    model = public_tokenizers.path(TOKENIZER)
    decoded = common.free_name(docs, "_decoded")
    encoded = pieces.encode(docs, model, decoded_col=decoded)
    exact = F.col(decoded) == common.text_of("text")
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": exact}).drop(decoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None  # fitted weights, components and byte-pair merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
