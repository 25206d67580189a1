"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, packing.

Each stage gets what its predecessor kept, written as Parquet and read again; all but the last keep the columns of
documents. Rejected languages go, one document of each group of near duplicates stays, contaminated documents go,
personal data is replaced by its kind, and the rest is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontam, jaccard, langid, packing, pii
from basketry.llm.shared import discard, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure.

    Null texts, texts without a letter and texts with a narrow margin go; repeated rows share their fate; all columns
    stay as they are, nulls and names that the stage uses itself included; an empty table stays empty.
    """
    return langid.accepted(docs, langid.contract_dicts(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.75 or more): the one with the smallest id.

    Null ids come last; of rows with equal ids one stays; texts without words are like no other and all stay; all
    columns stay as they are; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark: hit words make up less than a twentieth.

    Null and empty texts have no words and stay; equal texts share their fate; all columns stay as they are; an empty
    table stays empty, and with an empty benchmark everything stays.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind.

    Null texts stay null; equal texts are changed alike; all other columns stay as they are (n_chars too, which is the
    length that the text had); an empty table stays empty.
    """
    return pii.redact(docs, pii.train(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens at most that all documents are packed into.

    A null or empty text is its end token alone; repeated rows are packed each for itself; other columns don't pass;
    an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", sequences),
]
#: Compression, belief propagation and dynamic programming are no SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes when the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
            if before is not None:
                discard(before)
            before = docs
    return docs
