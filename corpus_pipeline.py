"""The training-text pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Edge cases: texts that are null, empty or blank are kept by every stage and packed as documents of no
tokens; rows repeated with id and text are near duplicates of each other, so one stays, if the text
has a word; rows of one id but different texts are judged each by its own text; a null doc_id is
kept, and is the last choice of its class; columns of the input pass unread, whatever their names,
up to the last stage; ties are decided by id, then by a hash of the text; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import jaccard, leaks, packing, pseudonyms, resampling
from quillstone.llm.common import cut, drop, table
from quillstone.llm.queries import pseudonym_key, tokenizer_path

#: Near duplicates: five-word shingles, likeness of at least 0.8.
NEAR = jaccard.Rule(k=5, num=80, den=100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what importance resampling rejects: poor and toxic documents."""
    return resampling.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class of near duplicates."""
    return jaccard.one_of_each(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format."""
    return pseudonyms.pseudonymise_documents(docs, pseudonym_key(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packed)]

#: SQL can express neither the resampling nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
