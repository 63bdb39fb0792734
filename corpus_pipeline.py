"""From raw documents to packed sequences, each stage a table that the next one reads.

Stages get and give the columns of documents; the last gives the pieces of the packed sequences. Nothing is dropped but what a
stage decides: low quality, near copies of a kept document, and what the mixture doesn't draw. Null texts are read as empty by
the operators (the personal-data stage writes them back as empty); repeated rows stay one row each until near-duplicate removal,
which keeps one row of each group; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import mixing, near_dup, packing, pii, quality
from millrace.llm.common import deleted, fold_column, shared_dir, table
from millrace.llm.queries import QUALITY_LEAST

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
SCHEMA = ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least QUALITY_LEAST. Learnt from the labels of these documents."""
    extra = ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items() if c != "doc_id")
    learn = fold_column("doc_id", 4) != 2
    found = quality.scored(docs, table(spark, sf_dir, "labels"), learn, extra=extra)
    return found.where(F.col("score") >= QUALITY_LEAST).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; the least id stays.

    Of rows that share the kept id, all with the same text are one row, and others are groups of their own.
    """
    found = near_dup.near_duplicates(docs, near_dup.Forest(shingle=5, percent=80)).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    return kept.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by a sign for their kind; n_chars follows the text."""
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens approach the target shares of sources, languages and topics."""
    return mixing.sampled(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), packing.Limits(tokens=2048))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Classifier, signatures and tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/millrace/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
        if k:
            # the stage before isn't read again
            deleted(spark, f"{folder}/{k - 1}")
    return docs
