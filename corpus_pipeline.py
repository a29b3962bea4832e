"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, works on all of them and gives those that it
keeps, with all their columns; the last gives packed pieces. ``run`` writes each stage's rows to the
shared folder and reads them again, so a lost executor costs one stage at most; a stage's rows, and what its operator
wrote on the way, are removed when the next ones are committed.

Defined cases: those of the operators, which hold stage by stage: a null text counts as empty; rows with a null
doc_id are never copies of others; a doc_id that repeats with different texts loses only the rows that a stage
rejects; extra columns go along up to the last stage; empty tables give no rows, and without labels or
benchmark their stages keep every document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import exact_dedup, ngram_join, simhash
from tributary.llm.common import clear_written, left_out, remove_folder, shared_folder, table
from tributary.llm.decontamination import remove_contaminated
from tributary.llm.packing import pack_documents
from tributary.llm.toxicity import remove_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of all documents, as stored."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    First by the rule of ``op1``: fingerprints of at most four different bits. Of what stays, documents whose sets of five-word
    shingles have a similarity of 0.8 or more are found by signatures and verified on the sets; that search misses none.
    The second search is told which rows the first rejected, so texts are neither shuffled nor stored in between.
    """
    first = simhash.rejected(docs)
    return left_out(docs, first.union(ngram_join.rejected(docs, width=5, percent=80, without=first)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, rows, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        rows = spark.read.parquet(f"{folder}/{k}-{name}")
        clear_written(spark)
        if k:
            remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return rows
