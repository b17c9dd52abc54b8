"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents``; the last returns the packed
pieces with their token ids. Stages are written as Parquet and read again.

Rows: null and empty texts pass all filters and are packed as a document of
the end token alone; a repeated row stays with its copy of the same id, and a
row without an id stays in the near-duplicate stage, whole copies included:
equal ids, and all null ids, are one document to the suffix stage as well, so
exact copies among these rows reach the packing whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import neardup, packing, pii, suffixes, toxicity
from creditloom.llm.common import read_table
from creditloom.session import ensure_checkpoint_dir, ensure_defaults

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates of the corpus share this percentage of their shingles.
PERCENT = 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised score rejects go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score_documents(docs.select(*COLUMNS).withColumn("id", F.col("doc_id")), model, id_col="id", keep=COLUMNS[1:])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document id of each group stays, the smallest, with all its rows; rows without an id all stay, copies or not."""
    found = neardup.near_duplicates(docs, PERCENT)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    # a null id equals none in the join: rows without an id all stay
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document holds are cut out."""
    left = suffixes.remove_repeats(docs.select(*COLUMNS), keep_text=True, keep=COLUMNS[2:4])
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of its format."""
    new = pii.pseudonymise(docs.select(*COLUMNS), keep=COLUMNS[2:4])
    return new.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: (doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicate), ("suffix_array", repeated_passages), ("pii", private), ("packing", packed)]

#: The stages learn a classifier, sort suffixes and run a keyed permutation: no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's table goes when the next is written."""
    from creditloom.session import drop_table

    ensure_defaults(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/creditloom-tables/{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}-{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
