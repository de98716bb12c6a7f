"""The corpus pipeline: toxicity, exact dedup, near dedup, source mixing, BPE encoding.

Every stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from gaugeline.llm.common import BROADCAST_BYTES, table, written
from gaugeline.session import ensure_checkpoint_dir, materialised

#: Nine tenths of the tokens that are left, no repetition: the pipeline's corpus has every document once.
MIX = replace(mixing.PRODUCTION, budget_percent=90, max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on this corpus' labels, finds toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows packed as doc, with a number of their own (row), written, so that it stays the same: ids may repeat or be
    null, and columns may have any names."""
    return materialised(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))


def as_rows(docs: DataFrame) -> DataFrame:
    """The numbered rows with their number as doc_id and the id as _order."""
    return docs.select(
        F.col("row").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.doc_id").cast("long").alias("_order")
    )


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The numbered rows, as they were, whose number is not among the dropped ones (their doc_id).

    A list of up to BROADCAST_BYTES is broadcast, so texts stay where they are; a longer one meets them by number.
    """
    gone = written(dropped.select(F.col("doc_id").alias("gone")))
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["row"] == gone["gone"], "left_anti").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest id, nulls last."""
    docs = numbered(docs)
    return without(docs, exact_dedup.exact_dedup(as_rows(docs), order="_order").filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, nulls last."""
    docs = numbered(docs)
    return without(docs, simhash.near_duplicates(as_rows(docs), order="_order").filter("doc_id <> component_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit into the token budgets of their domain, language and source."""
    return mixing.selected_rows(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256: the encoded corpus."""
    return bpe.encoded_corpus(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # a trained classifier and XXH64 fingerprints are beyond SQL; tests compare with brute force
