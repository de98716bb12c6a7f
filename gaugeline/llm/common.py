"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

SPACES = " \t\n\x0b\f\r"  # fixed value: the white space of the contracts, [\x20\x09-\x0D]
CUT_BYTES = 1 << 20  # texts handed to one vectorised step
ARROW_ROWS = 1_000  # texts in one transfer to Python, at most


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_transfers(documents: DataFrame) -> DataFrame:
    """Have the session hand at most ARROW_ROWS texts at once to Python; the default suits numbers, not texts."""
    conf, name = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > ARROW_ROWS:
        conf.set(name, ARROW_ROWS)
    return documents


def texts(documents: DataFrame, *also: str) -> DataFrame:
    """doc_id, text with null as empty, and the columns of ``also``; others, clashing ones too, are left behind."""
    documents = bounded_transfers(documents)
    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *also)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder."""
    return cut_lineage(frame)


BROADCAST_BYTES = 8 << 20
SALTS = 64


def with_small(rows: DataFrame, small: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Inner join with a written table that is usually small, without gathering the rows of a hot key.

    The bytes of ``small`` are measured: up to BROADCAST_BYTES it is broadcast. Beyond, every row of it is repeated for
    each salt, and ``rows`` meet it by key and a salt of ``spread_by``, so a key's rows spread over SALTS places.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in small.columns), F.lit(0))
    if (small.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


FIT_BYTES = 64 << 20  # text that a classifier is fitted on, at most


def fitted_rows(documents: DataFrame, chosen: DataFrame, value: str) -> list[tuple[bytes, int]]:
    """(text, value) of the chosen ids (doc_id, value; distinct and bounded in number), for a fit on the driver.

    An id that several rows carry gives one, with the smallest text; ids follow in the order of their hashes while their
    texts stay within FIT_BYTES, and the first one that does not ends the list.
    """
    rows = texts(documents).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min(value).alias(value))
    rows = written(rows)
    sizes = rows.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("place")).collect()
    fits, total = [], 0
    for row in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        total += row["size"]
        if total > FIT_BYTES:
            break
        fits.append((row["doc_id"],))
    kept = rows.sparkSession.createDataFrame(fits, "doc_id long")
    found = rows.join(F.broadcast(kept), "doc_id").select("text", value).collect()
    return [(r["text"].encode(), r[value]) for r in found]


def crc_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as decimal text, modulo ``parts``; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(parts)).cast("int")


def binary(column: pa.Array) -> pa.Array:
    """A string column as bytes, without a copy."""
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def in_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block holds about ``limit`` bytes of ``column``; one long value is a block of its own."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
