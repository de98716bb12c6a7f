"""Exact deduplication by content sort.

Normalised texts are range-partitioned at sampled splitters, sorted inside the partitions (Spark's external sort), and
every text is compared in full with its neighbour. Splitters and sort see the first characters of the content and a
digest of all of it, so that what the driver samples does not grow with the length of texts. The sort key ends in length
and identifier: a group of any size spreads over as many partitions as it needs; only groups that touch a partition
border are put together afterwards, and there are at most two of those per partition.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import SPACES, in_blocks, shuffle_partitions, texts, written

HEAD = 32  # characters of the content that lead the sort key

RUNS = (
    "part int, run long, doc_id long, text_sha256 string, leader long, size long, "
    "is_first boolean, is_last boolean, edge_text string"
)
RUN_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("run", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_sha256", pa.string()),
        ("leader", pa.int64()),
        ("size", pa.int64()),
        ("is_first", pa.bool_()),
        ("is_last", pa.bool_()),
        ("edge_text", pa.string()),
    ]
)


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, SPACES, "")


def neighbour_runs(batches):
    """Runs of equal neighbours in one sorted partition.

    A run's rows go out when the run ends. What is held back are its identifiers, at most those of one partition.
    ``edge_text`` is the text of the first and of the last run, once each.
    """
    part = TaskContext.get().partitionId()
    run, last, held, sha, first_run = 0, None, [], None, None

    def flush(is_last: bool):
        size = sum(len(x) for x in held)
        ids = pa.concat_arrays(held)
        is_first = run == 0
        edge = pa.array([last if is_first or is_last else None] + [None] * (size - 1), pa.string())
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), size)
        return pa.RecordBatch.from_arrays(
            [
                same(part, pa.int32()),
                same(run, pa.int64()),
                ids,
                same(sha, pa.string()),
                same(ids[0].as_py(), pa.int64()),
                same(size, pa.int64()),
                same(is_first, pa.bool_()),
                same(is_last, pa.bool_()),
                edge,
            ],
            schema=RUN_SCHEMA,
        )

    for batch in in_blocks(batches, "norm"):
        norm, ids, shas = batch.column("norm"), batch.column("doc_id"), batch.column("text_sha256")
        changes = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1))
        starts = [0] + [i + 1 for i, x in enumerate(changes.to_pylist()) if x]
        out = []
        for start, end in zip(starts, [*starts[1:], len(norm)]):
            text = norm[start].as_py()
            if last is not None and text != last:
                out.append(flush(False))
                run, held = run + 1, []
            last, sha = text, shas[start].as_py()
            held.append(ids.slice(start, end - start))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if last is not None:
        yield flush(True)


def exact_dedup(documents: DataFrame, order: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts that agree after their white space is deleted; a null text is empty, and all empty texts are equal.
    The longest original (code points) stays, among equals the one with the smallest id; a null id comes last. Rows
    that repeat the same id are members like any other and share the answer ``kept``, so a caller who joins back by id
    keeps all of them. A caller who has to keep one row passes row numbers as doc_id and names the column with the ids as
    ``order``: the smallest of it stays, then the smallest doc_id. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = documents.sparkSession
    norm = normalised(F.col("text")).alias("norm")
    before = [order] if order else []
    rows = texts(documents, *before).select("doc_id", *before, F.char_length("text").alias("length"), norm).select(
        "*", F.substring("norm", 1, HEAD).alias("head"), F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256")
    )
    key = [F.col("head"), F.col("text_sha256"), F.col("length").desc(), *[F.col(c).asc_nulls_last() for c in [*before, "doc_id"]]]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key).select(
        "doc_id", "norm", "text_sha256"
    )
    runs = written(ordered.mapInArrow(neighbour_runs, RUNS))
    borders = border_groups(runs)
    at_border = F.col("is_first") | F.col("is_last")
    inner = runs.filter(~at_border).select(
        "doc_id", F.col("leader").alias("keep_id"), F.col("size").alias("group_size"), "text_sha256"
    )
    # at most two border runs per partition: a few thousand rows, whatever the number of documents
    outer = (
        runs.filter(at_border)
        .join(F.broadcast(borders), ["part", "run"])
        .select("doc_id", "keep_id", "group_size", "text_sha256")
    )
    return inner.unionByName(outer).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def border_groups(runs: DataFrame) -> DataFrame:
    """(part, run, keep_id, group_size) of the first and last run of every partition, joined across the borders.

    Two runs belong together if one ends a partition, the other starts the next one that has rows, and their whole
    texts are equal.
    """
    edges = runs.filter("edge_text is not null").select("part", "run", "leader", "size", "is_first", "is_last", "edge_text")
    order = Window.orderBy("part", "run")
    placed = edges.select(
        "part", "run", "leader", "size", "edge_text", F.row_number().over(order).alias("place")
    )
    before = placed.select(F.col("edge_text").alias("text_before"), (F.col("place") + 1).alias("place"))
    chained = placed.join(before, "place", "left").select(
        "place", "part", "run", "leader", "size",
        F.coalesce(F.col("edge_text") != F.col("text_before"), F.lit(True)).cast("int").alias("starts"),
    )
    grouped = chained.withColumn("group", F.sum("starts").over(Window.orderBy("place")))
    totals = grouped.groupBy("group").agg(
        F.min_by("leader", "place").alias("keep_id"), F.sum("size").alias("group_size")
    )
    return grouped.join(totals, "group").select("part", "run", "keep_id", "group_size")


ORACLE = r"""
with normal as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over (partition by norm order by n desc, doc_id) as kept,
       sha256(norm) as text_sha256
from normal
"""
