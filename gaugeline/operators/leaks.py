"""Passages of a reference text that show up in other texts, such as benchmark items in a run's report.

Both sides are winnowed (Schleimer, Wilkerson, Aiken, 2003): of every ``window`` neighbouring hashes of ``gram`` words the
smallest is kept, the last of equal ones. Two texts that share gram + window - 1 words in a row share a kept hash there. The
kept hashes of the passages become a bit table of fixed size, which goes to the texts; around each kept hash of a text whose
bit is set, the word sequences of full length are cut out and joined with those of the passages, word by word. So every
shared passage of the stated length is found, and nothing is reported that does not stand in the text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import wordhash
from gaugeline.functions.wordhash import GOLDEN, Words, hashed_words, mixed

# Task code travels by value, so that executors do not need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(wordhash)

PASSAGE = 13  # words
GRAM = 7
BITS = 26  # the bit table has 2^26 bits, 8 MB, whatever the passages
CUT_BYTES = 1 << 21  # of texts in one vectorised step

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def kept_grams(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word): the winnowed hashes of the texts and the words at which their grams start."""
    count = len(words.hashes) - gram + 1
    if count < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = np.zeros(count, dtype=np.uint64)
    for j in range(gram):
        hashes = mixed(hashes * GOLDEN + words.hashes[j : j + count])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    last = window - 1 - np.argmin(views[:, ::-1], axis=1)
    place = np.arange(len(views))
    whole = words.owners[place] == words.owners[place + window + gram - 2]  # the words of a window stand in one text
    kept = np.unique((place + last)[whole])
    return hashes[kept], kept


def slots(hashes: np.ndarray) -> np.ndarray:
    """The bit of each hash."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def blocks(batches, column: str):
    """Batches cut to about CUT_BYTES of text; one long text is a block of its own."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CUT_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def passage_bits(passages: DataFrame, words: int, gram: int) -> np.ndarray:
    """The bit table of the kept hashes of all passages, made by Spark and of fixed size."""

    def run(batches):
        for batch in blocks(batches, "text"):
            hashes, _ = kept_grams(hashed_words(batch.column("text"), IN_WORD), gram, words - gram + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(hashes)))], names=["slot"])

    texts = passages.select(F.col("text")).filter(F.col("text").isNotNull())
    found = texts.mapInArrow(run, "slot long")
    bit = F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")
    parts = found.groupBy(F.shiftright("slot", 6).alias("part")).agg(F.bit_or(bit).alias("bits")).collect()
    table = np.zeros(1 << BITS - 6, dtype=np.int64)
    for part, bits in parts:
        table[part] = bits
    return table


def is_set(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def sequences(texts: DataFrame, key: str, words: int) -> DataFrame:
    """(key, sequence): the distinct word sequences of full length of the passages."""

    def run(batches):
        for batch in blocks(batches, "text"):
            found = hashed_words(batch.column("text"), IN_WORD)
            starts = np.arange(max(0, len(found.hashes) - words + 1))
            starts = starts[found.owners[starts] == found.owners[starts + words - 1]]
            owners = found.owners[starts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(owners)), spelled(found, starts, words)], names=[key, "sequence"]
            )

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, "text").filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"{key} {kind}, sequence string").distinct()


def spelled(found: Words, starts: np.ndarray, words: int) -> pa.Array:
    """The words of the sequences in lower case, with a space between."""
    lower = wordhash.LOWER[found.data].tobytes()
    begin, end = found.starts, found.starts + found.lengths
    return pa.array(
        [b" ".join([lower[begin[i] : end[i]] for i in range(s, s + words)]) for s in starts.tolist()], pa.binary()
    ).cast(pa.string())


def passage_leak(texts: DataFrame, passages: DataFrame, words: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Spans of the texts that stand in a passage: run_id, item_id, start (the span's first word, from 0) and words.

    ``texts`` holds run_id and text, ``passages`` item_id and text. Every sequence of ``words`` words that occurs in both is
    found; those that overlap or touch in a text make one span per item. Words are runs of letters, digits and characters
    beyond ASCII; case counts for the latter only. A null text has none; texts of one run_id are read as one each, and their
    spans are put together.
    """
    if not 0 < gram <= words:
        raise ValueError("a gram has at least one word and at most as many as a passage")
    table = passage_bits(passages, words, gram)
    window = words - gram + 1

    def run(batches):
        for batch in blocks(batches, "text"):
            found = hashed_words(batch.column("text"), IN_WORD)
            hashes, kept = kept_grams(found, gram, window)
            kept = kept[is_set(table, slots(hashes))]
            starts = np.unique((kept[:, None] - np.arange(window)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + words <= len(found.hashes))]
            starts = starts[found.owners[starts] == found.owners[starts + words - 1]]
            owners = found.owners[starts]
            first = np.searchsorted(found.owners, owners)  # the first word of the text
            yield pa.RecordBatch.from_arrays(
                [batch.column("run_id").take(pa.array(owners)), pa.array(starts - first), spelled(found, starts, words)],
                names=["run_id", "start", "sequence"],
            )

    kind = texts.schema["run_id"].dataType.simpleString()
    rows = texts.select("run_id", "text").filter(F.col("text").isNotNull())
    near = rows.mapInArrow(run, f"run_id {kind}, start long, sequence string")
    known = sequences(passages, "item_id", words)
    hits = near.join(known, "sequence").select("run_id", "item_id", "start").distinct()
    own = Window.partitionBy("run_id", "item_id").orderBy("start")  # at most the words of one text
    fresh = F.coalesce(F.col("start") - F.lag("start").over(own) > words, F.lit(True))
    spans = hits.withColumn("span", F.sum(fresh.cast("int")).over(own)).groupBy("run_id", "item_id", "span")
    found = spans.agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + words).alias("words"))
    return found.select("run_id", "item_id", "start", "words")
