"""Ranked lexical search: an impact-ordered index that is read with no random access (NRA).

The index cuts the documents into blocks and keeps, per block, one row for each term with its documents and occurrences, and
one row (term null) with the documents' ids and lengths. A search orders each list of a block by impact and reads the
lists of an item from the top, some postings of each at a time. A document's score then lies between the sum of what was
read and that sum plus the next impact of every list in which it was not met (Fagin, Lotem, Naor, 2003). Reading ends when
each document that can still be among the best has equal bounds: membership, ties and scores are final. The best of a task
raise the bar for its later blocks, and the best of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import binary, in_blocks, shuffle_partitions, texts
from gaugeline.session import materialised

BEST = 10
NO_ID = np.iinfo(np.int64).max  # stands for a null id, so that it comes last
BLOCK_BYTES = 24 << 20  # text in one block of the index, but for a single longer document
ITEMS = 1_000  # items answered in one job
ITEM_BYTES = 4 << 20  # and their text, but for a single longer item
READ = 32  # postings of each list in the first step; later steps double

#: Fixed value: bytes of the contract's terms; all others part them, A-Z count as a-z.
TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` that end at ``ends``, as binary cells."""
    offsets = np.concatenate(([0], ends)) * values.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def index(documents: DataFrame) -> DataFrame:
    """The written index of all rows and whole texts: block, term, docs, counts, n_docs, n_terms.

    With a term, docs and counts are 32-bit positions in the block and occurrences; without, 64-bit ids and lengths, a
    null id being the largest long. n_docs and n_terms (rows without term only) count documents with terms, and terms.
    """
    schema = "block long, term string, docs binary, counts binary, n_docs long, n_terms long"
    names = ["block", "term", "docs", "counts", "n_docs", "n_terms"]

    def run(batches):
        numbers = count(TaskContext.get().partitionId() << 32)
        for block in grouped(batches):
            number = next(numbers)
            ids = np.concatenate([np.asarray(b.column("doc_id").fill_null(NO_ID), dtype=np.int64) for b in block])
            known: dict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            each = []
            for batch in block:
                for text in binary(batch.column("text")):
                    each.append(np.array([known[w] for w in terms(text.as_buffer().to_pybytes())], dtype=np.int64))
            lengths = np.array([len(x) for x in each], dtype=np.int64)
            keys = np.concatenate(each) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
            del each
            keys, counts = np.unique(keys, return_counts=True)
            term, doc = np.divmod(keys, len(ids))
            ends = np.cumsum(np.bincount(term, minlength=len(known)))
            head = [[number], [None], [ids.tobytes()], [lengths.tobytes()], [int((lengths > 0).sum())], [int(lengths.sum())]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(head, [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])],
                names=names,
            )
            none = pa.nulls(len(known), pa.int64())
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(known), number, dtype=np.int64)),
                    pa.array(list(known), pa.binary()).cast(pa.string()),
                    packed(doc.astype(np.int32), ends),
                    packed(counts.astype(np.int32), ends),
                    none,
                    none,
                ],
                names=names,
            )
            for at in range(0, rows.num_rows, 8192):
                yield rows.slice(at, 8192)

    return materialised(texts(documents).mapInArrow(run, schema))


def grouped(batches):
    """Lists of batches with about BLOCK_BYTES of text each."""
    held, size = [], 0
    for batch in in_blocks(batches, "text"):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def first_without_random_access(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, best: int, bar: int):
    """(documents, scores) that may be among the ``best`` and reach ``bar``; all scores final and above 0.

    lists: per term the documents and impacts, impacts falling. Every list is read from the top only.
    """
    lower = np.zeros(documents, dtype=np.int64)
    met = np.zeros((len(lists), documents), dtype=bool)
    at, step = 0, READ
    while True:
        ahead = np.zeros(len(lists), dtype=np.int64)
        for i, (docs, impacts) in enumerate(lists):
            read = docs[at : at + step]
            lower[read] += impacts[at : at + step]
            met[i, read] = True
            if at + step < len(impacts):
                ahead[i] = impacts[at + step]
        upper = lower + ahead.sum()
        for i in np.flatnonzero(ahead):
            upper[met[i]] -= ahead[i]
        least = max(bar, 1, int(np.partition(lower, -best)[-best]) if documents >= best else 1)
        open_ = upper >= least
        if (upper[open_] == lower[open_]).all():
            found = np.flatnonzero(open_)
            return found, lower[found]
        at, step = at + step, step * 2


class Items:
    """The items of one job: their terms, the weights of the terms and the corpus' counts."""

    def __init__(self, rows: list, weights: dict[str, int], n_docs: int, n_terms: int):
        self.ids = [r["item_id"] for r in rows]
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        self.terms = [Counter(w.decode() for w in terms((r["text"] or "").encode())) for r in rows]

    def impact(self, term: str, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 25 + 75 * lengths * self.n_docs // self.n_terms
        return self.weights[term] * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def search_blocks(batches, items: Items, best: int):
    """The best of a task's blocks; rows come ordered by block, a block's row without term first."""
    top: list[list[tuple[int, int]]] = [[] for _ in items.ids]  # (-score, id), ascending

    def answer(ids, lists):
        for number, wanted in enumerate(items.terms):
            mine = [(lists[t][0], lists[t][1] * times) for t, times in wanted.items() if t in lists]
            if not mine:
                continue
            bar = -top[number][best - 1][0] if len(top[number]) == best else 0
            docs, scores = first_without_random_access(mine, len(ids), best, bar)
            top[number] = sorted(top[number] + list(zip((-scores).tolist(), ids[docs].tolist())))[:best]

    ids = lengths = None
    lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for term, docs, counts in zip(*(batch.column(c) for c in ("term", "docs", "counts"))):
            docs, counts, term = docs.as_buffer(), counts.as_buffer(), term.as_py()
            if term is None:
                if lists:
                    answer(ids, lists)
                ids, lengths, lists = np.frombuffer(docs, np.int64).copy(), np.frombuffer(counts, np.int64).copy(), {}
                continue
            docs, counts = np.frombuffer(docs, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
            impacts = items.impact(term, counts, lengths[docs])
            order = np.argsort(-impacts, kind="stable")
            lists[term] = (docs[order], impacts[order])
    if lists:
        answer(ids, lists)
    rows = [(number, items.ids[number], None if i == NO_ID else i, -s) for number, x in enumerate(top) for s, i in x]
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["number", "item_id", "doc_id", "score"]
    )


def item_blocks(items: DataFrame):
    """The distinct (item_id, text) in lists of up to ITEMS rows and about ITEM_BYTES."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").distinct().toLocalIterator():
        if held and (len(held) == ITEMS or size + len(row["text"] or "") > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["text"] or "")
    if held:
        yield held


def search(indexed: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` documents of each item: item_id, rank, doc_id, score; a written table.

    Items are answered in blocks of ITEMS rows, each in one job over the index, of which only the items' terms are read
    out. Equal scores rank by ascending doc_id, a null id last. A null or empty text, of an item or a document, has no
    terms and no result. Repeated documents rank each; repeated rows of items are answered once, and one item_id with two
    texts twice, each with ranks from 1. Texts of any length are read whole: a document longer than a block is a block.
    Other columns are left behind, clashing ones too. An empty table gives an empty result.
    """
    spark = indexed.sparkSession
    n_docs, n_terms = indexed.filter("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    answers = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for rows in item_blocks(items) if n_docs else ():
        wanted = sorted({w.decode() for r in rows for w in terms((r["text"] or "").encode())})
        if not wanted:
            continue
        listed = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "term string"))  # up to ITEM_BYTES
        postings = indexed.select("block", "term", "docs", "counts").join(listed, "term", "left_semi")
        df = postings.groupBy("term").agg((F.sum(F.octet_length("docs")) / 4).cast("long").alias("df"))
        weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in df.collect()}
        asked = Items(rows, weights, n_docs, n_terms)
        heads = indexed.filter("term is null").select("block", "term", "docs", "counts")
        dealt = postings.unionByName(heads).repartition(shuffle_partitions(spark), "block")
        found = dealt.sortWithinPartitions("block", F.col("term").asc_nulls_first()).select("term", "docs", "counts").mapInArrow(
            lambda batches, asked=asked: search_blocks(batches, asked, best), "number int, item_id long, doc_id long, score long"
        )
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        answers.append(materialised(ranked.select("item_id", "rank", "doc_id", "score")))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def best_documents(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``search`` over a new index of the documents."""
    return search(index(documents), items, best)


ORACLE = """
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
item_terms AS (
  SELECT item_id, w, count(*) AS times FROM (SELECT DISTINCT item_id, text FROM benchmark),
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS u(w) GROUP BY ALL),
corpus AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM doc_terms WHERE len(ws) > 0),
lengths AS (
  SELECT r, doc_id, ws, 25 + (75 * len(ws)::BIGINT * n_docs) // n_terms AS m FROM doc_terms, corpus WHERE len(ws) > 0),
tf AS (
  SELECT r, doc_id, m, w, count(*) AS tf FROM lengths, unnest(ws) AS u(w) GROUP BY ALL),
weights AS (
  SELECT w, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), corpus),
scores AS (
  SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN tf USING (w) JOIN weights USING (w) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores WHERE score > 0)
WHERE rank <= 10
"""
