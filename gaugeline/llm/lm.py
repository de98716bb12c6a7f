"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is a hierarchical Dirichlet bigram: P(w | c) = (n(c,w) + mu P(w)) / (n(c) + mu), P(w) the share of w among the
training tokens, unknown words sharing the mass of one more token. A text starts after a begin mark and closes with an
end token. All that belongs to a predicted word, its count and the contexts it follows, is kept by the shard of that
word: numerators are looked up there, and since each word is the context of its successor exactly once (and the begin
mark occurs as often as the end token), the denominators can be added up there as well. So one shuffle brings the
counted n-grams of all texts to the shards; each shard builds its trie from the training texts and answers for all.
Answers go back by block of documents, as arrays of partial sums.

No model is broadcast and no shard grows with one word: words that a sample shows to be frequent are spread over all
shards by their contexts, and only their counts, a bounded list, go everywhere.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import SPACES, binary, bounded_transfers, crc_remainder, in_blocks, shuffle_partitions, written
from gaugeline.llm.elias_fano import HASH_BITS, Trie

HELD_OUT, PARTS = 2, 7
MU = 500.0  # the strength of the prior, chosen on held-out text
HOT_SHARE = 500  # words of more than 1/500 of the tokens are spread, so there are fewer than 500 of them
HOT_SAMPLE = 20_000  # documents that show which words are frequent; this moves work, not results
BLOCK = 2 << 20  # bytes of text counted together
MASK = (1 << HASH_BITS) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & MASK


END, BEGIN = word_hash(b" end"), word_hash(b" begin")  # no word has a space

MAPPED = "shard int, block long, kind string, content binary"
MAP_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.string()), ("content", pa.binary())])


def frequent_words(rows: DataFrame) -> np.ndarray:
    """Ascending hashes of the end token and of the words that hold more than 1/HOT_SHARE of a sample's tokens."""
    step = max(1, rows.count() // HOT_SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SPACES, "abcdefghijklmnopqrstuvwxyz" + " " * len(SPACES))
    counts = written(some.select(F.explode(F.split(lowered, " ", -1)).alias("w")).filter("w <> ''").groupBy("w").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    words = [r.w for r in counts.filter(F.col("count") * HOT_SHARE > total).select("w").collect()]  # fewer than HOT_SHARE
    return np.array(sorted({END, *(word_hash(w.encode()) for w in words)}), dtype=np.uint64)


def is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def distinct(word: np.ndarray, context: np.ndarray, doc: np.ndarray, words: int, docs: int):
    """Distinct (word, context, doc) in ascending order, and how often each occurs."""
    wide, narrow = int(words).bit_length(), int(docs).bit_length()
    if 2 * wide + narrow <= 62:
        keys, times = np.unique((word << (wide + narrow)) | (context << narrow) | doc, return_counts=True)
        pair, doc = keys >> narrow, keys & ((1 << narrow) - 1)
        return pair >> wide, pair & ((1 << wide) - 1), doc, times
    order = np.lexsort((doc, context, word))
    word, context, doc = word[order], context[order], doc[order]
    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])])
    return word[new], context[new], doc[new], np.diff(np.r_[new, len(word)])


def counted(texts: list[bytes]):
    """(hashes, word, context, doc, times, lengths): a block's distinct n-grams by document; words are places in hashes."""
    lists = [t.lower().split() for t in texts]
    lengths = np.array([len(x) for x in lists], dtype=np.int64) + 1
    flat = [w for x in lists for w in x]
    place = {w: i for i, w in enumerate(set(flat))}
    hashes = np.array([word_hash(w) for w in place] + [END, BEGIN], dtype=np.uint64)
    ends = np.cumsum(lengths) - 1
    word = np.full(int(lengths.sum()), len(place), dtype=np.int64)
    inner = np.ones(len(word), dtype=bool)
    inner[ends] = False
    word[inner] = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[ends - lengths + 1] = len(place) + 1
    doc = np.repeat(np.arange(len(texts)), lengths)
    return hashes, *distinct(word, context, doc, len(hashes), len(texts)), lengths


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob."""
    head = struct.pack(f"<{1 + 2 * len(arrays)}q", len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a))))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", data)
    kinds = struct.unpack_from(f"<{2 * n}q", data, 8)
    at, out = 8 + 16 * n, []
    for kind, size in zip(kinds[::2], kinds[1::2]):
        out.append(np.frombuffer(data, dtype=chr(kind), count=size, offset=at))
        at += out[-1].nbytes
    return out


def content(trained: np.ndarray, words: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """A block's n-grams for one shard: which documents train, words, entries per word; context, document, times."""
    return packed(
        trained.astype(np.uint8), words.astype(np.uint64), sizes.astype(np.uint32),
        contexts.astype(np.uint32), docs.astype(np.uint16), times.astype(np.uint32),
    )


def dealt(batches, shards: int, hot: np.ndarray):
    """What every shard gets of a task's documents: n-grams by block, and at the end the counts that all shards need.

    The documents of a block travel as one more blob, to be put together with the answers.
    """
    task = TaskContext.get().partitionId() << 33
    blocks, hot_counts, tokens = 0, np.zeros(len(hot), dtype=np.int64), 0

    def rows(numbers, block: int, kind: str, contents):
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([kind] * n), pa.array(contents, pa.binary())],
            schema=MAP_SCHEMA,
        )

    for batch in in_blocks(batches, "text", BLOCK):
        texts, held = binary(batch.column("text")).to_pylist(), np.array(batch.column("held_out").to_pylist(), dtype=bool)
        hashes, word, context, doc, times, lengths = counted(texts)
        contexts = (hashes[context] >> np.uint64(HASH_BITS - 32)).astype(np.uint32)
        h = hashes[word]
        shard = (h % np.uint64(shards)).astype(np.int64)
        spread = is_in(hashes, hot)[word]
        shard[spread] = (shard[spread] + contexts[spread]) % shards
        learned = spread & ~held[doc]
        hot_counts += np.bincount(np.searchsorted(hot, h[learned]), times[learned], len(hot)).astype(np.int64)
        tokens += int(lengths[~held].sum())
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        filled, contents = [], []
        for number in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[number] : bounds[number + 1]]
            starts = np.flatnonzero(np.r_[True, word[own][1:] != word[own][:-1]])
            filled.append(number)
            contents.append(content(~held, h[own][starts], np.diff(np.r_[starts, len(own)]), contexts[own], doc[own], times[own]))
        block = task + blocks
        yield rows(filled, block, "grams", contents)
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid(), dtype=np.uint8)
        yield rows([block % shards], block, "documents", [packed(np.asarray(ids.fill_null(0)), known, held.astype(np.uint8), lengths)])
        blocks += 1
    if blocks:
        yield rows(range(shards), task, "totals", [packed(np.array([tokens]), hot_counts)] * shards)


class Shard:
    """The n-grams of one shard, in the order in which they came."""

    def __init__(self, number: int, shards: int, hot: np.ndarray):
        self.number, self.shards, self.hot = number, shards, hot
        self.tokens, self.hot_counts, self.model = 0, np.zeros(len(hot), dtype=np.int64), None
        self.blocks = []

    def take(self, kind: str, block: int, data: bytes) -> None:
        if kind == "totals":
            tokens, counts = unpacked(data)
            self.tokens += int(tokens[0])
            self.hot_counts += counts
        elif kind == "grams":
            self.blocks.append((block, unpacked(data)))
        else:
            self.model = data

    def gather(self) -> None:
        """Bring the n-grams of all blocks together: distinct words and pairs, and each entry's pair."""
        self.words = np.unique(np.concatenate([b[1] for _, b in self.blocks] or [np.empty(0, np.uint64)]))
        empty = [np.empty(0, np.int64)]
        place = np.concatenate([np.repeat(np.searchsorted(self.words, b[1]), b[2]) for _, b in self.blocks] or empty)
        contexts = np.concatenate([b[3] for _, b in self.blocks] or empty).astype(np.uint64)
        self.times = np.concatenate([b[5] for _, b in self.blocks] or empty).astype(np.int64)
        self.learned = np.concatenate([b[0][b[4]] for _, b in self.blocks] or empty).astype(bool)
        self.pairs, self.pair_of = np.unique((place.astype(np.uint64) << np.uint64(32)) | contexts, return_inverse=True)
        self.pair_word = (self.pairs >> np.uint64(32)).astype(np.int64)
        self.pair_context = (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def build(self, mu: float) -> bytes:
        """The trie over the pairs of the training texts; frequent words carry their counts of the whole corpus."""
        pair_counts = np.bincount(self.pair_of, self.times * self.learned, len(self.pairs)).astype(np.int64)
        counts = np.bincount(self.pair_word, pair_counts, len(self.words)).astype(np.int64)
        cold = ~is_in(self.words, self.hot) & (counts > 0)
        trained_hot = self.hot_counts > 0
        words = np.concatenate((self.words[cold], self.hot[trained_hot]))
        order = np.argsort(words)
        words, counts = words[order], np.concatenate((counts[cold], self.hot_counts[trained_hot]))[order]
        seen = pair_counts > 0
        where = np.searchsorted(words, self.words[self.pair_word[seen]])
        return Trie.build(words, counts, where, self.pair_context[seen], pair_counts[seen], self.tokens, mu)

    def answers(self, trie: Trie):
        """Per block (documents, base, score, known), and the number of trained words that are at home here."""
        place = trie.find(self.words)
        counts = trie.word_counts(place)
        numerators = trie.numerators(place[self.pair_word], self.pair_context)
        log_counts, denominators = np.log10(counts + 1.0), np.log10(counts + trie.mu)
        word = self.pair_word[self.pair_of]
        base, known = log_counts[word] * self.times, (counts > 0)[word] * self.times
        score = (numerators[self.pair_of] - denominators[word]) * self.times
        at, out = 0, []
        for block, (trained, _, _, _, doc, _) in self.blocks:
            own = slice(at, at + len(doc))
            at += len(doc)
            docs = np.unique(doc)
            sums = [np.bincount(doc, x[own], len(trained))[docs] for x in (base, score, known)]
            out.append((block, docs, *sums))
        everything = trie.words.get(np.arange(trie.words.size)) if trie.words.size else np.empty(0, np.uint64)
        return out, int((everything % np.uint64(self.shards) == self.number).sum())


def gathered(batches, shards: int, hot: np.ndarray, documents: list):
    """Read a partition's rows into shards; the blobs of documents are handed through."""
    out = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shard", "block", "kind", "content"))
        for number, block, kind, data in zip(*columns):
            if kind == "documents":
                documents.append((block, data))
                continue
            if number not in out:
                out[number] = Shard(number, shards, hot)
            out[number].take(kind, block, data)
    return out.values()


ANSWERS = "block long, kind string, content binary"


def answered(batches, shards: int, hot: np.ndarray, mu: float):
    """Each block's partial sums from the shards of this partition, the blobs of documents, and a row of totals."""

    def row(block: int, kind: str, data: bytes):
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([kind]), pa.array([data], pa.binary())], names=["block", "kind", "content"]
        )

    documents = []
    for shard in gathered(batches, shards, hot, documents):
        shard.gather()
        trie = Trie.mapped(shard.model or shard.build(mu))
        blocks, words = shard.answers(trie)
        for block, docs, base, score, known in blocks:
            yield row(block, "sums", packed(docs, base, score, known.astype(np.uint32)))
        yield row(-1, "totals", packed(np.array([words, trie.train_tokens])))
    for block, data in documents:
        yield row(block, "documents", data)


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, base double, score double, n_known long, words long, train_tokens long"
)
SCORED_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("n_known", pa.int64()),
        ("words", pa.int64()),
        ("train_tokens", pa.int64()),
    ]
)


def added_up(batches):
    """One row per document from the rows of its block, which stand together; one row of totals with null n_tokens."""

    def finished(block: int, rows: list):
        if block < 0:
            words, tokens = zip(*(unpacked(data)[0].tolist() for _, data in rows))
            columns = [[None]] * 6 + [[sum(words)], [max(tokens)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORED_SCHEMA)], schema=SCORED_SCHEMA)
        ids, known_ids, held, lengths = next(unpacked(data) for kind, data in rows if kind == "documents")
        sums = np.zeros((3, len(ids)))
        for kind, data in rows:
            if kind == "sums":
                docs, *parts = unpacked(data)
                for total, part in zip(sums, parts):
                    total[docs] += part
        none = pa.nulls(len(ids), pa.int64())
        arrays = [
            pa.array(ids, mask=known_ids == 0), pa.array(held.astype(bool)), pa.array(lengths), pa.array(sums[0]), pa.array(sums[1]),
            pa.array(sums[2].astype(np.int64)), none, none,
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=SCORED_SCHEMA)

    at, held = None, []
    for batch in batches:
        for block, kind, data in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "content"))):
            if block != at and held:
                yield finished(at, held)
                held = []
            at = block
            held.append((kind, data))
    if held:
        yield finished(at, held)


def modelled(batches, shards: int, hot: np.ndarray, mu: float):
    for shard in gathered(batches, shards, hot, []):
        shard.gather()
        yield pa.RecordBatch.from_arrays([pa.array([shard.number], pa.int32()), pa.array([shard.build(mu)], pa.binary())], names=["shard", "trie"])


def prepared(documents: DataFrame) -> DataFrame:
    held = crc_remainder(F.col("doc_id"), PARTS) == HELD_OUT
    return bounded_transfers(documents).select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out")
    )


def sharded(rows: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    return rows.mapInArrow(lambda batches: dealt(batches, shards, hot), MAPPED).repartitionById(shards, F.col("shard"))


def fit(documents: DataFrame, mu: float = MU) -> tuple[DataFrame, np.ndarray]:
    """The model as a table (shard, trie), and the frequent words it was spread by; to be written and used again."""
    rows, shards = prepared(documents), shuffle_partitions(documents.sparkSession)
    hot = frequent_words(rows)
    return sharded(rows, shards, hot).mapInArrow(lambda batches: modelled(batches, shards, hot, mu), "shard int, trie binary"), hot


def score(documents: DataFrame, mu: float = MU, model: tuple[DataFrame, np.ndarray] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Without a model the training rows among the documents are learned from; with one (of ``fit``) they are only scored.
    A null text is empty and consists of the end token; without training texts every word is unknown. Repeated rows are
    answered, and learned from, each. An empty table gives an empty result. Contexts are told apart by 32 bits under a
    word, words by 62 bits.
    """
    rows, shards = prepared(documents), shuffle_partitions(documents.sparkSession)
    if model is None:
        hot = frequent_words(rows)
        spread = sharded(rows, shards, hot)
    else:
        table, hot = model
        shards = table.count()
        tries = table.select(
            "shard", F.lit(0).cast("long").alias("block"), F.lit("model").alias("kind"), F.col("trie").alias("content")
        )
        grams = rows.mapInArrow(lambda batches: dealt(batches, shards, hot), MAPPED)
        spread = grams.unionByName(tries).repartitionById(shards, F.col("shard"))
    parts = spread.mapInArrow(lambda batches: answered(batches, shards, hot, mu), ANSWERS)
    sums = written(
        parts.repartition(shuffle_partitions(documents.sparkSession), "block").sortWithinPartitions("block").mapInArrow(added_up, SCORED)
    )
    totals = sums.filter("words is not null").first()
    words, tokens = (totals.words, totals.train_tokens) if totals else (0, 0)
    return sums.filter("n_tokens is not null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + words + 1)))).alias("base_score"), "score",
    )
