"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text into chunks; equal passages are cut alike in whatever document they stand. What is sure in
a chunk whatever surrounds it, its words from the first to the last white space, is encoded once and kept. The joins
between chunks are repaired by encoding again what lies between the sure parts on both sides; a join whose neighbours
hold no white space grows until it does, so the pieces put together always agree with the encoding of the whole text.
The tokenizer drops white space and never merges across it, which is why a cut there is safe.

Reuse has two reaches. Chunks that occur in many documents anywhere in the corpus are counted by hash, and the most used
ones, a bounded number of bounded size, are encoded once and shipped to every task. All others are remembered by the task
that meets them, in a bounded memory.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeline.llm.common import binary, in_blocks, texts
from gaugeline.llm.rolling import cut_points

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CHUNK_BITS = 9  # chunks of about 512 bytes
SHARED = 2_000  # chunks shipped to all tasks, at most
SHARED_BYTES = 4_096  # longer chunks are not shipped
KEEP_BYTES = 8 << 20  # of chunks that a task remembers, beside KEEP_WORDS words
KEEP_WORDS = 250_000
BLOCK = 1 << 20  # bytes of text encoded together
MARKS = b".,;:!?%$&#*"  # never joined to a letter before them, nor part of a special token
LATIN_END = "\u0250"
SPACE = frozenset(b" \t\n\x0b\x0c\r")


def sure_parts(text: bytes) -> Iterator[tuple[bool, bytes]]:
    """(reusable, part) in order: the sure inside of each chunk, and the joins between them. Parts end at white space."""
    cuts = cut_points(np.frombuffer(text, dtype=np.uint8), CHUNK_BITS).tolist()
    at = 0
    for start, end in pairwise([0, *cuts, len(text)]):
        first = 0 if start == 0 else next_space(text, start, end)
        last = end if end == len(text) else last_space(text, start, end)
        if first is None or last is None or last <= first:
            continue  # no white space in it: the join goes on
        if first > at:
            yield False, text[at:first]
        yield True, text[first:last]
        at = last
    if at < len(text):
        yield False, text[at:]


def next_space(text: bytes, start: int, end: int) -> int | None:
    found = [x for x in (text.find(b" ", start, end), text.find(b"\n", start, end)) if x >= 0]
    if found:
        return min(found)
    return next((i for i in range(start, end) if text[i] in SPACE), None)


def last_space(text: bytes, start: int, end: int) -> int | None:
    found = max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))
    if found >= 0:
        return found
    return next((i for i in range(end - 1, start - 1, -1) if text[i] in SPACE), None)


def halves(word: bytes) -> tuple[bytes, bytes | None]:
    """A word of Latin letters (ASCII ones in lower case) and the marks after it, or the word as it is and None.

    The tokenizer parts letters from such marks wherever they meet. The one letter left out becomes two characters in
    lower case, the second of which is not a letter.
    """
    core = word.rstrip(MARKS)
    if core.isalpha():  # ASCII
        return core.lower(), word[len(core) :]
    if core and (letters := core.decode()).isalpha() and max(letters) < LATIN_END and "\u0130" not in letters:
        return core, word[len(core) :]
    return word, None


class Codec:
    """Encodes whole texts to the ids and the decoded text of the tokenizer."""

    def __init__(self, path: str = TOKENIZER, shared: dict[bytes, bytes] | None = None, content: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(content) if content is not None else Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.held = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "H" if size <= 1 << 16 else "I"  # ids in memory
        self.shared = {p: np.frombuffer(x, dtype="<u4").astype(self.kind).tobytes() for p, x in (shared or {}).items()}
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.ends_word = np.array([t.endswith("</w>") for t in self.tokens])

    def learn(self, new_words: set[bytes]) -> None:
        """Have the tokenizer encode what is not known yet of the words, all together."""
        words = self.words
        split = {w: halves(w) for w in new_words}
        cores = {core for core, tail in split.values() if tail is not None} - words.keys()
        others = {h for core, tail in split.values() for h in (core if tail is None else tail,) if h} - words.keys()
        self.learn_cores(list(cores))
        self.learn_each(list(others))
        for w, (core, tail) in split.items():
            words[w] = words[core] + words[tail] if tail else words[core]

    def learn_each(self, new: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.words.update((w, array(self.kind, e.ids).tobytes()) for w, e in zip(new, encoded))

    def learn_cores(self, new: list[bytes]) -> None:
        """Words of letters go in long lines: each is one unit to the tokenizer, and its last token alone says so."""
        width = array(self.kind).itemsize
        for start in range(0, len(new), 1000):
            some = new[start : start + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype=self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) != len(some):
                self.learn_each(some)
                continue
            line = ids.tobytes()
            self.words.update((w, line[a * width : b * width]) for w, a, b in zip(some, [0, *ends], ends))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers."""
        cut = [list(sure_parts(t)) for t in texts]
        ids = {}
        for reusable, part in (x for parts in cut for x in parts):
            if part not in ids:
                ids[part] = (self.shared.get(part) or self.chunks.get(part)) if reusable else None
        missing = [(part, part.split()) for part, found in ids.items() if found is None]
        words = self.words
        self.learn({w for _, some in missing for w in some if w not in words})
        for part, some in missing:
            ids[part] = b"".join([words[w] for w in some])
        for part in {part for parts in cut for reusable, part in parts if reusable}:
            if part not in self.shared and part not in self.chunks:
                self.chunks[part] = ids[part]
                self.held += len(part) + len(ids[part]) + 150
        if self.held > KEEP_BYTES:
            self.chunks, self.held = {}, 0
        if len(words) > KEEP_WORDS:
            self.words = {}
        joined = [b"".join([ids[part] for _, part in parts]) for parts in cut]
        return [np.frombuffer(x, dtype=self.kind).astype("<u4").tobytes() for x in joined]

    def decode(self, ids: bytes) -> bytes:
        """As the tokenizer's decode without a decoder: the tokens with a space between them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).encode()


def chunk_hash(part: bytes) -> int:
    return xxhash.xxh3_64_intdigest(part) - (1 << 63)


def shared_chunks(documents: DataFrame, content: str) -> dict[bytes, bytes]:
    """The chunks that save most encoding over the whole corpus, with their ids; at most SHARED of SHARED_BYTES.

    Every chunk of every document is counted by its hash. The texts of the winners are then looked up, encoded once, and
    returned to the driver: at most 8 MB of text and 16 MB of ids, whatever the corpus holds.
    """

    def hashes(batches):
        for batch in batches:
            for block in in_blocks([batch], "text", BLOCK):
                found = [
                    (chunk_hash(part), len(part))
                    for text in binary(block.column("text")).to_pylist()
                    for reusable, part in sure_parts(text)
                    if reusable and len(part) <= SHARED_BYTES
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32())], names=["hash", "size"]
                )

    winners = (
        documents.mapInArrow(hashes, "hash long, size int")
        .groupBy("hash")
        .agg(F.count("*").alias("uses"), F.max("size").alias("size"))
        .filter("uses > 2")
        .orderBy(F.desc(F.col("uses") * F.col("size")), "hash")
        .limit(SHARED)
    )
    wanted = frozenset(r.hash for r in winners.select("hash").collect())
    if not wanted:
        return {}

    def pick(batches):
        seen = set()
        for batch in batches:
            for text in binary(batch.column("text")).to_pylist():
                for reusable, part in sure_parts(text):
                    if reusable and len(part) <= SHARED_BYTES and (h := chunk_hash(part)) in wanted and h not in seen:
                        seen.add(h)
                        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([part], pa.binary())], names=["hash", "part"])

    rows = documents.mapInArrow(pick, "hash long, part binary").groupBy("hash").agg(F.first("part").alias("part")).collect()
    codec = Codec(content=content)
    parts = [bytes(r.part) for r in rows]
    return dict(zip(parts, codec.encode_all(parts)))


COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded.

    A null text is empty and has no tokens. Repeated rows are answered each; an empty table gives an empty result.
    """
    return _run(
        documents, path, "doc_id long, n_tokens long, ids binary, decoded string",
        lambda ids, decoded: (len(ids) // 4, ids, decoded.decode()), [pa.int64(), pa.binary(), pa.string()],
    )


def encoded_corpus(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Like ``encode_documents``, with the digest of the decoded text in place of the text."""
    return _run(
        documents, path, "doc_id long, n_tokens long, ids binary, decoded_sha256 string",
        lambda ids, decoded: (len(ids) // 4, ids, sha256(decoded).hexdigest()), [pa.int64(), pa.binary(), pa.string()],
    )


def encoded_digests(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The digests of ``encode_documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _run(
        documents, path, COLUMNS,
        lambda ids, decoded: (len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest()),
        [pa.int64(), pa.string(), pa.string()],
    )


def _run(documents: DataFrame, path: str, columns: str, answer, kinds: list) -> DataFrame:
    rows = texts(documents)
    with open(path) as file:  # the tokenizer is a parameter of the driver; executors get its content
        content = file.read()
    shared = shared_chunks(rows, content)
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")[1:]]]

    def run(batches):
        codec = Codec(content=content, shared=shared)
        for batch in batches:
            for block in in_blocks([batch], "text", BLOCK):
                encoded = codec.encode_all(binary(block.column("text")).to_pylist())
                answers = [answer(ids, codec.decode(ids)) for ids in encoded]
                arrays = [pa.array(c, k) for c, k in zip(zip(*answers), kinds)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *arrays], names=names)

    return rows.mapInArrow(run, columns)
