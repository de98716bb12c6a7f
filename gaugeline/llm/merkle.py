"""Merkle fingerprints of documents over paragraphs and sections.

A leaf is a paragraph (a line), a section is a run of paragraphs, the root stands for the document; every node's digest
is the SHA-256 of its children's. Sections end at blank lines, before headings, and after paragraphs whose digest says
so, so an insertion moves no later section. Equal roots mean equal texts. Where roots differ, only branches whose
digests differ are opened, which locates the edits. Below a paragraph the fingerprint keeps short hashes of its
content-defined pieces, by which edited texts are compared.

Written form: root/section=paragraph:pieces,paragraph:pieces;section=... in hexadecimal.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import binary, shuffle_partitions, texts
from gaugeline.llm.rolling import WINDOW, cut_points

PIECE_BITS = 6  # pieces of about 64 bytes
SECTION_EVERY = 8  # one paragraph in so many ends a section by its digest
SHORT = 16  # hexadecimal digits of inner digests in the written form


def fingerprint(text: bytes) -> tuple[str, np.ndarray]:
    """The written form, and the piece hashes in ascending order."""
    cuts = cut_points(np.frombuffer(text, dtype=np.uint8), PIECE_BITS).tolist()
    sections, section, pieces, at, start = [], [], [], 0, 0
    for paragraph in text.split(b"\n"):
        end = start + len(paragraph)
        bounds = [start]
        while at < len(cuts) and cuts[at] < end:
            if cuts[at] >= start + WINDOW:  # the bytes that decide lie inside the paragraph
                bounds.append(cuts[at])
            at += 1
        bounds.append(end)
        own = [xxhash.xxh32_intdigest(text[a:b]) for a, b in pairwise(bounds)] if paragraph else []
        digest = sha256(paragraph).digest()
        if section and (paragraph.startswith(b"#") or not paragraph):
            sections.append(section)
            section = []
        section.append((digest, own))
        pieces += own
        if digest[0] % SECTION_EVERY == 0:
            sections.append(section)
            section = []
        start = end + 1
    if section:
        sections.append(section)
    digests, written = [], []
    for section in sections:
        digest = sha256(b"".join(d for d, _ in section)).digest()
        digests.append(digest)
        inner = ",".join(f"{d.hex()[:SHORT]}:{''.join(['%08x' % p for p in own])}" for d, own in section)
        written.append(f"{digest.hex()[:SHORT]}={inner}")
    root = sha256(b"".join(digests)).hexdigest()
    return f"{root}/{';'.join(written)}", np.sort(np.array(pieces, dtype=np.uint32))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted multisets."""
    values = np.unique(a)
    in_a = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    in_b = np.searchsorted(b, values, "right") - np.searchsorted(b, values, "left")
    return int(np.minimum(in_a, in_b).sum())


def piece_likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    if a[0][:64] == b[0][:64]:
        return 1.0
    total = len(a[1]) + len(b[1])
    return min(2 * shared(a[1], b[1]) / total, 1.0) if total else 0.0


def parsed(written: str) -> list[tuple[str, list[tuple[str, list[int]]]]]:
    """(section, [(paragraph, pieces)]) of a written fingerprint."""
    out = []
    for section in written.partition("/")[2].split(";"):
        digest, _, inner = section.partition("=")
        paragraphs = [p.partition(":")[::2] for p in inner.split(",")]
        out.append((digest, [(d, [int(p[i : i + 8], 16) for i in range(0, len(p), 8)]) for d, p in paragraphs]))
    return out


def likeness(a: str, b: str) -> float:
    """How much two fingerprints have in common: 1 for equal roots, else the share of pieces found in both."""
    pieces = [np.sort(np.array([p for _, s in parsed(x) for _, own in s for p in own], dtype=np.uint32)) for x in (a, b)]
    return piece_likeness((a, pieces[0]), (b, pieces[1]))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``a`` that ``b`` lacks, opening only sections that differ."""
    if a[:64] == b[:64]:
        return []
    theirs = parsed(b)
    sections = Counter(d for d, _ in theirs)
    open_sections = []
    for n, (digest, inner) in enumerate(parsed(a)):
        if sections[digest]:
            sections[digest] -= 1
        else:
            open_sections.append((n, inner))
    left = Counter()
    for digest, inner in theirs:
        if sections[digest]:
            sections[digest] -= 1
            left.update(d for d, _ in inner)
    found = []
    for n, inner in open_sections:
        for m, (digest, _) in enumerate(inner):
            if left[digest]:
                left[digest] -= 1
            else:
                found.append((n, m))
    return found


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_pieces. A null text is empty; repeated rows are answered each; order is not kept."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x) for x in binary(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([w for w, _ in prints], pa.string()), pa.array([len(p) for _, p in prints], pa.int64())],
                names=["doc_id", "fingerprint", "n_pieces"],
            )

    return texts(documents).mapInArrow(run, "doc_id long, fingerprint string, n_pieces long")


def place_of(key: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are above ``key``, looked up in two steps of square-root size."""
    if not bounds:
        return F.lit(0)
    width = int(len(bounds) ** 0.5) + 1
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    lasts = F.array(*[F.lit(b[-1]) for b in blocks])
    passed = F.size(F.filter(lasts, lambda x: x > key))
    inner = F.coalesce(
        F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), F.least(passed + 1, F.lit(len(blocks)))),
        F.array().cast("array<bigint>"),
    )
    return F.when(passed >= len(blocks), len(bounds)).otherwise(passed * width + F.size(F.filter(inner, lambda x: x > key)))


NONE = -(1 << 63)  # stands for a null id, which comes last
COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_changed long"
)


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, key, copy, slice): rows laid out so that every row's successor is in the same slice.

    The order is descending doc_id, then text; after the last row comes the first. Identifiers alone are looked at first:
    their quantiles border the slices, and the first identifier of each slice (one number per slice) is also sent to the
    end of the slice before it. Texts are shuffled once.
    """
    keyed = texts(documents).select("doc_id", "text", F.coalesce("doc_id", F.lit(NONE)).alias("key"))
    slices = shuffle_partitions(documents.sparkSession)
    wanted = F.array(*[F.lit(i / slices) for i in range(1, slices)]) if slices > 1 else F.array(F.lit(0.5))
    quantiles = keyed.agg(F.percentile_approx("key", wanted, F.lit(max(10_000, 20 * slices))).alias("q")).first()["q"]
    bounds = sorted(set(quantiles or []), reverse=True)
    placed = keyed.withColumn("slice", place_of(F.col("key"), bounds))
    heads = sorted(map(tuple, placed.groupBy("slice").agg(F.max("key")).collect()))  # one row per slice
    first = {s: k for s, k in heads}
    before = {s: heads[i - 1][0] for i, (s, _) in enumerate(heads)}
    every = range(len(bounds) + 1)
    head = F.element_at(F.array(*[F.lit(first.get(s)).cast("long") for s in every]), F.col("slice") + 1)
    back = F.element_at(F.array(*[F.lit(before.get(s)).cast("int") for s in every]), F.col("slice") + 1)
    targets = F.array(F.struct(F.lit(False).alias("copy"), F.col("slice").alias("to")))
    also = F.array(F.struct(F.lit(True).alias("copy"), back.alias("to")))
    sent = placed.withColumn("t", F.explode(F.when(F.col("key") == head, F.concat(targets, also)).otherwise(targets)))
    return (
        sent.select("doc_id", "text", "key", F.col("t.copy").alias("copy"), F.col("t.to").alias("slice"))
        .repartitionById(len(bounds) + 1, F.col("slice"))
        .sortWithinPartitions("slice", "copy", F.col("key").desc(), "text")
    )


def compare_neighbours(batches):
    """Fingerprints of each own row, of its edited text, and their likeness; ``copy`` rows only serve as successors."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
            ("n_changed", pa.int64()),
        ]
    )

    def compared(row, following):
        doc_id, text, own = row
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[1][:half]).encode()
        changed = fingerprint(edited)
        return (
            doc_id, len(text), sha256(edited).hexdigest(), own[0], changed[0],
            piece_likeness(own, changed), piece_likeness(own, following[2]), len(edits(own[0], changed[0])),
        )

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    held, rows, size = None, [], 0
    for batch in batches:
        for doc_id, text, copy in zip(batch.column("doc_id"), batch.column("text"), batch.column("copy")):
            if copy.as_py() and held is None:
                continue  # a second row of the same identifier; the first one was the successor
            text = text.as_py()
            row = (doc_id.as_py(), text, fingerprint(text.encode()))
            if held is not None:
                rows.append(compared(held, row))
                size += len(row[2][0])
            held = None if copy.as_py() else row
            if size > 8 << 20:
                yield out(rows)
                rows, size = [], 0
    if rows:
        yield out(rows)


def compared_documents(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses (see ``COMPARED``).

    The edited text has its last floor(n/2) code points replaced by as many, or all, from the start of the next document.
    ``n_changed`` counts the paragraphs of the text that the edited one lacks. A null text is empty; null ids come last in
    the order; rows that repeat an id follow each other in the order of their texts; an empty table gives an empty result.
    """
    return with_next(documents).select("doc_id", "text", "copy").mapInArrow(compare_neighbours, COMPARED)
