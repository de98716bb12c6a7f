"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 bit positions carries a non-zero vector of r+1 bits (r: the radius). Table v, one for each non-zero
vector, keeps the positions whose vector has an odd inner product with v. Any r positions leave some v orthogonal to all
their vectors, so two fingerprints that differ in at most r bits agree on everything that table v keeps: no pair is
missed (Pagh, 2016). For radius 4 there are 31 tables of 31 to 34 kept bits.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import binary, in_blocks, shuffle_partitions, texts, written
from gaugeline.llm.components import components

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
DENSE = 4096  # fingerprints of a bucket that are compared with each other; beyond it they meet at midpoints


def masks(radius: int = RADIUS) -> list[int]:
    """The bits kept by each table; positions use the vectors 1 .. 2^(r+1)-1 in turn."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for bit in range(BITS) if ((bit % vectors + 1) & table).bit_count() % 2)
        for table in range(1, vectors + 1)
    ]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [x - 1 for x in accumulate([len(w) + 1 for w in words])]
    starts = [0] + [x + 1 for x in ends[:-width]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint per list: the bits set in over half of its hashes; zero for an empty list.

    Hashes are summed 255 at a time in eight byte-wide lanes of a 64-bit word, once for each bit of a byte.
    """
    sizes = np.array([len(x) for x in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((h for x in hashes for h in x), dtype=np.uint64, count=int(sizes.sum()))
    pieces = -(-sizes[full] // 255)
    first_piece = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    offsets = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    piece_starts = np.repeat(offsets, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first_piece, pieces))
    lanes = np.uint64(0x0101010101010101)
    prints = np.zeros(len(full), dtype=np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((flat >> np.uint64(shift)) & lanes, piece_starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, axis=0)
        for byte in range(8):
            bit = (2 * counts[:, byte] > sizes[full]).astype(np.uint64)
            prints |= bit << np.uint64(8 * byte + shift)
    out[full] = prints
    return out


def fingerprints(documents: DataFrame, width: int = SHINGLE, *also: str) -> DataFrame:
    """(doc_id, fp): the SimHash of the whole text as a signed long; columns of longs in ``also`` come along."""

    def run(batches):
        for batch in in_blocks(batches, "text"):
            hashes = [shingle_hashes(x, width) for x in binary(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(majority(hashes).view(np.int64)), *[batch.column(c) for c in also]],
                names=["doc_id", "fp", *also],
            )

    return texts(documents, *also).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *also]))


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, first of its group) of the groups within a bucket; never all pairs."""
    left, edges = prints.view(np.uint64), []
    while len(left):
        first, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            step, frontier = frontier[:64], frontier[64:]
            near = (np.bitwise_count(step[:, None] ^ left[None, :]) <= radius).any(axis=0)
            reached, left = left[near], left[~near]
            edges += [(int(x), int(first)) for x in reached.view(np.int64)]
            frontier = np.concatenate((frontier, reached))
    return [(a, signed(b)) for a, b in edges]


def midpoints(free: int, radius: int) -> np.ndarray:
    """All ways to flip up to radius/2 of the free bits."""
    bits = [b for b in range(BITS) if free >> b & 1]
    return np.array(
        [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(bits, k)], dtype=np.uint64
    )


def bucket_links(batches, radius: int, kept: list[int], dense: int):
    """Links inside the buckets of a partition that is sorted by (table, key, fp).

    A bucket of up to ``dense`` fingerprints is searched here and leaves a spanning forest. The rows of a larger one are
    sent on one by one, each with the midpoints it can reach: two fingerprints are within the radius exactly if they
    share a point that is at most half the radius away from both, so they meet there by equality.
    """
    full = (1 << BITS) - 1

    def out(edges, points):
        arrays = [pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())]
        none = pa.nulls(len(edges), pa.int64())
        yield pa.RecordBatch.from_arrays([*arrays, none], names=["a", "b", "point"])
        for table, some in points:
            flips = midpoints(full & ~kept[table], radius)
            for x in some:
                at = (np.uint64(int(x) & full) ^ flips).view(np.int64)
                a = pa.array(np.full(len(at), x, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([a, pa.nulls(len(at), pa.int64()), pa.array(at)], names=["a", "b", "point"])

    held = None  # table, key and fingerprints of the bucket that may go on in the next batch
    dense_key = None  # the bucket that turned out to be dense and may go on
    for batch in batches:
        table, key, prints = (np.asarray(batch.column(c)) for c in ("table", "key", "fp"))
        if held is not None:
            table, key, prints = (np.concatenate((h, x)) for h, x in zip(held, (table, key, prints)))
        if not len(prints):
            continue
        bounds = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], bounds))
        sizes = np.diff(np.concatenate((starts, [len(prints)])))
        goes_on = dense_key == (table[0], key[0])
        closed = np.arange(len(starts)) < len(starts) - 1
        as_points = closed & (sizes > dense)
        as_points[0] |= goes_on and closed[0]
        two = starts[closed & (sizes == 2) & ~as_points]
        near = np.bitwise_count(prints[two].view(np.uint64) ^ prints[two + 1].view(np.uint64)) <= radius
        edges = list(zip(prints[two + 1][near].tolist(), prints[two][near].tolist()))
        for i in np.flatnonzero(closed & (sizes > 2) & ~as_points):
            edges += forest(prints[starts[i] : starts[i] + sizes[i]], radius)
        points = [(table[starts[i]], prints[starts[i] : starts[i] + sizes[i]]) for i in np.flatnonzero(as_points)]
        last = starts[-1]
        if sizes[-1] > dense or goes_on and len(starts) == 1:
            dense_key, held = (table[last], key[last]), None
            points.append((table[last], prints[last:]))
        else:
            dense_key, held = None, (table[last:], key[last:], prints[last:])
        yield from out(edges, points)
    if held is not None and len(held[2]) > 1:
        yield from out(forest(held[2], radius), [])


def links(prints: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(a, b) edges that connect exactly the distinct fingerprints (column fp) within the radius, directly or not."""
    if radius % 2:
        raise ValueError("the radius must be even: midpoints stand for pairs exactly only then")
    kept = masks(radius)
    spread = prints.select("fp").distinct().select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(kept)])
        ).alias("t"),
        "fp",
    ).select("t.table", "t.key", "fp")
    bucketed = spread.repartition(shuffle_partitions(prints.sparkSession), "table", "key").sortWithinPartitions("table", "key", "fp")
    found = written(
        bucketed.mapInArrow(lambda batches: bucket_links(batches, radius, kept, dense), "a long, b long, point long")
    )
    met = found.filter("point is not null").groupBy("point").agg(F.min("a").alias("b"))
    through = found.filter("point is not null").select("a", "point").join(met, "point").select("a", "b")
    return found.filter("point is null").select("a", "b").unionByName(through)


def near_duplicates(
    documents: DataFrame, radius: int = RADIUS, width: int = SHINGLE, dense: int = DENSE, order: str | None = None
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), copies.

    A null text is empty; a text without words has fingerprint zero and links like any other. ``copies`` counts the rows
    with the same fingerprint. Repeated rows are answered each; null ids belong to components but never name one unless
    there is no other id. A caller who has to name one row passes row numbers as doc_id and names the column with the ids
    (long) as ``order``: the row with the smallest of it names the component, nulls last, then the smallest doc_id. An
    empty table gives an empty result.
    """
    prints = written(fingerprints(documents, width, *([order] if order else [])))
    first = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), "doc_id") if order else F.col("doc_id")
    classes = written(prints.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("copies")))
    found = components(links(classes, radius, dense))
    rooted = written(
        classes.join(found, classes["fp"] == found["node"], "left").select(
            "fp", "least", "copies", F.coalesce("root", "fp").alias("root")
        )
    )
    least = F.min("least")["doc_id"] if order else F.min("least")
    named = written(rooted.groupBy("root").agg(least.alias("component_id")))
    answers = written(rooted.join(named, "root").select("fp", "copies", "component_id"))
    return prints.join(answers, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies"
    )
