"""Run-to-run consistency: the mean pairwise Jaccard of matched ground-truth sets.

Equal sets are folded into one row with a count first. Sets of up to ``SMALL`` ids are never compared: two sets of a and b
ids that share s have s / (a + b - s) = sum over j of C(s, j) / C(a + b - 1, j), and C(s, j) counts the sets of j ids that both
hold, so their Jaccards are added up from the number of sets of each size that hold each set of ids, in work that grows with
the sets. Sets of up to ``LARGEST`` ids are added up the same way while all have 2 ** SMALL subsets at most on average, as
where sets are small and a few are not. The others are dealt into tiles by hash, and small ones into tiles beside them; for each pair of tiles with a large
one a task holds it as a bit matrix and streams the other past it, counting all intersections at once, and gives back a
single partial sum. No pair of sets is ever a row; a set is sent once for each tile it meets, of 65,536 sets unless their ids
are very many.
"""

from __future__ import annotations

import sys
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.session import cut_lineage

# The tile function travels with the query, so executors do not need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["codebase_id", "condition_id"]
TILE = 1 << 16  # sets
TILE_BITS = 1 << 29  # of a tile's matrix, 64 MB
CELLS = 1 << 20  # intersections counted at once
SMALL = 6  # ids of a set that is compared by its subsets, of which there are 2 ** SMALL at most
LARGEST = 12  # ids of a set that may be compared by its subsets where most sets have fewer


def matched_sets(runs: DataFrame, labels: DataFrame, gt: DataFrame) -> DataFrame:
    """Distinct sets of matched ids per (codebase, condition) with the number of runs that share each set."""
    eligible = (
        runs.filter("is_valid and is_classified")
        .join(broadcast_if_small(gt.select("codebase_id").distinct()), "codebase_id", "left_semi")
        .select(*KEYS, "run_id")
    )
    ids = (
        labels.filter(F.col("matched_gt_id").isNotNull())
        .select("run_id", F.col("matched_gt_id").alias("gt_id"))
        .distinct()
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list("gt_id")).alias("ids"))
    )
    empty = F.array().cast(ids.schema["ids"].dataType)
    return (
        eligible.join(ids, "run_id", "left")
        .select(*KEYS, F.coalesce("ids", empty).alias("ids"))
        .groupBy(*KEYS, "ids")
        .agg(F.count("*").alias("m"))
    )


class Tile:
    """The sets of one tile as a bit matrix over the ids that occur in it."""

    def __init__(self, rows: pd.DataFrame):
        self.counts = rows["m"].to_numpy(dtype=np.float64)
        self.sizes = rows["ids"].map(len).to_numpy(dtype=np.int64)
        self.ids = pd.Index(pd.unique(rows["ids"].explode().dropna()))
        self.bits = self.packed(rows)

    def packed(self, rows: pd.DataFrame) -> np.ndarray:
        """The rows as words of bits, one per id of the tile; other ids have none."""
        words = max(1, -(-len(self.ids) // 64))
        out = np.zeros((len(rows), words * 8), dtype=np.uint8)
        for at in range(0, len(rows), 1024):
            part = rows["ids"].iloc[at : at + 1024]
            cells = np.zeros((len(part), words * 64), dtype=bool)
            owners = np.repeat(np.arange(len(part)), part.map(len))
            columns = self.ids.get_indexer(np.concatenate([np.asarray(x) for x in part])) if len(owners) else owners
            cells[owners[columns >= 0], columns[columns >= 0]] = True
            out[at : at + 1024] = np.packbits(cells, axis=1)
        return out.view(np.uint64)

    def step(self) -> int:
        return max(1, CELLS // max(1, len(self.counts)))

    def scores(self, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The Jaccards of some sets with all of the tile; two empty sets agree fully."""
        shared = np.zeros((len(bits), len(self.bits)), dtype=np.int64)
        for word in range(bits.shape[1]):
            shared += np.bitwise_count(bits[:, word, None] & self.bits[None, :, word])
        either = sizes[:, None] + self.sizes[None, :] - shared
        return np.divide(shared, either, out=np.ones(shared.shape), where=either > 0)

    def with_others(self, rows: pd.DataFrame) -> float:
        total = 0.0
        for at in range(0, len(rows), self.step()):
            part = rows.iloc[at : at + self.step()]
            scores = self.scores(self.packed(part), part["ids"].map(len).to_numpy(dtype=np.int64))
            total += float(part["m"].to_numpy(dtype=np.float64) @ scores @ self.counts)
        return total

    def within(self) -> float:
        """The sum over the pairs of runs of the tile itself, each pair once; runs with the same set agree fully."""
        total = float((self.counts * (self.counts - 1) / 2).sum())
        for at in range(0, len(self.counts), self.step()):
            end = min(at + self.step(), len(self.counts))
            scores = np.triu(self.scores(self.bits[at:end], self.sizes[at:end]), at + 1)
            total += float(self.counts[at:end] @ scores @ self.counts)
        return total


def tile_totals(batches):
    """Partial sums per pair of tiles; rows come ordered by (keys, i, j, side), the held tile (side 0) first."""
    held, tile, key, total = [], None, None, 0.0

    def finish():
        values = [pa.array([v], t) for v, t in zip(key[:2], kinds)]
        own = tile or (Tile(pd.concat(held)) if held else None)
        found = own.within() if own is not None and key[2] == key[3] else total
        return pa.RecordBatch.from_arrays([*values, pa.array([float(found)])], names=[*KEYS, "total"])

    for batch in batches:
        kinds = [batch.schema.field(k).type for k in KEYS]
        frame = batch.to_pandas()
        for mine, rows in frame.groupby([*KEYS, "i", "j", "side"], sort=False, dropna=False):
            if mine[:4] != key:
                if key is not None:
                    yield finish()
                held, tile, key, total = [], None, mine[:4], 0.0
            if mine[4] == 0:
                held.append(rows)
            elif held:
                tile = tile or Tile(pd.concat(held))
                total += tile.with_others(rows)
    if key is not None:
        yield finish()


def in_tiles(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The sets dealt to the pairs of tiles (i, j), i <= j; side 0 is tile i."""
    own = F.pmod(F.xxhash64("ids"), F.col("tiles")).cast("int")
    return (
        sets.join(broadcast_if_small(sizes), KEYS)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            *KEYS,
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "ids",
            "m",
        )
    )


def tile_sizes(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Runs (n) and tiles per (codebase, condition): tiles of up to ``tile`` sets and TILE_BITS bits."""
    widths = sets.select(*KEYS, F.explode("ids").alias("id")).groupBy(*KEYS).agg(F.count_distinct("id").alias("width"))
    counts = sets.groupBy(*KEYS).agg(F.sum("m").cast("double").alias("n"), F.count("*").alias("sets")).join(widths, KEYS, "left")
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BITS) / F.coalesce("width", F.lit(1)))))
    return counts.select(*KEYS, "n", F.ceil(F.col("sets") / most).cast("int").alias("tiles"))


def beside_tiles(large: DataFrame, small: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of a tile i of large sets (side 0) and a tile j of small ones, which are numbered after the large ones."""
    counts = small.groupBy(*KEYS).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("more"))
    deals = broadcast_if_small(sizes.join(counts, KEYS).select(*KEYS, "tiles", "more"))

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("ids"), F.col(count)).cast("int")

    after = F.explode(F.sequence(F.col("tiles"), F.col("tiles") + F.col("more") - 1))
    held = large.join(deals, KEYS).withColumn("j", after).withColumn("i", own("tiles")).withColumn("side", F.lit(0))
    before = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    past = small.join(deals, KEYS).withColumn("i", before).withColumn("j", F.col("tiles") + own("more")).withColumn("side", F.lit(1))
    columns = [*KEYS, "i", "j", "side", "ids", "m"]
    return held.select(*columns).unionByName(past.select(*columns))


def small_totals(sets: DataFrame, most: int) -> DataFrame:
    """Sum of the Jaccards of all pairs of runs whose sets have up to ``most`` ids, per (codebase, condition)."""
    none = F.array(F.array().cast(sets.schema["ids"].dataType))
    subsets = F.aggregate("ids", none, lambda found, x: F.concat(found, F.transform(found, lambda part: F.array_append(part, x))))
    parts = sets.select(*KEYS, F.explode(subsets).alias("part"), F.size("ids").alias("size"), F.col("m").cast("double").alias("m"))
    holders = [F.sum(F.when(F.col("size") == a, F.col("m")).otherwise(0.0)).alias(f"n{a}") for a in range(1, most + 1)]
    counts = parts.filter(F.size("part") > 0).groupBy(*KEYS, "part").agg(*holders)

    def pairs(a: int, b: int) -> Column:
        return F.col(f"n{a}") * (F.col(f"n{a}") - 1) / 2 if a == b else F.col(f"n{a}") * F.col(f"n{b}")

    def share(both: int) -> Column:
        values = [1 / comb(both - 1, j) if j < both else 0.0 for j in range(1, most + 1)]
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.size("part"))

    found = {(a, b): pairs(a, b) for a in range(1, most + 1) for b in range(a, most + 1)}
    total = sum((n * share(a + b) for (a, b), n in found.items()), F.lit(0.0))
    return counts.groupBy(*KEYS).agg(F.sum(total).alias("total"))


def by_subsets(sets: DataFrame) -> int:
    """The most ids of a set to compare by its subsets: SMALL, or up to LARGEST where that keeps 2 ** SMALL subsets a set."""
    counts = sets.groupBy(F.size("ids").alias("size")).agg(F.count("*").alias("n")).filter(F.col("size").between(1, LARGEST))
    found = {row["size"]: row["n"] for row in counts.collect()}
    most = SMALL
    for size in sorted(size for size in found if size > SMALL):
        upto = {a: n for a, n in found.items() if a <= size}
        if sum(n << a for a, n in upto.items()) > sum(upto.values()) << SMALL:
            break
        most = size
    return most


def consistency_jaccard(runs: DataFrame, labels: DataFrame, gt: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean pairwise Jaccard per (codebase, condition); two empty sets agree fully, fewer than two runs give null."""
    sets = cut_lineage(matched_sets(runs, labels, gt))
    n = F.col("m").cast("double")
    empty = F.sum(F.when(F.size("ids") == 0, n).otherwise(0.0))
    counts = sets.groupBy(*KEYS).agg(F.sum(n).alias("n"), (empty * (empty - 1) / 2).alias("total"))
    most = by_subsets(sets)
    few = sets.filter(F.size("ids").between(1, most))
    parts = counts.select(*KEYS, "total").unionByName(small_totals(few, most))
    many = sets.filter(F.size("ids") > most)
    if not many.isEmpty():
        sizes = cut_lineage(tile_sizes(many, tile).select(*KEYS, "tiles"))
        kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
        keys = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
        dealt = in_tiles(many, sizes).unionByName(beside_tiles(many, few, sizes, tile))
        pairs = dealt.repartition(*KEYS, "i", "j").sortWithinPartitions(*KEYS, "i", "j", "side")
        parts = parts.unionByName(pairs.mapInArrow(tile_totals, f"{keys}, total double"))
    sums = parts.groupBy(*KEYS).agg(F.sum("total").alias("total"))
    mean = F.when(F.col("n") >= 2, F.coalesce("total", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2))
    return counts.drop("total").join(sums, KEYS, "left").select(*KEYS, mean.alias("consistency"))
