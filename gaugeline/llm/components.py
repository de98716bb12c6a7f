"""Connected components of edges between long identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import written


def components(edges: DataFrame, written: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(node, root) for every node of the (a, b) edges, the smallest node of a component being its root.

    ``written`` keeps the frames of a round. Checkpoints carry the estimated size of their plan on, which multiplies from
    round to round; over very many rounds, tables whose size is known anew serve better.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Minima are map-side
    aggregates; they are written before they are joined back, so both sides of that join come from plain shuffles and
    adaptive execution splits the partition of a node with very many neighbours.
    """
    current = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    )
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = current.unionByName(current.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = written(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m")))
        large = written(
            both.filter("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        )
        low = written(large.groupBy("node").agg(F.min("root").alias("m")))
        moved = large.join(low, "node").filter("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        current = written(moved.unionByName(low.select("node", F.col("m").alias("root"))).distinct())
    return current.unionByName(current.select(F.col("root").alias("node"), "root").distinct())
