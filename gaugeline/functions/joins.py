"""Joins with tables that are usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

MAX_BROADCAST_BYTES = 8 << 20


def broadcast_if_small(frame: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast only after measuring that the frame has at most ``max_bytes``.

    Meant for narrow summaries. The frame is computed once, for the measure and for the join. A larger one is returned
    as written, and Spark shuffles the join.
    """
    written = cut_lineage(frame)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in written.columns), F.lit(0))
    return F.broadcast(written) if (written.agg(F.sum(width)).first()[0] or 0) <= max_bytes else written
