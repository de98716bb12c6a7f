"""Partitioning of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key before costly row work, so that it does not depend on how the table was written.

    Adaptive execution fits the number of partitions to the bytes. A stream is returned as it is.
    """
    return frame if frame.isStreaming else frame.repartition(key)
