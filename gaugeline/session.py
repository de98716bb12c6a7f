"""Session helpers: a local session for tests and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    checkpoints = os.environ.get("GAUGELINE_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="gaugeline-checkpoint-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaugeline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", checkpoints)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("GAUGELINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession, clock: bool = True) -> SparkSession:
    """Another session of the application, for streams whose state has maps and timers: it is kept in RocksDB.

    With ``clock`` micro-batches go on without data, as timers by the clock need; without, a stream that is run over all
    available input ends there.
    """
    other = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set(STATE_STORE, ROCKSDB)
    other.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(clock).lower())
    return other


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; only a local session gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeline-checkpoint-")
    context.setCheckpointDir(folder)


def materialised(frame: DataFrame) -> DataFrame:
    """Write the frame as parquet to the shared checkpoint folder and continue from the table.

    For wide relations that are read several times: readers of a few columns read only these, with pushdown and
    statistics. Small frames, and those of iterations, go through ``cut_lineage``, whose files Spark cleans up.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """The disk of one piece of work: ``with Scratch(spark) as own`` removes the tables of ``own.table`` at the end.

    Until then, shuffle files of the session go with the query that wrote them instead of waiting for the driver to collect
    its garbage. A frame that is run twice is right all the same, as Spark writes them again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.cleanup = spark, {}, None

    def __enter__(self) -> Scratch:
        self.cleanup = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        return self

    def __exit__(self, *failure) -> None:
        if self.cleanup is None:
            self.spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            self.spark.conf.set(SHUFFLE_CLEANUP, self.cleanup)
        for path in self.paths.values():
            self._remove(path)
        self.paths = {}

    def table(self, frame: DataFrame) -> DataFrame:
        """As ``materialised``, until the work is over."""
        ensure_checkpoint_dir(self.spark)
        path = f"{self.spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        self.paths[None] = path  # also one whose write fails is removed
        frame.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[written] = self.paths.pop(None)
        return written

    def drop(self, table: DataFrame) -> None:
        """Remove a table before the end; nothing may read it any more."""
        self._remove(self.paths.pop(table))

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
