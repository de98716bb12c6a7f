"""The written results: a versioned feed of report tables, and the snapshot manifest.

A feed is a folder with a data folder per table and a log of commits. What a commit writes goes to data folders of its own
(feed_write=<id>, below it one folder per codebase) that nobody reads until the commit's rows stand in the log, which is one
file, written last. Readers take the last version, or an earlier one, and find there which write holds each codebase's
rows; a commit replaces whole tables or the codebases at hand. A write that fails midway leaves the feed as it was. One
writer commits at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeline.operators.refresh import content_hash
from gaugeline.session import cut_lineage

LOG = "version long, write_id string, table string, part string, kind string, schema string"
ALL = "all"  # the part of a table without codebases


def part_of(codebase: Column) -> Column:
    """The name of a codebase's part; it tells null from any text and is never empty."""
    return F.coalesce(F.concat(F.lit("c:"), codebase.cast("string")), F.lit("none"))


def has_codebases(table: DataFrame) -> bool:
    return "codebase_id" in table.columns and len(table.columns) > 1


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The feed's commits as (version, write_id, table, part, kind, schema) rows; none where nothing was committed.

    kind: 'whole' (all earlier parts of the table end), 'cleared' (those of this codebase end) or 'rows' (the write holds
    rows of this part).
    """
    try:
        return spark.read.schema(LOG).parquet(f"{folder.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def last_version(spark: SparkSession, folder: str) -> int:
    """The last committed version, 0 for none."""
    return read_log(spark, folder).agg(F.max("version")).first()[0] or 0


def new_write() -> str:
    """The id of a write that is to be committed."""
    return uuid.uuid4().hex


def store(spark: SparkSession, folder: str, write_id: str, name: str, table: DataFrame) -> DataFrame:
    """Write a table's data before its commit and continue from there, so what is needed for other tables is written once."""
    parted = table.withColumn("feed_part", part_of(F.col("codebase_id")) if has_codebases(table) else F.lit(ALL))
    path = f"{folder.rstrip('/')}/{name}/feed_write={write_id}"
    parted.write.partitionBy("feed_part").option("compression", "zstd").parquet(path)
    return spark.read.schema(parted.schema).parquet(path).select(*table.columns)


def commit(
    spark: SparkSession,
    folder: str,
    changes: dict[str, tuple[DataFrame, DataFrame | None]],
    write_id: str | None = None,
    stored: Collection[str] = (),
) -> int:
    """Write tables as the feed's next version and return its number.

    ``changes`` gives by name a table and the codebases (codebase_id) whose rows it replaces, also where it has none left for
    them; without codebases, or without a codebase column, it replaces the whole table. Rows keep their order within a
    codebase. Tables named in ``stored`` were written under ``write_id`` by ``store`` and are not written again.
    """
    folder, write_id = folder.rstrip("/"), write_id or new_write()
    log = []
    for name, (table, codebases) in changes.items():
        split = has_codebases(table)
        if name not in stored:
            store(spark, folder, write_id, name, table)
        schema = F.lit(table.schema.json())
        table_name = F.lit(name).alias("table")
        rows = spark.read.schema("feed_part string").parquet(f"{folder}/{name}/feed_write={write_id}").select("feed_part").distinct()
        log.append(rows.select(table_name, F.col("feed_part").alias("part"), F.lit("rows").alias("kind"), schema.alias("schema")))
        if codebases is None or not split:
            ended = spark.range(1).select(table_name, F.lit(ALL).alias("part"), F.lit("whole").alias("kind"), schema.alias("schema"))
        else:
            part = part_of(F.col("codebase_id")).alias("part")
            ended = codebases.select(part).distinct().select(table_name, "part", F.lit("cleared").alias("kind"), schema.alias("schema"))
        log.append(ended)
    version = last_version(spark, folder) + 1
    lines = reduce(DataFrame.unionByName, log).select(F.lit(version).cast("long").alias("version"), F.lit(write_id).alias("write_id"), "*")
    cut_lineage(lines).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return version


def live_parts(log: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """(write_id, part): where the rows of a table stand, at the last version or an earlier one."""
    own = log.filter(F.col("table") == name)
    if version is not None:
        own = own.filter(F.col("version") <= version)
    whole = own.filter("kind = 'whole'").agg(F.max("version").alias("since"))
    cleared = own.filter("kind = 'cleared'").groupBy("part").agg(F.max("version").alias("cleared"))
    rows = own.filter("kind = 'rows'").join(whole).join(cleared, "part", "left")  # ``whole`` is one row
    since = F.greatest(F.coalesce("since", F.lit(0)), F.coalesce("cleared", F.lit(0)))
    return rows.filter(F.col("version") >= since).select("write_id", "part")


def write_report_tables(tables: dict[str, DataFrame], folder: str) -> int:
    """All tables as one version of the feed in ``folder``; each replaces the one before it."""
    spark = next(iter(tables.values())).sparkSession
    return commit(spark, folder, {name: (table, None) for name, table in tables.items()})


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    return not read_log(spark, folder).filter(F.col("table") == name).isEmpty()


def read_report_table(
    spark: SparkSession, folder: str, name: str, schema: StructType | None = None, version: int | None = None
) -> DataFrame:
    """A table of the feed, at its last version or an earlier one; empty ones keep their columns."""
    folder, log = folder.rstrip("/"), read_log(spark, folder)
    own = log.filter(F.col("table") == name)
    if version is not None:
        own = own.filter(F.col("version") <= version)
    last = own.agg(F.max_by("schema", "version")).first()[0]
    if last is None:
        raise ValueError(f"the feed has no table {name} at this version")
    schema = schema or StructType.fromJson(json.loads(last))
    parts = cut_lineage(live_parts(log, name, version))
    writes = [r[0] for r in parts.select("write_id").distinct().collect()]  # one for each commit that still holds rows
    stored = StructType(schema.fields).add("feed_write", "string").add("feed_part", "string")
    data = spark.read.schema(stored).parquet(f"{folder}/{name}").filter(F.col("feed_write").isin(writes))
    live = parts.select(F.col("write_id").alias("feed_write"), F.col("part").alias("feed_part"))
    return data.join(live, ["feed_write", "feed_part"], "left_semi").select(*schema.names)


def build_manifest(
    metas: DataFrame,
    ground_truth_files: DataFrame,
    prompts: DataFrame,
    files: DataFrame,
    pipeline: DataFrame,
    skills: DataFrame,
    config: DataFrame,
) -> DataFrame:
    """Snapshot provenance as (section, key, value) rows.

    ``metas`` holds codebase_id and condition_id per run, ``ground_truth_files`` codebase_id and content, ``prompts``
    name and content, ``files`` the archived file names, ``pipeline`` key and value of the code's state (commit, branch,
    uncommitted changes), ``skills`` name and version, ``config`` file and content of the run configuration.
    """
    blank = F.lit("")

    def rows(frame: DataFrame, section: str, key, value) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value")
        )

    codebase = F.coalesce(F.nullif(F.col("codebase_id").cast("string"), blank), F.lit("unknown"))
    per_codebase = metas.groupBy(codebase.alias("key")).agg(F.count("*").alias("runs"))
    codebases = metas.select(F.col("codebase_id").cast("string").alias("key")).filter("key <> ''").distinct()
    conditions = metas.select(F.col("condition_id").cast("string").alias("key")).filter("key <> ''").distinct()
    parts = [
        rows(codebases, "codebase", F.col("key"), F.lit(None)),
        rows(conditions, "condition", F.col("key"), F.lit(None)),
        rows(metas.agg(F.count("*").alias("n")), "runs", F.lit("total"), F.col("n")),
        rows(per_codebase, "runs_per_codebase", F.col("key"), F.col("runs")),
        rows(ground_truth_files, "ground_truth", F.col("codebase_id"), content_hash(F.col("content"))),
        rows(prompts, "prompt", F.col("name"), content_hash(F.col("content"))),
        rows(files, "file", F.col("file"), F.lit(None)),
        rows(pipeline, "pipeline", F.col("key"), F.col("value")),
        rows(skills, "skill_version", F.col("name"), F.col("version")),
        rows(config, "config", F.col("file"), F.col("content")),
    ]
    manifest = parts[0]
    for part in parts[1:]:
        manifest = manifest.unionByName(part)
    return manifest
