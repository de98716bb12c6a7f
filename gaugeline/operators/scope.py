"""Source scoping and contamination checks.

Inputs: scope(codebase_id, path, in_scope), source_files(codebase_id, path, content), reports(run_id, text),
runs(run_id, codebase_id, condition_id, mode) and message blocks from ``logs.content_blocks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.joins import MAX_BROADCAST_BYTES, broadcast_if_small
from gaugeline.operators.logs import tool_uses

# Contract names too general to search for, and the shortest name worth searching.
GENERIC_NAMES = [
    "Errors", "Utils", "Base", "Common", "Constants", "Types", "Events",
    "Helpers", "Math", "SafeMath", "Context", "Storage", "Proxy", "Test",
]
MIN_NAME_CHARS = 5
LARGE_SOURCE_CHARS = 200_000
CANARY = r"BENCHMARK_CANARY_[A-Z0-9_-]+_[a-z0-9]+"


def scoped_levels(clusters: DataFrame, scope: DataFrame, source_files: DataFrame) -> DataFrame:
    """What each cluster is judged on: (codebase_id, cluster_id, level); clusters without any source have no row.

    Level 1 are the cluster's own relevant files that exist, level 2 the scope list, level 3 every file.
    """
    keys = ["codebase_id", "cluster_id"]
    own = _own_files(clusters, source_files).select(*keys).distinct().withColumn("_own", F.lit(True))
    listed = _listed_files(scope, source_files).select("codebase_id").distinct().withColumn("_listed", F.lit(True))
    present = source_files.select("codebase_id").distinct().withColumn("_present", F.lit(True))
    level = F.when(F.col("_own"), 1).when(F.col("_listed"), 2).when(F.col("_present"), 3)
    return (
        clusters.select(*keys)
        .join(own, keys, "left")
        .join(broadcast_if_small(listed, MAX_BROADCAST_BYTES), "codebase_id", "left")
        .join(broadcast_if_small(present, MAX_BROADCAST_BYTES), "codebase_id", "left")
        .select(*keys, level.alias("level"))
        .filter(F.col("level").isNotNull())
    )


def _own_files(clusters: DataFrame, source_files: DataFrame) -> DataFrame:
    return (
        clusters.select("codebase_id", "cluster_id", F.explode("relevant_files").alias("path"))
        .join(source_files.select("codebase_id", "path"), ["codebase_id", "path"], "left_semi")
        .distinct()
    )


def _listed_files(scope: DataFrame, source_files: DataFrame) -> DataFrame:
    listed = scope.filter(F.col("in_scope") & F.col("path").endswith(".sol")).select("codebase_id", "path").distinct()
    return listed.join(source_files.select("codebase_id", "path"), ["codebase_id", "path"], "left_semi")


def scoped_files(levels: DataFrame, clusters: DataFrame, scope: DataFrame, source_files: DataFrame) -> DataFrame:
    """The files of each level in use: (codebase_id, level, cluster_id, path).

    Own files are listed per cluster. The scope list and the whole source are the same for all clusters of a codebase
    and listed once, with a null cluster_id, so the rows grow with clusters plus files.
    """
    used = broadcast_if_small(levels.select("codebase_id", "level").distinct(), MAX_BROADCAST_BYTES)
    nobody = F.lit(None).cast(clusters.schema["cluster_id"].dataType).alias("cluster_id")
    shared = (
        _listed_files(scope, source_files)
        .select("codebase_id", F.lit(2).alias("level"), nobody, "path")
        .unionByName(source_files.select("codebase_id", F.lit(3).alias("level"), nobody, "path"))
        .join(used, ["codebase_id", "level"], "left_semi")
    )
    own = _own_files(clusters, source_files).select("codebase_id", F.lit(1).alias("level"), "cluster_id", "path")
    return own.unionByName(shared)


def scoped_sections(files: DataFrame, source_files: DataFrame) -> DataFrame:
    """The judged source, one section with a path banner per row of ``scoped_files``."""
    section = F.concat(F.lit("// ═══ "), "path", F.lit(" ═══\n\n"), "content")
    return files.join(source_files, ["codebase_id", "path"]).select(
        "codebase_id", "level", "cluster_id", "path", section.alias("section")
    )


def scoped_sizes(levels: DataFrame, files: DataFrame, source_files: DataFrame) -> DataFrame:
    """Files and characters per cluster; ``too_large`` warns when an unscoped source is very long."""
    banner = F.length(F.concat(F.lit("// ═══ "), "path", F.lit(" ═══\n\n")))
    sizes = source_files.select("codebase_id", "path", (banner + F.length("content")).alias("chars"))
    total = F.sum("chars") + 2 * (F.count("*") - 1)
    keys = ["codebase_id", "level"]
    totals = (
        files.join(sizes, ["codebase_id", "path"])
        .groupBy(*keys, "cluster_id")
        .agg(F.count("*").alias("files"), total.alias("chars"))
    )
    own = levels.filter("level = 1").join(totals.filter("level = 1"), [*keys, "cluster_id"])
    shared = levels.filter("level > 1").join(
        broadcast_if_small(totals.filter("level > 1").drop("cluster_id"), MAX_BROADCAST_BYTES), keys
    )
    return (
        own.unionByName(shared)
        .select("codebase_id", "cluster_id", "level", "files", "chars")
        .withColumn("too_large", (F.col("level") == 3) & (F.col("chars") > LARGE_SOURCE_CHARS))
    )


def oos_names(scope: DataFrame) -> DataFrame:
    """Names of out-of-scope contracts that are specific enough to search for."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.sol", "")
    return (
        scope.filter(~F.col("in_scope") & F.col("path").endswith(".sol"))
        .select("codebase_id", base.alias("name"))
        .filter((F.length("name") >= MIN_NAME_CHARS) & ~F.col("name").isin(GENERIC_NAMES))
        .distinct()
    )


def _mention(name: Column) -> Column:
    """Pattern for a name as a file, as ``contract N`` or after ``finding`` on the same line."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    start, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    return F.concat(
        F.lit(f"(?i){start}"), quoted, F.lit(rf"\.sol{end}|{start}contract\s+"), quoted,
        F.lit(rf"{end}|{start}finding.*{start}"), quoted, F.lit(end),
    )


def oos_mentions(reports: DataFrame, runs: DataFrame, names: DataFrame) -> DataFrame:
    """Out-of-scope contracts a report mentions.

    A mentioned name shows up among the words of the text, so the distinct words of a text meet the names of its codebase
    by their first word; only these candidates are checked against the patterns.
    """
    owned = runs.select("run_id", "codebase_id")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))))
    keyed = names.withColumn("word", F.lower(F.regexp_extract("name", r"\w+", 0)))
    candidates = (
        reports.join(owned, "run_id")
        .select("run_id", "codebase_id", words.alias("word"))
        .join(keyed, ["codebase_id", "word"])
        .groupBy("run_id")
        .agg(F.collect_set("name").alias("names"))  # names that a text holds: at most its words
    )
    found = F.filter("names", lambda name: F.rlike(F.col("text"), _mention(name)))
    return reports.join(candidates, "run_id").select("run_id", F.explode(found).alias("name"))


def files_read(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct source files a run read, relative to its workspace folder, else the last two path parts."""
    path = F.col("input")["file_path"]
    reads = (
        tool_uses(blocks)
        .filter((F.col("name") == "Read") & path.endswith(".sol"))
        .select("run_id", path.alias("file"))
        .join(runs.select("run_id", "condition_id"), "run_id")
    )
    marker = F.concat("condition_id", F.lit("/"))
    place = F.instr(F.col("file"), marker)
    inside = F.expr("substring(file, instr(file, concat(condition_id, '/')) + length(condition_id) + 1)")
    relative = F.when(place > 0, inside).otherwise(F.substring_index("file", "/", -2))
    return reads.select("run_id", relative.alias("path")).distinct()


def scope_compliance(reads: DataFrame, runs: DataFrame, scope: DataFrame) -> DataFrame:
    """Per run of a codebase with a scope list: files read in scope, out of scope and in total."""
    counted = scope.filter("in_scope").groupBy("codebase_id").agg(F.count("*").alias("in_scope_files"))
    listed = broadcast_if_small(counted, MAX_BROADCAST_BYTES)
    marks = scope.groupBy("codebase_id", "path").agg(
        F.bool_or("in_scope").alias("is_in"), F.bool_or(~F.col("in_scope")).alias("is_out")
    )
    counted = (
        reads.join(runs.select("run_id", "codebase_id"), "run_id")
        .join(marks, ["codebase_id", "path"], "left")
        .groupBy("run_id")
        .agg(
            F.count("*").alias("files_read"),
            F.count_if("is_in").alias("in_scope_read"),
            F.count_if("is_out").alias("out_of_scope_read"),
        )
    )
    return (
        runs.select("run_id", "codebase_id", "mode")
        .join(listed, "codebase_id")
        .join(counted, "run_id", "left")
        .na.fill(0, ["files_read", "in_scope_read", "out_of_scope_read"])
        .withColumn("ok", F.col("in_scope_read") > 0)
    )


def canary_leak(texts: DataFrame, runs: DataFrame, canaries: DataFrame) -> DataFrame:
    """Control strings of a skill that show up in the text or events of a bare run of the same codebase.

    ``texts`` holds run_id and text (several rows per run are fine), ``canaries`` codebase_id, condition_id, canary.
    The strings have a fixed form, so they are cut out of the text and joined by value.
    """
    bare = runs.filter("mode = 'bare'").select("run_id", "codebase_id")
    seen = (
        texts.filter(F.col("text").contains("BENCHMARK_CANARY_"))
        .select("run_id", F.explode(F.regexp_extract_all("text", F.lit(CANARY), F.lit(0))).alias("canary"))
        .distinct()
    )
    return (
        seen.join(bare, "run_id")
        .join(canaries, ["codebase_id", "canary"])
        .select("run_id", "codebase_id", "condition_id", "canary")
    )
