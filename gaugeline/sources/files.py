"""Reading the result folders: one file per run or codebase, parsed with explicit schemas.

Every scan is two steps: ``read_files`` lists and loads whole files, ``parse_*`` turns (file, content) rows into typed
rows. The parse steps also work on any DataFrame with those two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import schemas
from gaugeline.functions.ordering import numbered
from gaugeline.functions.text import trimmed
from gaugeline.operators.refresh import USABLE_EXIT_CODES

# Folders that hold no audited source.
SKIPPED_FOLDERS = ["node_modules", "test", "tests"]


def read_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """Whole files as (path, file, content); a folder without such files gives no rows."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")
    )


def stem(suffix: str) -> Column:
    """The file name without its suffix."""
    return F.expr(f"left(file, length(file) - {len(suffix)})")


def parsed_json(files: DataFrame, schema: str) -> DataFrame:
    """Files that hold valid JSON, parsed into ``j``."""
    return files.filter(F.try_parse_json("content").isNotNull()).withColumn("j", F.from_json("content", schema))


def parse_run_meta(files: DataFrame) -> DataFrame:
    """Run metadata; the timestamp is kept as written and as a timestamp."""
    j = F.col("j")
    return parsed_json(files, schemas.RUN_META).select(
        j["runId"].alias("run_id"),
        j["codebaseId"].alias("codebase_id"),
        j["conditionId"].alias("condition_id"),
        j["iteration"].alias("iteration"),
        j["mode"].alias("mode"),
        j["timestampUtc"].alias("timestamp_utc"),
        F.try_to_timestamp(j["timestampUtc"]).alias("ts"),
        j["durationMs"].alias("duration_ms"),
        j["exitCode"].alias("exit_code"),
        F.coalesce(j["timedOut"], F.lit(False)).alias("timed_out"),
        j["expectedMinAgents"].alias("expected_min_agents"),
        j["codebaseGitCommit"].alias("codebase_git_commit"),
        j["skillVersion"].alias("skill_version"),
        F.coalesce(j["claudeModel"], j["model"]).alias("model"),
    )


def check_run_meta(files: DataFrame) -> DataFrame:
    """Every metadata file with whether it is valid JSON and its identity fields, for the preflight check."""
    j = F.from_json("content", schemas.RUN_META)
    return files.select("file", F.try_parse_json("content").isNotNull().alias("valid_json"), j.alias("j")).select(
        "file",
        "valid_json",
        F.col("j.runId").alias("run_id"),
        F.col("j.codebaseId").alias("codebase_id"),
        F.col("j.conditionId").alias("condition_id"),
        F.col("j.exitCode").alias("exit_code"),
    )


def check_ground_truth(files: DataFrame) -> DataFrame:
    """Every ground-truth file with whether it is valid JSON and lists findings."""
    document = F.try_parse_json("content")
    findings = F.try_variant_get(document, "$.findings", "array<variant>")
    return files.select(
        "file", document.isNotNull().alias("valid_json"), findings.isNotNull().alias("has_findings")
    )


def usable_runs(metas: DataFrame, texts: DataFrame) -> DataFrame:
    """Runs that ended usably and have a text."""
    return metas.filter(F.col("exit_code").isin(USABLE_EXIT_CODES)).join(texts.select("run_id"), "run_id", "left_semi")


def parse_run_text(files: DataFrame) -> DataFrame:
    return files.select(stem(".stdout.txt").alias("run_id"), F.col("content").alias("text"))


def read_event_lines(spark: SparkSession, folder: str, pattern: str = "*.events.jsonl") -> DataFrame:
    """Event log lines (run_id, seq, raw) in file order, read split by split, so a long log is many tasks.

    A line's place is the start of its split and its order within it; exact numbers come from ``numbered``.
    """
    lines = spark.read.text(folder, pathGlobFilter=pattern).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").alias("raw"),
        F.monotonically_increasing_id().alias("place"),
    )
    placed = lines.select(stem(".events.jsonl").alias("run_id"), "split", "place", "raw")
    return numbered(placed, ["run_id"], ["split", "place"], "seq").select("run_id", (F.col("seq") - 1).alias("seq"), "raw")


def parse_event_lines(files: DataFrame) -> DataFrame:
    """Event log lines in file order, out of whole files as (file, content); ``read_event_lines`` splits long logs."""
    return files.select(
        stem(".events.jsonl").alias("run_id"), F.posexplode(F.split("content", "\n")).alias("seq", "raw")
    ).withColumn("seq", F.col("seq").cast("long"))


def parse_ground_truth(files: DataFrame) -> DataFrame:
    """Ground-truth items in file order; a file that lists nothing keeps one row with a null gt_id."""
    g = F.col("g")
    return (
        parsed_json(files, schemas.GROUND_TRUTH)
        .select(stem(".json").alias("codebase_id"), F.posexplode_outer("j.findings").alias("gt_pos", "g"))
        .select(
            "codebase_id",
            g["id"].alias("gt_id"),
            "gt_pos",
            g["severity"].alias("severity"),
            F.coalesce(g["title"], g["description"]).alias("title"),
            g["location"].alias("location"),
            g["rootCause"].alias("root_cause"),
            g["description"].alias("description"),
        )
    )


def parse_classification_headers(files: DataFrame) -> DataFrame:
    """One row per label file: a run with a row here is classified, even with no labels."""
    j = F.col("j")
    return parsed_json(files, schemas.CLASSIFICATIONS).select(
        j["runId"].alias("run_id"),
        j["codebaseId"].alias("codebase_id"),
        j["conditionId"].alias("condition_id"),
        j["classifierModel"].alias("classifier_model"),
        j["classifiedAt"].alias("classified_at"),
        j["gtHash"].alias("gt_hash"),
        j["stdoutHash"].alias("stdout_hash"),
        j["promptHash"].alias("prompt_hash"),
        F.coalesce(F.size("j.classifications"), F.lit(0)).alias("label_count"),
    )


def parse_labels(files: DataFrame) -> DataFrame:
    """Labels in file order."""
    c = F.col("c")
    return (
        parsed_json(files, schemas.CLASSIFICATIONS)
        .select("j.runId", "j.codebaseId", "j.conditionId", F.posexplode("j.classifications").alias("position", "c"))
        .select(
            F.col("runId").alias("run_id"),
            F.col("codebaseId").alias("codebase_id"),
            F.col("conditionId").alias("condition_id"),
            "position",
            c["findingIndex"].alias("finding_index"),
            c["findingTitle"].alias("title"),
            c["category"].alias("category"),
            c["matchedGtId"].alias("matched_gt_id"),
            c["agreement"].alias("agreement"),
            c["reasoning"].alias("reasoning"),
        )
    )


def _cluster_files(files: DataFrame) -> DataFrame:
    """One cluster file per codebase: ``clusters-*`` before the older ``novel-clusters-*``."""
    legacy = F.col("file").startswith("novel-")
    return (
        parsed_json(files, schemas.CLUSTERS)
        .withColumn("codebase_id", F.regexp_extract("file", r"^(?:novel-)?clusters-(.*)\.json$", 1))
        .groupBy("codebase_id")
        .agg(F.min_by("j", legacy.cast("int")).alias("j"))
    )


def parse_clusters(files: DataFrame) -> DataFrame:
    c = F.col("c")
    return (
        _cluster_files(files)
        .select("codebase_id", F.posexplode("j.clusters").alias("position", "c"))
        .select(
            "codebase_id",
            "position",
            c["clusterId"].alias("cluster_id"),
            c["title"].alias("title"),
            c["reasoning"].alias("reasoning"),
            c["severity"].alias("severity"),
            c["conditionsCaught"].alias("conditions_caught"),
            c["relevantFiles"].alias("relevant_files"),
        )
    )


def parse_cluster_members(files: DataFrame) -> DataFrame:
    return (
        _cluster_files(files)
        .select("codebase_id", F.explode("j.clusters").alias("c"))
        .select("codebase_id", F.col("c.clusterId").alias("cluster_id"), F.explode("c.foundIn").alias("m"))
        .select(
            "codebase_id",
            "cluster_id",
            F.col("m.runId").alias("run_id"),
            F.col("m.conditionId").alias("condition_id"),
            F.col("m.findingIndex").alias("finding_index"),
            F.col("m.findingTitle").alias("title"),
        )
    )


def cluster_conditions(clusters: DataFrame) -> DataFrame:
    return clusters.select("codebase_id", "cluster_id", F.explode("conditions_caught").alias("condition_id")).distinct()


def parse_validations(files: DataFrame) -> DataFrame:
    v = F.col("v")
    return (
        parsed_json(files, schemas.VALIDATIONS)
        .select(
            F.regexp_extract("file", r"^validations-(.*)\.json$", 1).alias("codebase_id"),
            F.posexplode("j.validations").alias("pos", "v"),
        )
        .select(
            "codebase_id",
            "pos",
            v["clusterId"].alias("cluster_id"),
            v["title"].alias("title"),
            v["verdict"].alias("verdict"),
            v["severity"].alias("severity"),
            v["reasoning"].alias("reasoning"),
            v["codeEvidence"].alias("code_evidence"),
            F.nullif(v["riskCategory"], F.lit("")).alias("risk_category"),
        )
    )


def parse_conditions(files: DataFrame) -> DataFrame:
    """The configured conditions in order, with label and subtitle."""
    c = F.col("c")
    rows = (
        parsed_json(files, schemas.CONFIG)
        .select(F.posexplode("j.conditions").alias("position", "c"))
        .select(c["id"].alias("condition_id"), c["type"].alias("type"), "position")
    )
    return rows.withColumns(condition_names(F.col("condition_id"), F.col("type")))


def parse_codebases(files: DataFrame) -> DataFrame:
    return (
        parsed_json(files, schemas.CONFIG)
        .select(F.posexplode("j.codebases").alias("position", "c"))
        .select(F.col("c.id").alias("codebase_id"), "position", F.col("c.path").alias("path"),
                F.col("c.gitCommit").alias("git_commit"))
    )


def condition_names(condition_id: Column, kind: Column) -> dict[str, Column]:
    """Label (a capital wherever an ASCII word starts, the rest as written) and subtitle; null kind: not configured."""
    words = F.transform(
        F.split(F.regexp_replace(condition_id, "[-_]", " "), "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"),
        lambda word: F.when(
            word.rlike("^[a-z]"), F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 2**31 - 1))
        ).otherwise(word),
    )
    return {
        "label": F.when(kind == "bare", "Bare CC")
        .when(kind.isNotNull(), F.array_join(words, ""))
        .otherwise(condition_id),
        "subtitle": F.when(kind == "bare", "No skill, audit prompt only")
        .when(kind.isNotNull(), F.concat(condition_id, F.lit(" skill")))
        .otherwise(F.lit("")),
    }


def parse_scope(files: DataFrame) -> DataFrame:
    """Scope lists as (codebase_id, path, in_scope) rows; the codebase is the folder of the list."""
    lines = files.select(
        F.element_at(F.split("path", "/"), -2).alias("codebase_id"),
        (F.col("file") == "scope.txt").alias("in_scope"),
        F.explode(F.split("content", "\n")).alias("line"),
    )
    listed = lines.filter(F.col("in_scope").isNotNull() & (trimmed(F.col("line")) != ""))
    return listed.select("codebase_id", F.regexp_replace(trimmed(F.col("line")), r"^\./", "").alias("path"), "in_scope")


def parse_source_files(files: DataFrame, root: str) -> DataFrame:
    """Source files below ``root``/<codebase>, without hidden, dependency and test folders."""
    below = F.split(F.element_at(F.split("path", F.lit(rf"\Q{root.rstrip('/')}/\E")), -1), "/")
    folders = F.slice(below, 2, F.greatest(F.size(below) - 2, F.lit(0)))
    skipped = F.exists(folders, lambda name: name.startswith(".") | name.isin(SKIPPED_FOLDERS))
    return (
        files.withColumn("below", below)
        .filter((F.size("below") >= 2) & F.col("file").endswith(".sol") & ~skipped)
        .select(
            F.get("below", F.lit(0)).alias("codebase_id"),
            F.array_join(F.slice("below", 2, 2**31 - 1), "/").alias("path"),
            "content",
        )
    )


def parse_eval_ground_truth(files: DataFrame) -> DataFrame:
    """``FINDING | key: value | …`` lines with the description line that follows each."""
    lines = files.select("file", F.split("content", "\n").alias("lines"))
    pairs = F.transform(
        F.col("lines"),
        lambda line, index: F.when(
            line.startswith("FINDING |"),
            F.struct(
                index.alias("gt_pos"),
                F.str_to_map(F.substring(line, 11, 2**31 - 1), F.lit(r"\s*\|\s*"), F.lit(r":\s*")).alias("f"),
                F.get(F.col("lines"), index + 1).alias("next"),
            ),
        ),
    )
    f = F.col("f")
    return (
        lines.select("file", F.inline(F.array_compact(pairs)))
        .select(
            F.regexp_replace("file", r"\.md$", "").alias("codebase_id"),
            f["id"].alias("gt_id"),
            "gt_pos",
            f["severity"].alias("severity"),
            f["contract"].alias("contract"),
            f["function"].alias("function"),
            f["bug_class"].alias("bug_class"),
            F.when(F.col("next").startswith("description:"), F.trim(F.substring("next", 13, 2**31 - 1))).alias("description"),
        )
    )
