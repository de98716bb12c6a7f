"""What has to be recomputed, and whether the inputs are fit for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exit codes of runs that produced usable output, and the form of a commit id.
USABLE_EXIT_CODES = [0, 143]
COMMIT = r"^[a-f0-9]{7,40}$"


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def rows_hash(*columns: str) -> Column:
    """Order-free hash of a group of rows, as an aggregate that combines map-side.

    Four 48-bit pieces of each row's SHA-256 are summed and the sums hashed with the row count, so a group is never
    collected or sorted.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    sums = [
        F.sum(F.conv(F.substring(row, start, 12), 16, 10).cast("decimal(20,0)")).cast("string")
        for start in (1, 13, 25, 37)
    ]
    return content_hash(F.concat_ws(":", F.count("*").cast("string"), *sums))


def stale_classifications(current: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Runs whose labels must be recomputed: a ground-truth, text or prompt hash differs or is missing."""
    if force:
        return current.select("run_id")
    hashes = ["gt_hash", "stdout_hash", "prompt_hash"]
    fresh = existing.select("run_id", *hashes)
    return current.select("run_id", *hashes).join(fresh, ["run_id", *hashes], "left_anti").select("run_id")


def cluster_input_hash(inputs: DataFrame, model: str, scope_files: bool = False) -> DataFrame:
    """Hash per codebase over its cluster inputs, the model and the scoping flag."""
    rows = inputs.groupBy("codebase_id").agg(
        rows_hash("run_id", "condition_id", "finding_index", "title", "reasoning").alias("rows")
    )
    return rows.select(
        "codebase_id", content_hash(F.concat("rows", F.lit(model), F.lit(str(scope_files).lower()))).alias("input_hash")
    )


def stale_clusters(hashes: DataFrame, existing: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Codebases whose clusters do not come from these inputs and this model."""
    if force:
        return hashes.select("codebase_id")
    fresh = existing.filter(F.col("cluster_model") == model).select("codebase_id", "input_hash")
    return hashes.join(fresh, ["codebase_id", "input_hash"], "left_anti").select("codebase_id")


def cluster_content_hash(clusters: DataFrame, members: DataFrame, model: str) -> DataFrame:
    """Hash per codebase over its clusters, their members and the validator model."""
    rows = clusters.select("codebase_id", "cluster_id", "title", F.lit(None).cast("string").alias("member")).unionByName(
        members.select(
            "codebase_id",
            "cluster_id",
            F.lit(None).cast("string").alias("title"),
            F.concat_ws("::", "run_id", "finding_index").alias("member"),
        )
    )
    return (
        rows.groupBy("codebase_id")
        .agg(rows_hash("cluster_id", "title", "member").alias("rows"))
        .select("codebase_id", content_hash(F.concat("rows", F.lit(model))).alias("cluster_hash"))
    )


def stale_validations(hashes: DataFrame, existing: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Codebases whose validations do not belong to these clusters and this model."""
    if force:
        return hashes.select("codebase_id")
    fresh = existing.filter(F.col("validator_model") == model).select("codebase_id", "cluster_hash")
    return hashes.join(fresh, ["codebase_id", "cluster_hash"], "left_anti").select("codebase_id")


def preflight(metas: DataFrame, texts: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Problems that would stop an analysis, as (file, reason) rows.

    ``metas`` holds file, valid_json, run_id, codebase_id, condition_id, exit_code; ``texts`` run_id, chars;
    ``ground_truth`` file, valid_json, has_findings. Metadata is read once: a file that asks for no text meets the texts under
    its own name, which finds none, so these files are spread too.
    """
    blank = F.lit("")
    named = (
        (F.coalesce("run_id", blank) != "")
        & (F.coalesce("codebase_id", blank) != "")
        & (F.coalesce("condition_id", blank) != "")
    )
    usable = F.coalesce(F.col("valid_json") & named & F.col("exit_code").isin(USABLE_EXIT_CODES), F.lit(False))
    meta_reason = F.when(~F.col("valid_json"), "invalid JSON").when(
        ~named, "missing required fields (runId, codebaseId, or conditionId)"
    )
    text_reason = F.when(
        F.col("chars").isNull(), "missing (meta says exit 0 but no stdout file)"
    ).when(F.col("chars") == 0, "empty file (0 bytes)")
    gt_reason = F.when(~F.col("valid_json"), "invalid JSON").when(
        ~F.col("has_findings"), 'missing or invalid "findings" array'
    )
    asks = F.when(usable, F.col("run_id")).otherwise(F.col("file"))
    wanted = metas.select("file", "run_id", meta_reason.alias("meta_reason"), usable.alias("usable"), asks.alias("asks"))
    found_texts = texts.select(F.col("run_id").alias("asks"), F.lit(True).alias("usable"), "chars")
    answered = wanted.join(found_texts, ["asks", "usable"], "left")
    text_file = F.concat("run_id", F.lit(".stdout.txt"))
    problems = [
        answered.select(
            F.when(F.col("usable"), text_file).otherwise(F.col("file")).alias("file"),
            F.when(F.col("usable"), text_reason).otherwise(F.col("meta_reason")).alias("reason"),
        ),
        ground_truth.select(F.concat(F.lit("ground_truth/"), "file").alias("file"), gt_reason.alias("reason")),
        metas.select("file").limit(1).agg(F.count("*").alias("n")).select(
            F.lit("results").alias("file"), F.when(F.col("n") == 0, "no .meta.json files found").alias("reason")
        ),
    ]
    found = problems[0]
    for more in problems[1:]:
        found = found.unionByName(more)
    return found.filter(F.col("reason").isNotNull())


def failed_rules(frame: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per rule that does not hold."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return frame.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def provenance_check(metas: DataFrame, texts: DataFrame, classifications: DataFrame) -> DataFrame:
    """Run metadata and label files that break a provenance rule, as (run_id, rule) rows."""

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    commit = F.col("codebase_git_commit")
    run_rules = {
        "identity": given("run_id") & given("codebase_id") & given("condition_id") & F.col("iteration").isNotNull(),
        "mode": F.col("mode").isin("bare", "skill"),
        "timing": F.try_to_timestamp("timestamp_utc").isNotNull()
        & F.col("duration_ms").isNotNull()
        & F.col("exit_code").isNotNull(),
        "skill_version": (F.col("mode") != "skill") | given("skill_version"),
        "commit": commit.isNull() | (commit == "") | commit.rlike(COMMIT),
        "run_id_codebase": F.col("run_id").contains(F.col("codebase_id")),
        "run_id_condition": F.col("run_id").contains(F.col("condition_id")),
        "text_exists": (F.col("exit_code") != 0) | F.col("has_text"),
    }
    with_text = metas.join(
        texts.select("run_id").distinct().withColumn("has_text", F.lit(True)), "run_id", "left"
    )
    prompt = F.col("prompt_hash")
    label_rules = {
        "label_keys": given("gt_hash") & given("stdout_hash") & given("classifier_model") & given("classified_at"),
        "prompt_hash": prompt.isNull() | (prompt == "") | prompt.rlike("^[a-f0-9]+$"),
    }
    return failed_rules(with_text, ["run_id"], run_rules).unionByName(
        failed_rules(classifications, ["run_id"], label_rules)
    )
