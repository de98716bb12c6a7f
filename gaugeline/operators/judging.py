"""Request and response tables around a judge; the judge itself is an external service and not part of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.functions.ordering import numbered
from gaugeline.session import materialised

# Findings per clustering request, attempts, and failures worth another attempt.
FULL_CHUNK = 15
INCREMENTAL_CHUNK = 5
MAX_ATTEMPTS = {"classify": 2, "cluster": 3, "validate": 2}
RETRIED_ERRORS = ["exit", "parse", "timeout"]

# Reply schemas with the values their fields may take.
CLASSIFY_REPLY = "struct<matchedGtId:string,category:string,confidence:string,reasoning:string>"
CLASSIFY_ENUMS = {"category": ["matched", "novel", "fp"], "confidence": ["high", "medium", "low"]}
VALIDATE_REPLY = "struct<verdict:string,severity:string,reasoning:string,codeEvidence:string,riskCategory:string>"
VALIDATE_ENUMS = {
    "verdict": ["confirmed", "plausible", "rejected"],
    "severity": ["critical", "high", "medium", "low"],
}
VALIDATE_OPTIONAL_ENUMS = {"riskCategory": ["centralization-risk", "informational"]}


def gt_sections(gt: DataFrame) -> DataFrame:
    """The ground-truth part of a classification request: one text block per item, in order of ``gt_pos``."""

    def given(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    block = F.concat(
        F.lit("### "), F.col("gt_id").cast("string"), F.lit(" ("), given("severity", "unknown"), F.lit(")\nTitle: "),
        given("title", "N/A"), F.lit("\nLocation: "), given("location", "N/A"), F.lit("\nRoot Cause: "),
        given("root_cause", "N/A"), F.lit("\nDescription: "), given("description", ""),
    )
    return gt.filter(F.col("gt_id").isNotNull()).select("codebase_id", "gt_pos", "gt_id", block.alias("section"))


def classify_requests(findings: DataFrame, contexts: DataFrame, gt: DataFrame, votes: int = 1) -> DataFrame:
    """One request per finding and vote, for codebases with ground truth.

    Findings and contexts meet by ``position``, because a printed number may repeat within a run. The request names its
    codebase; the ground-truth blocks of ``gt_sections`` are the same for all its requests and
    are not copied into each.
    """
    asked = findings.join(broadcast_if_small(gt.select("codebase_id").distinct()), "codebase_id", "left_semi").join(
        contexts.drop("index"), ["run_id", "position"], "left"
    )
    return asked.select(
        "codebase_id",
        "run_id",
        "position",
        F.col("index").alias("finding_index"),
        F.explode(F.sequence(F.lit(0), F.lit(votes - 1))).alias("vote_no"),
        "title",
        F.coalesce("location", F.lit("unknown")).alias("location"),
        F.coalesce(F.col("confidence").cast("string"), F.lit("N/A")).alias("confidence"),
        F.coalesce("severity", F.lit("N/A")).alias("severity"),
        F.coalesce("context", "title").alias("context"),
    )


def chunked(inputs: DataFrame, size: int) -> DataFrame:
    """Cluster inputs with their chunk and their 1-based place in it, in (run, finding) order per codebase.

    They are written first, as the numbering reads them twice: for the borders of its slices and for the slices.
    """
    order = numbered(materialised(inputs), ["codebase_id"], ["run_id", "finding_index"], "_number")
    zero_based = F.col("_number") - 1
    return order.withColumns(
        {
            "chunk_no": F.floor(zero_based / size),
            "member_index": (F.pmod(zero_based, F.lit(size)) + 1).cast("int"),
        }
    ).drop("_number")


def cluster_requests(chunks: DataFrame) -> DataFrame:
    """One request per chunk: its numbered findings as one text (a chunk holds at most 15)."""
    line = F.concat(F.col("member_index").cast("string"), F.lit(". "), "title", F.lit("\n   "), "reasoning")
    return chunks.groupBy("codebase_id", "chunk_no").agg(
        F.count("*").alias("findings"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("member_index", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("listing"),
    )


def validate_requests(clusters: DataFrame, scoped_sizes: DataFrame) -> DataFrame:
    """One request per cluster with the level and size of the source it is judged on; none without source."""
    return clusters.join(scoped_sizes, ["codebase_id", "cluster_id"]).select(
        "codebase_id",
        "cluster_id",
        F.format_string("Title: %s\nClaimed Severity: %s\nReasoning: %s", "title", "severity", "reasoning").alias("claim"),
        "level",
        "files",
        "chars",
    )


def parse_responses(
    responses: DataFrame,
    schema: str,
    enums: dict[str, list[str]] | None = None,
    optional_enums: dict[str, list[str]] | None = None,
    required: list[str] | None = None,
    shape: str = "object",
) -> DataFrame:
    """Replies (…, raw) with the parsed ``reply`` or an ``error_code``: 'parse' or 'validation'.

    The JSON is the widest bracketed part of the reply. A reply that is an array is checked entry by entry.
    """
    pattern = r"(?s)\[.*\]" if shape == "array" else r"(?s)\{.*\}"
    found = F.nullif(F.regexp_extract("raw", pattern, 0), F.lit(""))
    reply = F.from_json(found, f"array<{schema}>" if shape == "array" else schema)

    def entry_ok(entry: Column) -> Column:
        ok = F.lit(True)
        for name, values in (enums or {}).items():
            ok = ok & F.coalesce(entry[name].isin(values), F.lit(False))
        for name, values in (optional_enums or {}).items():
            ok = ok & F.coalesce(entry[name].isin(values), F.lit(True))
        for name in required or []:
            ok = ok & entry[name].isNotNull()
        return ok

    valid = F.forall("reply", entry_ok) if shape == "array" else entry_ok(F.col("reply"))
    parsed = responses.withColumns({"reply": reply, "is_json": F.try_parse_json(found).isNotNull()})
    code = F.when(~F.coalesce("is_json", F.lit(False)), "parse").when(~F.coalesce(valid, F.lit(False)), "validation")
    return (
        parsed.withColumn("error_code", code)
        .withColumn("reply", F.when(F.col("error_code").isNull(), F.col("reply")))
        .drop("is_json")
    )


def retry_eligible(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Requests (request_id, attempt, error_code) whose last attempt failed in a way worth another attempt."""
    last = attempts.groupBy("request_id").agg(F.max(F.struct("attempt", "error_code")).alias("last"))
    return last.select("request_id", "last.attempt", "last.error_code").filter(
        F.col("error_code").isin(RETRIED_ERRORS) & (F.col("attempt") < max_attempts)
    )
