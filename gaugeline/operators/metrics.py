"""Run, condition and cross-codebase metrics over runs, labels and ground truth.

Columns used throughout:
  runs    run_id, codebase_id, condition_id, ts, duration_ms, cost_usd, mode, is_valid, is_classified, findings_count
  labels  run_id, codebase_id, condition_id, finding_index, title, category, matched_gt_id, agreement
  gt      codebase_id, gt_id, gt_pos, severity, title   (gt_id null: the file exists but lists nothing)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.functions.numbers import percent, ratio
from gaugeline.functions.ordering import numbered

CATEGORIES = ["matched", "novel", "fp", "uncertain"]

# Limits of a usable skill run.
MIN_SKILL_FINDINGS = 1
MIN_SKILL_TEXT_CHARS = 500

# The baseline condition sorts last, unknown conditions just before it.
BASELINE_CONDITION = "bare_audit"
BASELINE_ORDER = 9000
UNKNOWN_ORDER = 8000


def invalid_runs(runs: DataFrame) -> DataFrame:
    """Skill runs without findings or with too little text, with the reason; bare runs are always usable."""
    count, chars = F.col("findings_count"), F.col("text_chars")
    reason = F.when(
        count < MIN_SKILL_FINDINGS,
        F.concat(F.lit("skill run produced "), count, F.lit(f" findings (expected ≥{MIN_SKILL_FINDINGS})")),
    ).when(
        chars < MIN_SKILL_TEXT_CHARS,
        F.concat(F.lit("stdout only "), chars, F.lit(f" chars (expected ≥{MIN_SKILL_TEXT_CHARS} for skill run)")),
    )
    return runs.withColumn("invalid", F.when(F.col("mode") == "skill", reason))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run per (codebase, condition); of equal timestamps the smallest run id."""
    newest = runs.groupBy("codebase_id", "condition_id").agg(F.max("ts").alias("ts"))
    tied = runs.join(newest, ["codebase_id", "condition_id", "ts"], "left_semi")
    return (
        tied.groupBy("codebase_id", "condition_id")
        .agg(F.min_by(F.struct(*runs.columns), F.col("run_id")).alias("run"))
        .select("run.*")
    )


def run_numbers(runs: DataFrame) -> DataFrame:
    """Chronological number of each run within (codebase, condition), invalid runs included."""
    keys = runs.select("codebase_id", "condition_id", "ts", "run_id")
    return numbered(keys, ["codebase_id", "condition_id"], ["ts", "run_id"], "run_number")


def condition_order(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Distinct conditions of the runs with their sort position: configured order, unknown ones, the baseline."""
    known = conditions.select("condition_id", F.col("position").alias("_position"))
    return (
        runs.select("condition_id")
        .distinct()
        .join(known, "condition_id", "left")
        .select(
            "condition_id",
            F.when(F.col("condition_id") == BASELINE_CONDITION, BASELINE_ORDER)
            .otherwise(F.coalesce("_position", F.lit(UNKNOWN_ORDER)))
            .cast("int")
            .alias("condition_pos"),
        )
    )


def gt_totals(gt: DataFrame) -> DataFrame:
    """Ground-truth size per codebase; a codebase without a row here has no ground truth."""
    return gt.groupBy("codebase_id").agg(F.count("gt_id").alias("gt_total"))


def _category_columns() -> list[Column]:
    return [F.count_if(F.col("category") == name).alias(name) for name in CATEGORIES]


def category_counts(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One count column per category, and all labels."""
    return labels.groupBy(*keys).agg(*_category_columns(), F.count("*").alias("classified"))


def f1_score(precision: Column, recall: Column) -> Column:
    """Harmonic mean; null when a side is missing, 0 when both are 0."""
    return F.when(
        precision.isNotNull() & recall.isNotNull(),
        F.coalesce(ratio(2.0 * precision * recall, precision + recall), F.lit(0.0)),
    )


def run_metrics(runs: DataFrame, labels: DataFrame, gt: DataFrame) -> DataFrame:
    """Category counts, recall, precision and f1 per run.

    A run without classification keeps nulls; a codebase without ground truth keeps its counts only.
    """
    counts = labels.groupBy("run_id").agg(*_category_columns(), F.count("matched_gt_id").alias("matched_ids"))
    totals = broadcast_if_small(gt_totals(gt))
    joined = runs.join(counts, "run_id", "left").join(totals, "codebase_id", "left")
    scored = F.col("is_classified") & F.col("gt_total").isNotNull()
    out = joined.withColumns(
        {name: F.when(F.col("is_classified"), F.coalesce(F.col(name), F.lit(0))) for name in CATEGORIES}
    )
    out = out.withColumns(
        {
            "matched_ids": F.when(scored, F.coalesce("matched_ids", F.lit(0))).otherwise(F.lit(0)),
            "recall": F.when(scored, ratio(F.col("matched"), F.col("gt_total"))),
            "precision": F.when(scored, ratio(F.col("matched"), F.col("matched") + F.col("fp"))),
        }
    )
    return out.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def run_matches(labels: DataFrame, gt: DataFrame) -> DataFrame:
    """Matched ground-truth ids per run as rows, with their display position (-1 for an id not in the list)."""
    positions = gt.select("codebase_id", F.col("gt_id").alias("matched_gt_id"), "gt_pos")
    with_gt = labels.filter(F.col("matched_gt_id").isNotNull()).join(
        broadcast_if_small(gt.select("codebase_id").distinct()), "codebase_id", "left_semi"
    )
    return with_gt.join(positions, ["codebase_id", "matched_gt_id"], "left").select(
        "codebase_id",
        "condition_id",
        "run_id",
        F.col("matched_gt_id").alias("gt_id"),
        F.coalesce("gt_pos", F.lit(-1)).alias("gt_pos"),
    )


def condition_agg(metrics: DataFrame) -> DataFrame:
    """Averages and totals per (codebase, condition) over valid runs, from ``run_metrics``."""
    valid = F.col("is_valid")

    def over_valid(column: str) -> Column:
        return F.when(valid, F.col(column))

    all_four = sum((F.col(name) for name in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    sums = metrics.groupBy("codebase_id", "condition_id").agg(
        F.count_if(valid).alias("valid_runs"),
        F.count("*").alias("total_runs"),
        F.first("gt_total").alias("gt_total"),
        F.avg(F.when(valid & F.col("gt_total").isNotNull(), F.col("matched"))).alias("avg_matched"),
        F.avg(over_valid("findings_count")).alias("avg_findings_count"),
        F.coalesce(F.sum(over_valid("fp")), F.lit(0)).alias("total_fp"),
        F.coalesce(F.sum(F.when(valid, all_four)), F.lit(0)).alias("total_findings"),
        F.avg(over_valid("uncertain")).alias("avg_uncertain"),
        F.avg(over_valid("cost_usd")).alias("avg_cost"),
        F.avg(over_valid("duration_ms")).alias("avg_duration_ms"),
    )
    return sums.withColumns(
        {
            "avg_recall": ratio(F.col("avg_matched"), F.col("gt_total")),
            "avg_fp": ratio(F.col("total_fp"), F.col("valid_runs")),
            "fp_rate": ratio(F.col("total_fp"), F.col("total_findings")),
        }
    )


def first_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict row per cluster: the first one listed."""
    return verdicts.groupBy("codebase_id", "cluster_id").agg(
        F.min_by(F.struct("verdict", "risk_category"), F.col("pos")).alias("v")
    ).select("codebase_id", "cluster_id", "v.verdict", "v.risk_category")


def novel_counts(cluster_conditions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clusters caught per (codebase, condition), and those confirmed or plausible, with and without risk category."""
    caught = cluster_conditions.select("codebase_id", "condition_id", "cluster_id").distinct()
    judged = caught.join(first_verdicts(verdicts), ["codebase_id", "cluster_id"], "left")
    confirmed, plausible = F.col("verdict") == "confirmed", F.col("verdict") == "plausible"
    plain = F.col("risk_category").isNull()
    return judged.groupBy("codebase_id", "condition_id").agg(
        F.count("*").alias("unique_bugs_found"),
        F.count_if(confirmed).alias("confirmed_novels"),
        F.count_if(confirmed & plain).alias("confirmed_novels_filtered"),
        F.count_if(plausible).alias("plausible_novels"),
        F.count_if(plausible & plain).alias("plausible_novels_filtered"),
    )


NOVEL_COLUMNS = [
    "unique_bugs_found",
    "confirmed_novels",
    "confirmed_novels_filtered",
    "plausible_novels",
    "plausible_novels_filtered",
]


def condition_table(aggregates: DataFrame, consistency: DataFrame, novels: DataFrame) -> DataFrame:
    """``condition_agg`` completed with consistency and novel counts (0 where a condition caught no cluster)."""
    keys = ["codebase_id", "condition_id"]
    return (
        aggregates.join(consistency, keys, "left")
        .join(novels, keys, "left")
        .withColumns({name: F.coalesce(name, F.lit(0)) for name in NOVEL_COLUMNS})
    )


def missed_gt(gt: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Ground truth that no valid run matched."""
    valid = runs.filter("is_valid").select("run_id")
    found = (
        labels.filter(F.col("matched_gt_id").isNotNull())
        .join(valid, "run_id", "left_semi")
        .select("codebase_id", F.col("matched_gt_id").alias("gt_id"))
        .distinct()
    )
    return gt.filter(F.col("gt_id").isNotNull()).join(found, ["codebase_id", "gt_id"], "left_anti")


def missed_totals(gt: DataFrame, missed: DataFrame) -> DataFrame:
    """Missed and total ground truth over all codebases, with the whole percent."""
    listed = gt.filter(F.col("gt_id").isNotNull()).select(F.lit(1).alias("listed"), F.lit(0).alias("missed"))
    both = listed.unionByName(missed.select(F.lit(0).alias("listed"), F.lit(1).alias("missed")))
    return both.agg(
        F.coalesce(F.sum("missed"), F.lit(0)).alias("gt_missed_total"),
        F.coalesce(F.sum("listed"), F.lit(0)).alias("gt_total_all"),
    ).withColumn("gt_missed_percent", percent(F.col("gt_missed_total"), F.col("gt_total_all")))


def gt_reliability(runs: DataFrame, labels: DataFrame, gt: DataFrame) -> DataFrame:
    """How often each ground-truth item is found by a condition with more than one valid run.

    Items never found have no row, so the ground truth is never crossed with the runs.
    """
    keys = ["codebase_id", "condition_id"]
    valid = runs.filter("is_valid")
    sizes = valid.groupBy(*keys).agg(
        F.count("*").alias("total_runs"), F.count_if("is_classified").alias("total_classified")
    ).filter((F.col("total_runs") > 1) & (F.col("total_classified") >= 1))
    found = (
        labels.filter(F.col("matched_gt_id").isNotNull())
        .join(valid.select("run_id"), "run_id", "left_semi")
        .select(*keys, "run_id", F.col("matched_gt_id").alias("gt_id"))
        .distinct()
        .groupBy(*keys, "gt_id")
        .agg(F.count("*").alias("found_count"))
    )
    label = (
        F.when(F.col("found_count") == F.col("total_classified"), F.lit("RELIABLE"))
        .when(F.col("found_count") == 1, F.lit("INCONSISTENT"))
        .otherwise(F.concat_ws("/", "found_count", "total_classified"))
    )
    items = gt.select("codebase_id", "gt_id", F.substring("title", 1, 40).alias("gt_title"))
    return (
        found.join(sizes, keys)
        .join(items, ["codebase_id", "gt_id"])
        .select(*keys, "gt_id", "gt_title", "found_count", "total_classified", "total_runs", label.alias("label"))
    )


def recall_by_severity(runs: DataFrame, labels: DataFrame, gt: DataFrame) -> DataFrame:
    """Matched, total and rate per classified run and severity; items without a severity are a group of their own."""
    totals = gt.filter(F.col("gt_id").isNotNull()).groupBy("codebase_id", "severity").agg(F.count("*").alias("total"))
    severities = gt.select("codebase_id", F.col("gt_id").alias("matched_gt_id"), "severity")
    hits = (
        labels.filter(F.col("matched_gt_id").isNotNull())
        .select("codebase_id", "run_id", "matched_gt_id")
        .distinct()
        .join(severities, ["codebase_id", "matched_gt_id"])
        .groupBy("run_id", "severity")
        .agg(F.count("*").alias("matched"))
    )
    return (
        runs.filter("is_classified")
        .select("run_id", "codebase_id")
        .join(broadcast_if_small(totals), "codebase_id")
        .join(
            hits.select(F.col("run_id").alias("_run"), F.col("severity").alias("_severity"), "matched"),
            (F.col("run_id") == F.col("_run")) & F.col("severity").eqNullSafe(F.col("_severity")),
            "left",
        )
        .select("run_id", "codebase_id", "severity", F.coalesce("matched", F.lit(0)).alias("matched"), "total")
        .withColumn("rate", ratio(F.col("matched"), F.col("total")))
    )


def stat_summary(column: str) -> list[Column]:
    """mean, population standard deviation, min and max of one metric."""
    return [
        F.avg(column).alias(f"{column}_mean"),
        F.stddev_pop(column).alias(f"{column}_std"),
        F.min(column).alias(f"{column}_min"),
        F.max(column).alias(f"{column}_max"),
    ]


STAT_METRICS = ["recall", "precision", "f1", "findings_count", "duration_ms", "cost_usd"]


def condition_stats(metrics: DataFrame, consistency: DataFrame, novels: DataFrame) -> DataFrame:
    """Summary statistics of every run metric per (codebase, condition), over valid runs."""
    keys = ["codebase_id", "condition_id"]
    columns = [column for name in STAT_METRICS for column in stat_summary(name)]
    stats = metrics.filter("is_valid").groupBy(*keys).agg(F.count("*").alias("run_count"), *columns)
    unique = novels.select(*keys, F.col("unique_bugs_found").alias("unique_novel_bugs"))
    return stats.join(consistency, keys, "left").join(unique, keys, "left")


def cross_codebase(conditions: DataFrame) -> DataFrame:
    """Per condition over all codebases: pooled recall and FP rate, run-weighted cost and duration."""
    with_recall = F.col("avg_recall").isNotNull()

    def weighted(column: str) -> Column:
        weight = F.when(F.col(column).isNotNull() & (F.col("valid_runs") > 0), F.col("valid_runs"))
        return ratio(F.sum(F.col(column) * weight), F.sum(weight))

    return conditions.groupBy("condition_id").agg(
        F.sum("valid_runs").alias("valid_runs"),
        ratio(F.sum(F.when(with_recall, F.col("avg_matched"))), F.sum(F.when(with_recall, F.col("gt_total")))).alias(
            "avg_recall"
        ),
        F.sum(F.when(with_recall, F.col("gt_total"))).alias("gt_total"),
        F.sum("confirmed_novels").alias("confirmed_novels"),
        F.sum("confirmed_novels_filtered").alias("confirmed_novels_filtered"),
        F.sum("plausible_novels_filtered").alias("plausible_novels_filtered"),
        ratio(F.sum("total_fp"), F.sum("total_findings")).alias("fp_rate"),
        F.avg("consistency").alias("consistency"),
        weighted("avg_cost").alias("avg_cost"),
        weighted("avg_duration_ms").alias("avg_duration_ms"),
    )


# Metric name, source column, +1 when higher is better and -1 when lower is better.
BEST_METRICS = [
    ("recall", "avg_recall", 1),
    ("confirmedNovelsFiltered", "confirmed_novels_filtered", 1),
    ("fpRate", "fp_rate", -1),
    ("consistency", "consistency", 1),
    ("avgCost", "avg_cost", -1),
    ("avgDuration", "avg_duration_ms", -1),
]


def metric_bests(cross: DataFrame) -> DataFrame:
    """All conditions that tie for the best value of a metric, as (metric, condition_id) rows."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), (F.col(column).cast("double") * sign).alias("score"))
            for name, column, sign in BEST_METRICS
        ]
    )
    scores = cross.select("condition_id", F.inline(entries)).filter(F.col("score").isNotNull())
    best = scores.groupBy("metric").agg(F.max("score").alias("score"))
    return scores.join(best, ["metric", "score"], "left_semi").select("metric", "condition_id")


def filter_by_codebases(
    conditions: DataFrame, codebase_ids: Sequence, visible_conditions: Sequence | None = None
) -> DataFrame:
    """``cross_codebase`` over a subset; here the ground-truth total counts every codebase of the condition."""
    subset = conditions.filter(F.col("codebase_id").isin(list(codebase_ids)))
    if visible_conditions is not None:
        subset = subset.filter(F.col("condition_id").isin(list(visible_conditions)))
    totals = subset.groupBy("condition_id").agg(F.sum(F.coalesce("gt_total", F.lit(0))).alias("_total"))
    return (
        cross_codebase(subset)
        .join(totals, "condition_id")
        .withColumn("gt_total", F.nullif(F.col("_total"), F.lit(0)))
        .drop("_total")
    )


def subset_totals(gt: DataFrame, missed: DataFrame, verdicts: DataFrame, codebase_ids: Sequence) -> DataFrame:
    """One row for a chosen set of codebases: listed and missed ground truth, the whole percent, and what is set aside.

    The aggregates of the subset come from ``filter_by_codebases``, its bests from ``metric_bests`` of these.
    """
    chosen = F.col("codebase_id").isin(list(codebase_ids))
    totals = missed_totals(gt.filter(chosen), missed.filter(chosen))
    one = F.lit(1).alias("_one")
    excluded = risk_excluded(verdicts.filter(chosen)).select(one, "excluded")
    filled = totals.withColumn("gt_missed_percent", F.coalesce("gt_missed_percent", F.lit(0))).select(one, "*")
    return filled.join(excluded, "_one").drop("_one")


def risk_excluded(verdicts: DataFrame) -> DataFrame:
    """Validations that count as real but are set aside for their risk category."""
    kept = F.col("risk_category").isNotNull() & F.col("verdict").isin("confirmed", "plausible")
    return verdicts.agg(F.count_if(kept).alias("excluded"))


def codebase_totals(runs: DataFrame, gt: DataFrame, missed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per codebase what the pooled totals add up: runs, listed and missed ground truth, validations set aside."""
    names = ["total_runs", "valid_runs", "invalid_runs", "listed", "missed", "excluded"]

    def counts(frame: DataFrame, **found: Column) -> DataFrame:
        own = frame.groupBy("codebase_id").agg(*[c.alias(name) for name, c in found.items()])
        return own.select("codebase_id", *[name if name in found else F.lit(0).cast("long").alias(name) for name in names])

    set_aside = F.col("risk_category").isNotNull() & F.col("verdict").isin("confirmed", "plausible")
    parts = (
        counts(
            runs,
            total_runs=F.count("*"),
            valid_runs=F.count_if("is_valid"),
            invalid_runs=F.count_if(~F.col("is_valid")),
        )
        .unionByName(counts(gt, listed=F.count("gt_id")))
        .unionByName(counts(missed, missed=F.count("*")))
        .unionByName(counts(verdicts, excluded=F.count_if(set_aside)))
    )
    return parts.groupBy("codebase_id").agg(*[F.sum(name).alias(name) for name in names])


def pooled_header(totals: DataFrame, latest: bool = False) -> DataFrame:
    """``report_header`` from the totals of the codebases."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    known = (F.col("total_runs") > 0) & F.col("codebase_id").isNotNull()
    return totals.agg(
        total("total_runs"), total("valid_runs"), total("invalid_runs"), F.count_if(known).alias("codebases")
    ).withColumn("mode", F.lit("latest" if latest else "all"))


def pooled_missed(totals: DataFrame) -> DataFrame:
    """``missed_totals`` from the totals of the codebases."""
    return totals.agg(
        F.coalesce(F.sum("missed"), F.lit(0)).alias("gt_missed_total"),
        F.coalesce(F.sum("listed"), F.lit(0)).alias("gt_total_all"),
    ).withColumn("gt_missed_percent", percent(F.col("gt_missed_total"), F.col("gt_total_all")))


def integrity_check(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs that lost findings on the way to their labels, or whose categories do not add up."""
    counts = category_counts(labels, ["run_id"])
    joined = runs.filter("is_classified").join(counts, "run_id", "left").na.fill(0, [*CATEGORIES, "classified"])
    total = sum((F.col(name) for name in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    lost = F.when(
        F.col("classified") < F.col("findings_count"),
        F.struct(F.lit("lost").alias("rule"), (F.col("findings_count") - F.col("classified")).alias("diff")),
    )
    unbalanced = F.when(
        total != F.col("classified"),
        F.struct(F.lit("category_sum").alias("rule"), (total - F.col("classified")).alias("diff")),
    )
    violation = F.explode(F.array_compact(F.array(lost, unbalanced)))
    return joined.select("run_id", "codebase_id", "condition_id", violation.alias("v")).select(
        "run_id", "codebase_id", "condition_id", "v.rule", "v.diff"
    )


def report_header(runs: DataFrame, latest: bool = False) -> DataFrame:
    """Run totals and the number of codebases; the list of codebases is ``runs.select('codebase_id').distinct()``."""
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.count_if("is_valid").alias("valid_runs"),
        F.count_if(~F.col("is_valid")).alias("invalid_runs"),
        F.count_distinct("codebase_id").alias("codebases"),
    ).withColumn("mode", F.lit("latest" if latest else "all"))


def eval_status(gt: DataFrame, found: DataFrame, leads: DataFrame) -> DataFrame:
    """FOUND, LEAD or MISSED per ground-truth item; a finding beats a lead."""
    keys = ["codebase_id", "gt_id"]
    in_findings = found.select(*keys).distinct().withColumn("_found", F.lit(True))
    in_leads = leads.select(*keys).distinct().withColumn("_lead", F.lit(True))
    status = F.when(F.col("_found"), "FOUND").when(F.col("_lead"), "LEAD").otherwise("MISSED")
    return (
        gt.join(in_findings, keys, "left")
        .join(in_leads, keys, "left")
        .select(*keys, "severity", status.alias("status"))
    )


def eval_tally(status: DataFrame) -> DataFrame:
    """Recall and per-severity tallies from ``eval_status``; leads do not count as found."""
    found, severity = F.col("status") == "FOUND", F.lower("severity")
    return (
        status.groupBy("codebase_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(found).alias("found"),
            F.count_if(F.col("status") == "LEAD").alias("leads"),
            F.count_if(F.col("status") == "MISSED").alias("missed"),
            F.count_if(found & (severity == "high")).alias("high_found"),
            F.count_if(severity == "high").alias("high_total"),
            F.count_if(found & (severity == "medium")).alias("medium_found"),
            F.count_if(severity == "medium").alias("medium_total"),
        )
        .withColumn("recall", ratio(F.col("found"), F.col("total")))
    )


def gt_profile(gt: DataFrame) -> DataFrame:
    """High, medium, low and total ground truth per codebase, with a grand total row (codebase_id null)."""
    severity = F.lower("severity")
    return (
        gt.filter(F.col("gt_id").isNotNull())
        .rollup("codebase_id")
        .agg(
            *[F.count_if(severity == name).alias(name) for name in ("high", "medium", "low")],
            F.count("*").alias("total"),
        )
    )
