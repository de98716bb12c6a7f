"""From a results folder to all report relations: load, score, compare, write once and read many times."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import consistency, extraction, ledger, logs, metrics
from gaugeline.session import cut_lineage, materialised
from gaugeline.sources import feed, files


@dataclass
class Results:
    """The relations a report is computed from."""

    runs: DataFrame
    labels: DataFrame
    gt: DataFrame
    clusters: DataFrame
    members: DataFrame
    cluster_conditions: DataFrame
    verdicts: DataFrame
    conditions: DataFrame


def load_results(
    spark: SparkSession, results_dir: str, ground_truth_dir: str, config_file: str, latest: bool = False
) -> Results:
    """Read a results folder; findings are parsed from the run texts."""

    def read(pattern: str, folder: str = results_dir) -> DataFrame:
        return files.read_files(spark, folder, pattern)

    reports = files.parse_run_text(read("*.stdout.txt"))
    parsed = extraction.parse_results(reports).select("run_id", F.col("parsed").alias("findings_count"))
    chars = reports.select("run_id", F.length("text").alias("text_chars"))
    costs = logs.run_cost(logs.parse_events(files.read_event_lines(spark, results_dir)))
    label_files = read("*.classifications.json")
    classified = files.parse_classification_headers(label_files).select("run_id", F.lit(True).alias("is_classified"))
    runs = (
        files.usable_runs(files.parse_run_meta(read("*.meta.json")), reports)
        .join(parsed, "run_id")
        .join(chars, "run_id")
        .join(costs, "run_id", "left")
        .join(classified, "run_id", "left")
        .na.fill(False, ["is_classified"])
    )
    judged = metrics.invalid_runs(runs).withColumn("is_valid", F.col("invalid").isNull())
    if latest:
        judged = metrics.latest_runs(judged)
    judged = materialised(judged)
    cluster_files = read("*clusters-*.json")
    clusters = files.parse_clusters(cluster_files)
    config = read(config_file.rsplit("/", 1)[-1], config_file.rsplit("/", 1)[0])
    return Results(
        runs=judged,
        labels=files.parse_labels(label_files).join(judged.select("run_id"), "run_id", "left_semi"),
        gt=files.parse_ground_truth(read("*.json", ground_truth_dir)),
        clusters=clusters,
        members=files.parse_cluster_members(cluster_files),
        cluster_conditions=files.cluster_conditions(clusters),
        verdicts=files.parse_validations(read("validations-*.json")),
        conditions=files.parse_conditions(config),
    )


#: Tables that only serve to add up the pooled ones again; they are not part of a report.
PARTS = ["totals", "seen_conditions"]


def codebase_tables(results: Results, written: ledger.Written = materialised) -> dict[str, DataFrame]:
    """The relations that belong to a codebase each, by name; what several of them need is written once, by ``written``.

    ``results`` are read several times. ``totals`` and ``seen_conditions`` are what the pooled relations need of a codebase.
    """
    r = results
    gt = r.gt.join(r.runs.select("codebase_id").distinct(), "codebase_id", "left_semi")
    gt = written(gt)
    run_metrics = written(metrics.run_metrics(r.runs, r.labels, gt))
    numbers = written(metrics.run_numbers(r.runs).select("run_id", "run_number"))
    conditions = written(
        metrics.condition_table(
            metrics.condition_agg(run_metrics),
            consistency.consistency_jaccard(r.runs, r.labels, gt),
            metrics.novel_counts(r.cluster_conditions, r.verdicts),
        )
    )
    missed = written(metrics.missed_gt(gt, r.runs, r.labels))
    return {
        "runs": run_metrics,
        "matches": metrics.run_matches(r.labels, gt),
        "conditions": conditions,
        "missed_gt": missed,
        "reliability": metrics.gt_reliability(r.runs, r.labels, gt),
        "integrity": metrics.integrity_check(r.runs, r.labels),
        "ledger": ledger.ledger(
            ledger.ledger_gt(gt, r.runs, r.labels, numbers, written),
            ledger.ledger_novel(r.clusters, r.members, r.verdicts, r.runs, numbers, written),
            ledger.ledger_fp(r.runs, r.labels, numbers, written),
        ),
        "matrix": ledger.findings_matrix(gt, r.runs, r.labels),
        "comparison": ledger.comparison_table(conditions, r.clusters, r.verdicts),
        "recall_chart": ledger.recall_chart(run_metrics),
        "breakdown": ledger.breakdown_rows(run_metrics),
        "validations": ledger.validation_rows(r.verdicts),
        "overview": ledger.run_overview(r.runs, numbers),
        "analysis_feed": ledger.analysis_feed(run_metrics, missed, r.clusters, r.verdicts, gt),
        "totals": metrics.codebase_totals(r.runs, gt, missed, r.verdicts),
        "seen_conditions": r.runs.select("codebase_id", "condition_id").distinct(),
    }


def pooled_tables(
    conditions: DataFrame,
    totals: DataFrame,
    seen: DataFrame,
    configured: DataFrame,
    written: ledger.Written = materialised,
) -> dict[str, DataFrame]:
    """The relations over all codebases, added up from the codebases' conditions, totals and seen conditions."""
    cross = written(metrics.cross_codebase(conditions))
    bests = cut_lineage(metrics.metric_bests(cross))
    return {
        "header": metrics.pooled_header(totals),
        "condition_order": metrics.condition_order(seen, configured),
        "cross_codebase": cross,
        "metric_bests": bests,
        "missed_totals": metrics.pooled_missed(totals),
        "risk_excluded": totals.agg(F.coalesce(F.sum("excluded"), F.lit(0)).alias("excluded")),
        "dashboard": ledger.dashboard_rows(cross, bests),
    }


def report_tables(results: Results) -> dict[str, DataFrame]:
    """All report relations by name."""
    named = ("labels", "clusters", "members", "verdicts")
    own = codebase_tables(replace(results, **{name: materialised(getattr(results, name)) for name in named}))
    totals, seen = (materialised(own.pop(name)) for name in PARTS)
    return own | pooled_tables(own["conditions"], totals, seen, results.conditions)


def write_report(results: Results, folder: str) -> None:
    """Compute every relation and write it; readers of the report only read the written tables."""
    feed.write_report_tables(report_tables(results), folder)
