"""Report relations: ledger, matrix, comparison and the tables behind the rendered report.

Cells stay long (row, condition, cell). A cell lists the run numbers of its hits; so that no cell gathers an unbounded
group, its text comes in pages of ``PAGE`` run numbers, and a cell whose hits all fall into one page is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.functions.numbers import cut_text, half_up, percent
from gaugeline.operators.metrics import CATEGORIES
from gaugeline.session import materialised

PAGE = 1000
CONDITION = ["codebase_id", "condition_id"]


def condition_cell(numbers: Column, total: Column) -> Column:
    """'-' without hits, '✓' when there are as many hits as valid runs, else '✓#a#b' in ascending order."""
    listed = F.array_join(F.transform(F.sort_array(numbers), lambda n: F.concat(F.lit("#"), n.cast("string"))), "")
    return (
        F.when(F.size(numbers) == 0, "-")
        .when(F.size(numbers) == total, "✓")
        .otherwise(F.concat(F.lit("✓"), listed))
    )


def cell_pages(hits: DataFrame, row: Sequence[str], conditions: DataFrame) -> DataFrame:
    """Cell texts from hits (row columns, condition_id, run_number, repeats), as (row…, condition_id, page, cell)."""
    cell = [*row, "condition_id"]
    page = F.floor((F.col("run_number") - 1) / PAGE)
    totals = hits.groupBy(*cell).agg(F.sum("repeats").alias("hits"), F.min(page).alias("first_page"))
    marked = totals.join(conditions, CONDITION, "left").withColumn(
        "all_runs", F.col("hits") == F.coalesce("valid_runs", F.lit(0))
    )
    partial = marked.filter(~F.col("all_runs")).select(*cell, "first_page")
    pieces = F.transform(
        F.sort_array(F.collect_list(F.struct("run_number", "repeats"))),
        lambda hit: F.repeat(F.concat(F.lit("#"), hit["run_number"].cast("string")), hit["repeats"].cast("int")),
    )
    listed = (
        hits.withColumn("page", page)
        .join(partial, cell)
        .groupBy(*cell, "page", "first_page")
        .agg(F.array_join(pieces, "").alias("text"))
        .select(
            *cell,
            "page",
            F.when(F.col("page") == F.col("first_page"), F.concat(F.lit("✓"), "text")).otherwise(F.col("text")).alias(
                "cell"
            ),
        )
    )
    complete = marked.filter("all_runs").select(*cell, F.lit(0).cast("long").alias("page"), F.lit("✓").alias("cell"))
    return complete.unionByName(listed)


def condition_runs(runs: DataFrame) -> DataFrame:
    """Valid runs per (codebase, condition): a few rows per codebase, broadcast once counted."""
    return broadcast_if_small(runs.groupBy(*CONDITION).agg(F.count_if("is_valid").alias("valid_runs")))


def _spread(rows: DataFrame, conditions: DataFrame, cells: DataFrame, row: Sequence[str]) -> DataFrame:
    """Every row with a cell for each condition that its codebase has runs of."""
    return (
        rows.join(conditions, "codebase_id")
        .drop("valid_runs")
        .join(cells, [*row, "condition_id"], "left")
        .withColumns({"page": F.coalesce("page", F.lit(0).cast("long")), "cell": F.coalesce("cell", F.lit("-"))})
    )


LEDGER_COLUMNS = ["codebase_id", "row_id", "title", "condition_id", "page", "cell", "status", "sort_key", "gt_id"]


Written = Callable[[DataFrame], DataFrame]  # writes a frame that is read several times and continues from the table


def ledger_gt(
    gt: DataFrame, runs: DataFrame, labels: DataFrame, numbers: DataFrame, written: Written = materialised
) -> DataFrame:
    """Ground-truth rows: which valid runs matched each item."""
    valid = runs.filter("is_valid").select("run_id")
    hits = written(
        labels.filter(F.col("matched_gt_id").isNotNull())
        .select("codebase_id", "condition_id", "run_id", F.col("matched_gt_id").alias("gt_id"))
        .distinct()
        .join(valid, "run_id", "left_semi")
        .join(numbers.select("run_id", "run_number"), "run_id")
        .select("codebase_id", "condition_id", "gt_id", "run_number", F.lit(1).alias("repeats"))
    )
    conditions = condition_runs(runs)
    cells = cell_pages(hits, ["codebase_id", "gt_id"], conditions)
    rows = gt.filter(F.col("gt_id").isNotNull()).select("codebase_id", "gt_id", cut_text(F.col("title"), 50).alias("title"))
    return (
        _spread(rows, conditions, cells, ["codebase_id", "gt_id"])
        .withColumns(
            {
                "gt_id": F.col("gt_id").cast("string"),
                "row_id": F.col("gt_id").cast("string"),
                "status": F.col("gt_id").cast("string"),
                "sort_key": F.lit(0),
            }
        )
        .select(*LEDGER_COLUMNS)
    )


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per cluster: the last one listed."""
    return verdicts.groupBy("codebase_id", "cluster_id").agg(F.max_by("verdict", "pos").alias("verdict"))


def ledger_novel(
    clusters: DataFrame,
    members: DataFrame,
    verdicts: DataFrame,
    runs: DataFrame,
    numbers: DataFrame,
    written: Written = materialised,
) -> DataFrame:
    """Cluster rows: distinct runs per condition, invalid runs included, runs outside the view dropped."""
    hits = written(
        members.select("codebase_id", "cluster_id", "condition_id", "run_id")
        .distinct()
        .join(numbers.select("run_id", "run_number"), "run_id")
        .select("codebase_id", "cluster_id", "condition_id", "run_number")
        .distinct()
        .withColumn("repeats", F.lit(1))
    )
    conditions = condition_runs(runs)
    cells = cell_pages(hits, ["codebase_id", "cluster_id"], conditions)
    verdict = F.col("verdict")
    rows = clusters.select("codebase_id", "cluster_id", cut_text(F.col("title"), 50).alias("title")).join(
        last_verdicts(verdicts), ["codebase_id", "cluster_id"], "left"
    )
    return (
        _spread(rows, conditions, cells, ["codebase_id", "cluster_id"])
        .withColumns(
            {
                "row_id": F.col("cluster_id"),
                "status": F.when(verdict.isNull(), "unvalidated")
                .when(verdict.isin("confirmed", "plausible"), verdict)
                .otherwise("~~rejected~~"),
                "sort_key": F.when(verdict.isNull(), 3)
                .when(verdict == "confirmed", 1)
                .when(verdict == "plausible", 2)
                .otherwise(5),
                "gt_id": F.lit(None).cast("string"),
            }
        )
        .select(*LEDGER_COLUMNS)
    )


def ledger_fp(runs: DataFrame, labels: DataFrame, numbers: DataFrame, written: Written = materialised) -> DataFrame:
    """False-positive rows by exact title; a title repeated within a run counts each time."""
    valid = runs.filter("is_valid").select("run_id")
    hits = written(
        labels.filter("category = 'fp'")
        .groupBy("codebase_id", "title", "condition_id", "run_id")
        .agg(F.count("*").alias("repeats"))
        .join(valid, "run_id", "left_semi")
        .join(numbers.select("run_id", "run_number"), "run_id")
        .select("codebase_id", F.col("title").alias("row_id"), "condition_id", "run_number", "repeats")
    )
    conditions = condition_runs(runs)
    cells = cell_pages(hits, ["codebase_id", "row_id"], conditions)
    rows = hits.select("codebase_id", "row_id").distinct()
    return (
        _spread(rows, conditions, cells, ["codebase_id", "row_id"])
        .withColumns(
            {
                "title": cut_text(F.col("row_id"), 50),
                "status": F.lit("FP"),
                "sort_key": F.lit(4),
                "gt_id": F.lit(None).cast("string"),
            }
        )
        .select(*LEDGER_COLUMNS)
    )


def ledger(*parts: DataFrame) -> DataFrame:
    """The whole ledger in display order: kind, natural ground-truth id, collated title."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    number = F.regexp_extract("gt_id", r"(\d+)", 1).try_cast("long")
    return rows.orderBy(
        "codebase_id",
        "sort_key",
        F.regexp_extract("gt_id", r"^(\D*)", 1),
        number,
        F.collate("title", "UNICODE"),
        "row_id",
        "condition_id",
        "page",
    )


def findings_matrix(gt: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Sparse matrix of ground truth and runs: (codebase_id, run_id, gt_id, title, cell).

    Runs without usable labels have one row with a null gt_id ('X' invalid, '?' unclassified) and matched items one row
    with the agreement of their first match; every other cell is '-'.
    """
    with_gt = runs.join(broadcast_if_small(gt.select("codebase_id").distinct()), "codebase_id", "left_semi")
    state = F.when(~F.col("is_valid"), "X").when(~F.col("is_classified"), "?")
    states = with_gt.select(
        "codebase_id", "run_id", F.lit(None).cast(gt.schema["gt_id"].dataType).alias("gt_id"),
        F.lit(None).cast("string").alias("title"), state.alias("cell"),
    ).filter(F.col("cell").isNotNull())
    usable = with_gt.filter("is_valid and is_classified").select("run_id")
    items = gt.select("codebase_id", "gt_id", cut_text(F.col("title"), 45).alias("title"))
    hits = (
        labels.filter(F.col("matched_gt_id").isNotNull())
        .groupBy("codebase_id", "run_id", F.col("matched_gt_id").alias("gt_id"))
        .agg(F.min_by("agreement", "finding_index").alias("cell"))
        .join(usable, "run_id", "left_semi")
        .join(items, ["codebase_id", "gt_id"])
        .select("codebase_id", "run_id", "gt_id", "title", "cell")
    )
    return states.unionByName(hits)


def dense_matrix(matrix: DataFrame, gt: DataFrame, runs: DataFrame) -> DataFrame:
    """Every cell of the matrix, for the codebases one wants to display; the result has items x runs rows."""
    items = gt.filter(F.col("gt_id").isNotNull()).select("codebase_id", "gt_id", cut_text(F.col("title"), 45).alias("title"))
    states = matrix.filter(F.col("gt_id").isNull()).select("run_id", F.col("cell").alias("state"))
    hits = matrix.filter(F.col("gt_id").isNotNull()).select("run_id", "gt_id", "cell")
    return (
        items.join(runs.select("codebase_id", "run_id"), "codebase_id")
        .join(states, "run_id", "left")
        .join(hits, ["run_id", "gt_id"], "left")
        .select("codebase_id", "run_id", "gt_id", "title", F.coalesce("state", "cell", F.lit("-")).alias("cell"))
    )


def comparison_table(conditions: DataFrame, clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Long comparison (codebase_id, metric, condition_id, value); a null value is shown as '-'.

    A metric without its data source has no rows: recall, consistency, false positives and uncertain need ground
    truth, novel counts need validations, excluded novels need a difference, unique bugs need clusters.
    """
    validated = verdicts.select("codebase_id").distinct().withColumn("has_verdicts", F.lit(True))
    clustered = clusters.select("codebase_id").distinct().withColumn("has_clusters", F.lit(True))
    differing = conditions.groupBy("codebase_id").agg(
        F.max(F.col("confirmed_novels") != F.col("confirmed_novels_filtered")).alias("has_excluded")
    )
    col = F.col
    has_gt = col("gt_total").isNotNull()
    has_verdicts = F.coalesce("has_verdicts", F.lit(False))
    metrics = [
        ("recall", col("avg_recall"), has_gt),
        ("recall_matched", col("avg_matched"), has_gt),
        ("consistency", col("consistency"), has_gt),
        ("novel_confirmed", col("confirmed_novels_filtered"), has_verdicts),
        ("novel_excluded", col("confirmed_novels") - col("confirmed_novels_filtered"), has_verdicts & col("has_excluded")),
        ("novel_conditional", col("plausible_novels_filtered"), has_verdicts),
        ("total_findings", col("avg_findings_count"), F.lit(True)),
        ("unique_bugs", col("unique_bugs_found"), F.coalesce("has_clusters", F.lit(False))),
        ("false_positives", half_up(col("avg_fp")), has_gt),
        ("uncertain", half_up(col("avg_uncertain")), has_gt),
        ("avg_cost", col("avg_cost"), F.lit(True)),
        ("avg_duration_ms", col("avg_duration_ms"), F.lit(True)),
    ]
    entries = [
        F.when(present, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")))
        for name, value, present in metrics
    ]
    return (
        conditions.join(validated, "codebase_id", "left")
        .join(clustered, "codebase_id", "left")
        .join(differing, "codebase_id")
        .select("codebase_id", "condition_id", F.inline(F.array_compact(F.array(*entries))))
    )


def missed_table(missed: DataFrame) -> DataFrame:
    return missed.select("codebase_id", "gt_id", cut_text(F.col("title"), 60).alias("title"))


def _run_state() -> Column:
    return F.when(~F.col("is_valid"), "INVALID").when(F.col("matched").isNull(), "not classified").otherwise("ok")


def recall_chart(metrics: DataFrame) -> DataFrame:
    """Matched ids per run of a codebase with ground truth, as count and whole percent; ``run_matches`` lists them."""
    ok = F.col("state") == "ok"
    return (
        metrics.filter(F.col("gt_total").isNotNull())
        .withColumn("state", _run_state())
        .select(
            "codebase_id",
            "run_id",
            "state",
            F.when(ok, F.col("matched_ids")).alias("found"),
            "gt_total",
            F.when(ok, percent(F.col("matched_ids"), F.col("gt_total"))).alias("percent"),
        )
    )


def breakdown_rows(metrics: DataFrame) -> DataFrame:
    """Counts per run and category; uncertain only when there are any, unusable runs as one status row."""
    state = _run_state()
    counts = [
        F.when(
            (state == "ok") & (F.lit(name != "uncertain") | (F.col(name) > 0)),
            F.struct(F.lit(name).alias("category"), F.col(name).alias("count")),
        )
        for name in CATEGORIES
    ]
    status = F.when(state != "ok", F.struct(state.alias("category"), F.lit(None).cast("long").alias("count")))
    return metrics.filter(F.col("gt_total").isNotNull()).select(
        "codebase_id", "run_id", F.inline(F.array_compact(F.array(*counts, status)))
    )


def validation_rows(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "codebase_id",
        "cluster_id",
        "pos",
        F.substring("title", 1, 45).alias("title"),
        "verdict",
        "severity",
        F.substring(F.coalesce("code_evidence", F.lit("-")), 1, 60).alias("evidence"),
    )


def run_overview(runs: DataFrame, numbers: DataFrame) -> DataFrame:
    """One line per run; a condition with a single run shows number 1 and no '#n' label.

    ``runs`` carries ``invalid`` (reason or null) beside the run columns.
    """
    sizes = broadcast_if_small(runs.groupBy(*CONDITION).agg(F.count("*").alias("condition_runs")))
    status = F.when(F.col("invalid").isNotNull(), F.concat(F.lit("INVALID: "), "invalid")).when(
        F.col("timed_out"), "timeout"
    )
    several = F.col("condition_runs") > 1
    return (
        runs.join(numbers.select("run_id", "run_number"), "run_id")
        .join(sizes, CONDITION)
        .select(
            "codebase_id",
            "run_id",
            "condition_id",
            F.when(several, F.col("run_number")).otherwise(F.lit(1).cast("long")).alias("run_number"),
            F.when(several, F.concat("condition_id", F.lit(" #"), "run_number")).otherwise(F.col("condition_id")).alias(
                "run_label"
            ),
            "findings_count",
            "duration_ms",
            "cost_usd",
            status.alias("status"),
        )
    )


RUN_FEED = ["recall", "precision", "matched", "novel", "fp", "uncertain", "cost_usd", "duration_ms", "findings_count"]


def analysis_feed(metrics: DataFrame, missed: DataFrame, clusters: DataFrame, verdicts: DataFrame, gt: DataFrame) -> DataFrame:
    """The analysis input as JSON lines (codebase_id, kind, key, json): codebase totals, missed items and valid runs."""
    totals = (
        metrics.select("codebase_id")
        .distinct()
        .join(gt.groupBy("codebase_id").agg(F.count("gt_id").alias("gt_count")), "codebase_id", "left")
        .join(clusters.groupBy("codebase_id").agg(F.count("*").alias("novel_clusters")), "codebase_id", "left")
        .join(_verdict_counts(verdicts), "codebase_id", "left")
        .na.fill(0, ["gt_count", "novel_clusters"])
    )

    def lines(frame: DataFrame, kind: str, key: Column, columns: Sequence[str]) -> DataFrame:
        return frame.select(
            "codebase_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"),
            F.to_json(F.struct(*columns)).alias("json"),
        )

    return (
        lines(
            totals, "codebase", F.col("codebase_id"), ["gt_count", "novel_clusters", "confirmed", "plausible", "rejected"]
        )
        .unionByName(lines(missed, "missed", F.col("gt_id"), ["gt_id"]))
        .unionByName(lines(metrics.filter("is_valid"), "run", F.col("run_id"), ["condition_id", *RUN_FEED]))
    )


def _verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("codebase_id").agg(
        *[F.count_if(F.col("verdict") == name).alias(name) for name in ("confirmed", "plausible", "rejected")]
    )


# Dashboard row, source column, and the metric whose best conditions it highlights.
DASHBOARD = [
    ("GT Recall", "avg_recall", "recall"),
    ("Confirmed Novel Findings", "confirmed_novels_filtered", "confirmedNovelsFiltered"),
    ("Conditional Novel Findings", "plausible_novels_filtered", "confirmedNovelsFiltered"),
    ("False Positive Rate", "fp_rate", "fpRate"),
    ("Consistency", "consistency", "consistency"),
    ("Avg Cost / Run", "avg_cost", "avgCost"),
    ("Avg Duration", "avg_duration_ms", "avgDuration"),
]


def dashboard_rows(cross: DataFrame, bests: DataFrame) -> DataFrame:
    """Seven metric rows per condition with value, best and missing flags; conditions without data are left out."""
    shown = cross.filter((F.col("valid_runs") > 0) | F.col("avg_recall").isNotNull())
    entries = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("row"),
                F.lit(metric).alias("metric"),
                F.when(F.lit(column != "consistency") | (F.col("valid_runs") >= 2), F.col(column).cast("double")).alias(
                    "value"
                ),
            )
            for position, (name, column, metric) in enumerate(DASHBOARD)
        ]
    )
    flagged = bests.withColumn("_best", F.lit(True))
    return (
        shown.select("condition_id", F.inline(entries))
        .join(flagged, ["metric", "condition_id"], "left")
        .select(
            "position",
            "row",
            "condition_id",
            "value",
            (F.col("_best").isNotNull() & F.col("value").isNotNull()).alias("is_best"),
            F.col("value").isNull().alias("is_missing"),
        )
    )
