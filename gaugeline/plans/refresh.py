"""Bringing a results feed up to date: only what is stale is judged, and only its codebases are written.

The feed holds, beside the report tables, the labels, clusters, members and verdicts of every codebase and the hashes they
were made from. A refresh compares hashes, judges the stale runs, clusters and validates the codebases whose inputs changed,
computes the report relations of the codebases touched, and adds the pooled relations up from the parts of all codebases.
Everything becomes one version of the feed. What the feed is to hold is written there first and read again for the rest, so
there is one copy; what else is written on the way goes when the refresh ends, the largest tables earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import clustering
from gaugeline.operators.refresh import (
    cluster_content_hash,
    cluster_input_hash,
    content_hash,
    rows_hash,
    stale_classifications,
    stale_clusters,
    stale_validations,
)
from gaugeline.plans.report import PARTS, Results, codebase_tables, pooled_tables
from gaugeline.session import Scratch
from gaugeline.sources import feed


@dataclass(frozen=True)
class Judges:
    """How labels, clusters and verdicts are made, and the names their hashes carry."""

    classify: Callable[[DataFrame, DataFrame], DataFrame]  # findings of stale runs, ground truth -> labels
    cluster: Callable[[DataFrame], tuple[DataFrame, DataFrame]]  # cluster inputs -> clusters, members
    validate: Callable[[DataFrame, DataFrame], DataFrame]  # clusters, members -> verdicts
    prompt_hash: str
    cluster_model: str
    validator_model: str
    scope_files: bool = False
    #: labels, findings, runs, ground truth -> cluster inputs
    inputs: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame] = clustering.cluster_inputs


@dataclass(frozen=True)
class Current:
    """What the results folder holds now; ``runs`` are read several times, so they should be a table."""

    runs: DataFrame
    findings: DataFrame
    gt: DataFrame
    conditions: DataFrame
    hashes: DataFrame  # run_id, codebase_id, gt_hash, stdout_hash


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did; without anything stale, no version is added."""

    version: int
    runs_judged: int = 0
    codebases_touched: int = 0
    codebases_clustered: int = 0
    codebases_validated: int = 0


def codebase_facts(current: Current) -> DataFrame:
    """(codebase_id, facts): a hash of the codebase's run rows and ground truth, which labels do not cover."""
    runs = current.runs.groupBy("codebase_id").agg(rows_hash(*sorted(current.runs.columns)).alias("run_rows"))
    truth = current.gt.groupBy("codebase_id").agg(rows_hash(*sorted(current.gt.columns)).alias("gt_rows"))
    facts = content_hash(F.concat_ws(":", "run_rows", F.coalesce("gt_rows", F.lit("none"))))
    return runs.join(truth, "codebase_id", "left").select("codebase_id", facts.alias("facts"))


def refresh(
    spark: SparkSession, folder: str, current: Current, judges: Judges, tables: Collection[str] | None = None, force: bool = False
) -> Refreshed:
    """Bring the feed in ``folder`` up to date; ``tables`` names the report tables to keep, all by default.

    Runs are judged again when their ground truth, text or prompt changed or they were never judged; codebases are touched
    by such a run, a run that is gone, changed run rows or ground truth, or another model. ``force`` judges and writes all.
    Codebases that are gone leave the feed. Tables with a codebase hold it as ``codebase_id``.
    """
    with Scratch(spark) as own:

        def kept(name: str, like: DataFrame) -> DataFrame:
            return feed.read_report_table(spark, folder, name) if feed.has_table(spark, folder, name) else like.limit(0)

        def only(frame: DataFrame, codebases: DataFrame, how: str = "left_semi") -> DataFrame:
            return frame.join(codebases.select("codebase_id"), "codebase_id", how)

        write_id, states = feed.new_write(), {}

        def stored(name: str, table: DataFrame) -> DataFrame:
            states[name] = feed.store(spark, folder, write_id, name, table)
            return states[name]

        hashes = own.table(
            current.hashes.select("run_id", "codebase_id", "gt_hash", "stdout_hash", F.lit(judges.prompt_hash).alias("prompt_hash"))
        )
        facts = own.table(codebase_facts(current))
        made = {
            "clustered": facts.select("codebase_id", F.lit("").alias("cluster_model"), F.lit("").alias("input_hash")),
            "validated": facts.select("codebase_id", F.lit("").alias("validator_model"), F.lit("").alias("cluster_hash")),
        }
        judged, known_facts = kept("classified", hashes), kept("facts", facts)
        clustered, validated = (kept(name, like) for name, like in made.items())
        runs_now = hashes.select("run_id", "codebase_id")
        stale = own.table(runs_now.join(stale_classifications(hashes, judged, force), "run_id", "left_semi"))
        touched = [
            stale.select("codebase_id"),
            judged.join(runs_now, ["run_id", "codebase_id"], "left_anti").select("codebase_id"),
            facts.join(known_facts, ["codebase_id", "facts"], "left_anti").select("codebase_id"),
            known_facts.join(facts, "codebase_id", "left_anti").select("codebase_id"),
            clustered.filter(F.col("cluster_model") != judges.cluster_model).select("codebase_id"),
            validated.filter(F.col("validator_model") != judges.validator_model).select("codebase_id"),
        ]
        if force:
            touched.append(facts.select("codebase_id"))
        touched = own.table(reduce(DataFrame.union, touched).distinct())
        if touched.isEmpty():
            return Refreshed(feed.last_version(spark, folder))

        gt, runs = only(current.gt, touched), only(current.runs, touched)
        findings = only(current.findings, touched)
        fresh = judges.classify(findings.join(stale.select("run_id"), "run_id", "left_semi"), gt)
        still = runs_now.select("run_id").join(stale.select("run_id"), "run_id", "left_anti")
        old = only(kept("labels", fresh), touched).join(still, "run_id", "left_semi")
        labels = stored("labels", fresh.unionByName(old))
        stored("classified", only(hashes, touched))
        runs_judged = stale.count()
        own.drop(hashes)

        inputs = own.table(judges.inputs(labels, findings, runs, gt))
        input_hashes = own.table(cluster_input_hash(inputs, judges.cluster_model, judges.scope_files))
        to_cluster = own.table(stale_clusters(input_hashes, clustered, judges.cluster_model, force))
        clusters, members = judges.cluster(only(inputs, to_cluster))
        stay = only(input_hashes, to_cluster, "left_anti")
        clusters = stored("clusters", clusters.unionByName(only(kept("clusters", clusters), stay)))
        members = stored("members", members.unionByName(only(kept("members", members), stay)))

        cluster_hashes = own.table(cluster_content_hash(clusters, members, judges.validator_model))
        to_validate = own.table(stale_validations(cluster_hashes, validated, judges.validator_model, force))
        verdicts = judges.validate(only(clusters, to_validate), only(members, to_validate))
        stay = only(cluster_hashes, to_validate, "left_anti")
        verdicts = stored("verdicts", verdicts.unionByName(only(kept("verdicts", verdicts), stay)))
        own.drop(inputs)

        caught = clustering.caught_conditions(members)
        tables_now = codebase_tables(Results(runs, labels, gt, clusters, members, caught, verdicts, current.conditions), own.table)
        parts = {name: stored(name, tables_now[name]) for name in ("conditions", *PARTS)}
        whole = {name: part.unionByName(only(kept(name, part), touched, "left_anti")) for name, part in parts.items()}
        pooled = pooled_tables(*whole.values(), current.conditions, own.table)
        stored("facts", only(facts, touched))
        stored("clustered", input_hashes.select("codebase_id", F.lit(judges.cluster_model).alias("cluster_model"), "input_hash"))
        stored("validated", cluster_hashes.select("codebase_id", F.lit(judges.validator_model).alias("validator_model"), "cluster_hash"))
        wanted = {name: t for name, t in (tables_now | pooled).items() if name not in states and (tables is None or name in tables)}
        version = feed.commit(spark, folder, {name: (t, touched) for name, t in (wanted | states).items()}, write_id, states)
        return Refreshed(version, runs_judged, touched.count(), to_cluster.count(), to_validate.count())
