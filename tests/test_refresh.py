"""Versions of the feed, and refreshes that judge and write only what is stale."""

import time
from dataclasses import replace
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clustering
from gaugeline.plans import report, standins
from gaugeline.plans.refresh import Current, Judges, refresh
from gaugeline.session import SHUFFLE_CLEANUP, Scratch, ensure_checkpoint_dir
from gaugeline.sources import feed


def table(spark, folder, name, version=None):
    return sorted((tuple(r) for r in feed.read_report_table(spark, str(folder), name, version=version).collect()), key=repr)


# --- the feed ----------------------------------------------------------------------------------------------------


def test_versions_replace_codebases_and_stay_readable(spark, rows, tmp_path):
    schema = "codebase_id string, n int"
    first = rows([("01", 1), ("b", 2), (None, 3), ("none", 4)], schema)
    pooled = rows([(10,)], "total int")
    assert feed.write_report_tables({"t": first, "p": pooled}, str(tmp_path)) == 1
    gone = rows([("b",), ("01",), (None,)], "codebase_id string")
    changed = rows([("01", 7)], schema)
    assert feed.commit(spark, str(tmp_path), {"t": (changed, gone), "p": (rows([(8,)], "total int"), gone)}) == 2
    assert table(spark, tmp_path, "t") == [("01", 7), ("none", 4)]
    assert table(spark, tmp_path, "t", version=1) == [("01", 1), ("b", 2), ("none", 4), (None, 3)]
    assert (table(spark, tmp_path, "p"), table(spark, tmp_path, "p", 1)) == ([(8,)], [(10,)])
    assert feed.write_report_tables({"t": first.limit(0)}, str(tmp_path)) == 3
    assert table(spark, tmp_path, "t") == [] and feed.read_report_table(spark, str(tmp_path), "t").columns == ["codebase_id", "n"]
    assert table(spark, tmp_path, "p") == [(8,)] and feed.last_version(spark, str(tmp_path)) == 3
    with pytest.raises(ValueError):
        feed.read_report_table(spark, str(tmp_path), "none")


def test_a_write_that_fails_midway_leaves_the_feed_as_it_was(spark, rows, tmp_path):
    good = rows([("a", 1)], "codebase_id string, n int")
    feed.write_report_tables({"t": good, "u": good}, str(tmp_path))
    bad = good.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        feed.write_report_tables({"t": good.withColumn("n", F.lit(2)), "u": bad}, str(tmp_path))
    assert table(spark, tmp_path, "t") == table(spark, tmp_path, "u") == [("a", 1)]
    assert feed.write_report_tables({"t": good.withColumn("n", F.lit(3))}, str(tmp_path)) == 2
    assert table(spark, tmp_path, "t") == [("a", 3)] and table(spark, tmp_path, "u") == [("a", 1)]


def test_codebase_ids_keep_their_type(spark, rows, tmp_path):
    feed.write_report_tables({"n": rows([(7, 1)], "codebase_id long, n int"), "s": rows([("007/x=1", 1)], "codebase_id string, n int")}, str(tmp_path))
    assert table(spark, tmp_path, "n") == [(7, 1)] and table(spark, tmp_path, "s") == [("007/x=1", 1)]


# --- refreshes ---------------------------------------------------------------------------------------------------

GT = [("demo", "H-1", "Reentrancy in exit"), ("demo", "H-2", "Open fees"), ("lend", "H-1", "Price by flash loan")]
FOUND = {  # run: codebase, condition, hour, titles
    "d1": ("demo", "skill_x", 1, ["Reentrancy in exit", "Open fees", "Odd storage", "Owner may halt"]),
    "d2": ("demo", "skill_x", 2, ["Reentrancy in exit", "Owner may halt now"]),
    "d3": ("demo", "bare_audit", 3, ["Open fees", "Compiler not pinned"]),
    "l1": ("lend", "skill_x", 1, ["Price by flash loan", "Interest rounds down"]),
    "l2": ("lend", "bare_audit", 2, ["Interest rounds down", "Style of names"]),
    "s1": ("swap", "skill_x", 1, ["Slippage unchecked", "Slippage not checked"]),
}


def current(rows, found=FOUND, gt=GT, invalid=()):
    runs, findings, hashes = [], [], []
    for run, (codebase, condition, hour, titles) in found.items():
        mode = "bare" if condition == "bare_audit" else "skill"
        runs.append((run, codebase, condition, f"2026-01-01T{hour:02}", 1000 * hour, 0.5, mode, run not in invalid, True, False, 0, 900, len(titles)))
        findings += [(run, i, i, codebase, condition, t, f"C{i}", "other", None) for i, t in enumerate(titles, 1)]
        hashes.append((run, codebase, str(sorted(g for g in gt if g[0] == codebase)), "|".join(titles)))
    return Current(
        rows(runs, "run_id string, codebase_id string, condition_id string, ts string, duration_ms long, cost_usd double, mode string, "
                   "is_valid boolean, is_classified boolean, timed_out boolean, exit_code int, text_chars int, findings_count int"
        ).withColumn("invalid", F.when(~F.col("is_valid"), "too short")),
        rows(findings, "run_id string, position int, index int, codebase_id string, condition_id string, title string, location string, "
                       "vuln_type string, description string"),
        rows([(c, g, i, "high", t) for i, (c, g, t) in enumerate(gt)], "codebase_id string, gt_id string, gt_pos int, severity string, title string"),
        rows([("skill_x", "skill", 1), ("bare_audit", "bare", 2)], "condition_id string, type string, position int"),
        rows(hashes, "run_id string, codebase_id string, gt_hash string, stdout_hash string"),
    )


def judges(log, model="m"):
    def classify(findings, gt):
        log["judged"] = {r.run_id for r in findings.select("run_id").collect()}
        items = gt.select("codebase_id", "title", F.col("gt_id").alias("matched_gt_id"))
        category = F.when(F.col("matched_gt_id").isNotNull(), "matched").when(F.col("title").rlike("Style|Compiler"), "fp").otherwise("novel")
        return findings.join(items, ["codebase_id", "title"], "left").select(
            "run_id", "position", F.col("index").alias("finding_index"), "codebase_id", "condition_id", F.lit(True).alias("is_valid"), "title",
            F.lit("1/1").alias("agreement"), F.lit(1).alias("agreement_count"), category.alias("category"), "matched_gt_id",
            F.concat(F.lit("says "), "title").alias("reasoning"))

    def cluster(inputs):
        log["clustered"] = {r.codebase_id for r in inputs.select("codebase_id").collect()}
        return clustering.cluster_findings(inputs.withColumn("root_cause", F.lower("title")))

    def validate(clusters, members):
        log["validated"] = {r.codebase_id for r in clusters.select("codebase_id").collect()}
        return clusters.select(
            "codebase_id", "cluster_id", "title", F.when(F.col("title").contains("Owner"), "centralization-risk").alias("risk_category"),
            F.lit(None).cast("string").alias("code_evidence"), "severity", F.lit(0).alias("pos"), F.lit("confirmed").alias("verdict"))

    return Judges(classify, cluster, validate, "p1", model, model)


FEW = ("conditions", "header", "risk_excluded")


def full(spark, now, folder, tables=None):
    """The tables of a first refresh into an empty feed."""
    refresh(spark, str(folder), now, judges({}), tables)
    return folder


TABLES = ["runs", "matches", "conditions", "missed_gt", "reliability", "ledger", "matrix", "comparison", "recall_chart", "validations",
          "overview", "analysis_feed", "header", "condition_order", "cross_codebase", "metric_bests", "missed_totals", "risk_excluded",
          "dashboard", "labels", "clusters", "members", "verdicts", "classified"]


def test_refresh_writes_only_what_is_stale_and_equals_a_full_run(spark, rows, tmp_path):
    folder, log = str(tmp_path / "feed"), {}
    done = refresh(spark, folder, current(rows), judges(log))
    assert (done.version, done.runs_judged, done.codebases_touched) == (1, 6, 3)
    assert log["judged"] == set(FOUND) and log["clustered"] == {"demo", "lend", "swap"}
    assert table(spark, folder, "risk_excluded") == [(1,)]
    assert refresh(spark, folder, current(rows), judges(log)) == replace(done, runs_judged=0, codebases_touched=0, codebases_clustered=0, codebases_validated=0)

    found = FOUND | {"l2": ("lend", "bare_audit", 2, ["Interest rounds down", "Price by flash loan", "Dust is lost"])}
    log.clear()
    done = refresh(spark, folder, current(rows, found), judges(log))
    assert (done.version, done.runs_judged, done.codebases_touched, done.codebases_clustered, done.codebases_validated) == (2, 1, 1, 1, 1)
    assert log == {"judged": {"l2"}, "clustered": {"lend"}, "validated": {"lend"}}
    commits = feed.read_log(spark, folder).filter("version = 2")
    assert {r.part for r in commits.filter("kind = 'rows'").select("part").distinct().collect()} == {"c:lend", "all"}
    again = full(spark, current(rows, found), tmp_path / "again")
    for name in TABLES:
        assert table(spark, folder, name) == table(spark, again, name), name
    assert table(spark, folder, "runs", version=1) != table(spark, folder, "runs")


def test_refresh_after_deletions_and_other_facts(spark, rows, tmp_path):
    folder, log = str(tmp_path / "feed"), {}
    refresh(spark, folder, current(rows), judges(log), FEW)
    found = {run: x for run, x in FOUND.items() if run not in ("d2", "s1")}
    now = current(rows, found, invalid={"l1"})
    log.clear()
    done = refresh(spark, folder, now, judges(log), FEW)
    assert (done.runs_judged, done.codebases_touched) == (0, 3)  # a run is gone, a codebase is gone, a run became invalid
    assert log == {"judged": set(), "clustered": {"demo"}, "validated": {"demo"}}
    again = full(spark, now, tmp_path / "again", FEW)
    for name in (*FEW, "labels", "clusters", "members", "verdicts", "classified"):
        assert table(spark, folder, name) == table(spark, again, name), name


def test_another_ground_truth_or_model(spark, rows, tmp_path):
    folder, log = str(tmp_path / "feed"), {}
    refresh(spark, folder, current(rows), judges(log), FEW)
    now = current(rows, gt=GT + [("lend", "H-2", "Interest rounds down")])
    done = refresh(spark, folder, now, judges(log), FEW)
    assert (done.runs_judged, done.codebases_touched) == (2, 1) and log["judged"] == {"l1", "l2"}
    log.clear()
    done = refresh(spark, folder, now, judges(log, "m2"), FEW)
    assert (done.runs_judged, log["judged"], log["clustered"]) == (0, set(), {"demo", "swap"})
    assert refresh(spark, folder, now, judges(log, "m2"), FEW).version == done.version
    stale = refresh(spark, folder, now, replace(judges(log, "m2"), prompt_hash="p2"), FEW)
    assert (stale.runs_judged, stale.codebases_clustered) == (6, 0)


# --- what stays on disk ------------------------------------------------------------------------------------------


def scratch_tables(spark):
    ensure_checkpoint_dir(spark)
    return {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("table-*")}


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}


def one_cluster(inputs):
    named = inputs.select("*", F.lit("c1").alias("cluster_id"))
    texts = [F.lit(x).alias(x) for x in ("title", "reasoning", "severity")]
    return named.select("codebase_id", "cluster_id", *texts).distinct(), named.select(*clustering.MEMBER)


def test_a_refresh_leaves_nothing_on_disk_but_the_feed(spark, rows, tmp_path):
    folder, before, setting = str(tmp_path / "feed"), scratch_tables(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    plain = replace(judges({}), cluster=one_cluster)
    done = refresh(spark, folder, current(rows), plain, ("conditions",))
    assert done.version == 1 and scratch_tables(spark) == before
    assert len(list((tmp_path / "feed" / "labels").glob("feed_write=*"))) == 1

    def fails(clusters, members):
        raise ValueError("lost")

    with pytest.raises(ValueError, match="lost"):
        refresh(spark, folder, current(rows), replace(plain, validate=fails), ("conditions",), force=True)
    assert scratch_tables(spark) == before and feed.last_version(spark, folder) == 1
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_shuffle_files_go_with_their_query(spark):
    before = shuffle_files(spark)
    with Scratch(spark) as own:
        counted = own.table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        grouped = counted.repartition(3, "k").groupBy("count").count()
        assert (grouped.count(), grouped.count(), counted.count()) == (2, 2, 7)
        until = time.time() + 20
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        own.drop(counted)


def test_stored_tables_are_committed_without_a_second_write(spark, rows, tmp_path):
    good, write_id = rows([("a", 1), (None, 2)], "codebase_id string, n int"), feed.new_write()
    stored = feed.store(spark, str(tmp_path), write_id, "t", good)
    assert not feed.has_table(spark, str(tmp_path), "t") and stored.columns == ["codebase_id", "n"]
    assert feed.commit(spark, str(tmp_path), {"t": (stored, None), "u": (stored, None)}, write_id, ["t"]) == 1
    assert table(spark, tmp_path, "t") == table(spark, tmp_path, "u") == [("a", 1), (None, 2)]


def test_labels_of_some_runs_are_those_of_all(spark, rows):
    items = [(run, part, part % 2, part, 10.0 + part, "R" if part % 3 else "N", "F") for run in range(1, 9) for part in range(1, 7)]
    t = SimpleNamespace(
        nation=rows([(0, 0), (1, 4), (2, None)], "n_nationkey int, n_regionkey int"),
        customer=rows([(c, c % 3) for c in range(4)], "c_custkey long, c_nationkey int"),
        supplier=rows([(0, "S0", 0), (1, "S1", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        orders=rows([(run, run % 4, "F", 9.0, "2026-01-01", "1-URGENT") for run in range(1, 9)],
                    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"),
        lineitem=rows(items + items[:3], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                                         "l_returnflag string, l_linestatus string"),
    )
    asked = rows([(1,), (3,), (4,), (8,), (99,), (None,)], "run_id long")
    every = standins.labels(t).join(asked, "run_id", "left_semi").select(*standins.labels(t).columns)
    some = standins.labels(t, asked)
    assert every.count() == 27 and some.columns == every.columns
    assert sorted(map(repr, some.collect())) == sorted(map(repr, every.collect()))
