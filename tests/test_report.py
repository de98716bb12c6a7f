"""A small results folder read from real files, through all report relations."""

import json

import pytest

from pyspark.sql import functions as F

from gaugeline.operators import ledger, refresh
from gaugeline.plans import report
from gaugeline.sources import feed, files

RUNS = [
    # run, condition, iteration, mode, hour, duration, findings as (title, category, gt id)
    ("run-a1", "skill_x", 1, "skill", 10, 120000, [
        ("Reentrancy in Pool.exit", "matched", "H-01"), ("Missing Access Control on Fees.set", "matched", "H-02"),
        ("Flash Loan on Oracle.read", "novel", None), ("Style of storage", "fp", None)]),
    ("run-a2", "skill_x", 2, "skill", 11, 130000, [
        ("Reentrancy in Pool.exit", "matched", "H-01"), ("Unchecked Return in Gate.send", "novel", None),
        ("Admin powers", "novel", None)]),
    ("run-b1", "bare_audit", 1, "bare", 12, 60000, [
        ("Reentrancy in Pool.exit", "matched", "H-01"), ("Missing Access Control on Fees.set", "matched", "H-02"),
        ("Price by Flash Loan", "novel", None), ("Compiler not pinned", "fp", None)]),
]


def member(run, condition, index, title):
    return {"runId": run, "conditionId": condition, "findingIndex": index, "findingTitle": title}


CLUSTERS = [
    ("n-flash", "Flash loan moves the price", ["skill_x", "bare_audit"],
     [member("run-a1", "skill_x", 3, "x"), member("run-b1", "bare_audit", 3, "x")], "confirmed", None),
    ("n-return", "Unchecked send result", ["skill_x"], [member("run-a2", "skill_x", 2, "x")], "plausible", None),
    ("n-admin", "Admin may take all", ["skill_x"], [member("run-a2", "skill_x", 3, "x")], "confirmed", "centralization-risk"),
]


def text_of(mode, found):
    if mode == "bare":
        return "\n".join(f"### [HIGH] {title}\n\nBody." for title, *_ in found)
    head = "🔐 Security Review\n\n"
    return head + "\n".join(f"[80] **{i}. {title}**\n\n{'Long body. ' * 30}\n" for i, (title, *_) in enumerate(found, 1))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("bench")
    results, truth = root / "results", root / "ground_truth"
    results.mkdir()
    truth.mkdir()
    for run, condition, iteration, mode, hour, duration, found in RUNS:
        meta = dict(runId=run, codebaseId="demo", conditionId=condition, iteration=iteration, mode=mode,
                    timestampUtc=f"2026-01-01T{hour}:00:00.000Z", durationMs=duration, exitCode=0, timedOut=False, model="m")
        (results / f"{run}.meta.json").write_text(json.dumps(meta, indent=1))
        (results / f"{run}.stdout.txt").write_text(text_of(mode, found))
        labels = [dict(findingIndex=i, findingTitle=title, category=category, matchedGtId=gt, agreement="1/1", reasoning="r", votes=[])
                  for i, (title, category, gt) in enumerate(found, 1)]
        (results / f"{run}.classifications.json").write_text(
            json.dumps(dict(runId=run, codebaseId="demo", conditionId=condition, gtHash="a", stdoutHash="b", classifications=labels)))
    (results / "run-x.meta.json").write_text(json.dumps(dict(RUNS=1, runId="run-x", codebaseId="demo", conditionId="skill_x", exitCode=1)))
    (results / "run-y.meta.json").write_text("{broken")
    (results / "clusters-demo.json").write_text(json.dumps(dict(codebaseId="demo", clusters=[
        dict(clusterId=c, title=t, reasoning="r", severity="high", foundIn=m, conditionsCaught=k) for c, t, k, m, _, _ in CLUSTERS])))
    (results / "novel-clusters-demo.json").write_text(json.dumps(dict(clusters=[dict(clusterId="old", title="old", foundIn=[])])))
    (results / "validations-demo.json").write_text(json.dumps(dict(codebaseId="demo", validations=[
        {k: v for k, v in dict(clusterId=c, title=t, verdict=verdict, severity="high", reasoning="r", riskCategory=risk).items() if v}
        for c, t, _, _, verdict, risk in CLUSTERS])))
    (truth / "demo.json").write_text(json.dumps(dict(codebaseId="demo", findings=[
        dict(id="H-01", title="Reentrancy in exit", severity="high", description="d"),
        dict(id="H-02", title="Fees open to all", severity="high", description="d"),
        dict(id="M-01", severity="medium", description="Return value dropped")])))
    (root / "bench.json").write_text(json.dumps(dict(codebases=[], conditions=[
        dict(id="bare_audit", type="bare", prompt="p"), dict(id="skill-x_v2", type="skill")])))
    return root


@pytest.fixture(scope="module")
def tables(spark, folders):
    loaded = report.load_results(spark, str(folders / "results"), str(folders / "ground_truth"), str(folders / "bench.json"))
    return report.report_tables(loaded)


def by(frame, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in frame.collect()}


def test_conditions(tables):
    got = by(tables["conditions"], "condition_id")
    skill, bare = got["skill_x"], got["bare_audit"]
    assert (skill.valid_runs, skill.total_runs, skill.avg_matched, skill.avg_recall) == (2, 2, 1.5, 0.5)
    assert (skill.consistency, skill.total_fp, skill.total_findings, skill.avg_fp) == (0.5, 1, 7, 0.5)
    assert skill.fp_rate == pytest.approx(1 / 7) and skill.avg_findings_count == 3.5 and skill.avg_duration_ms == 125000
    assert (skill.unique_bugs_found, skill.confirmed_novels, skill.confirmed_novels_filtered) == (3, 2, 1)
    assert (skill.plausible_novels, skill.plausible_novels_filtered, skill.avg_cost) == (1, 1, None)
    assert bare.avg_recall == pytest.approx(2 / 3) and bare.fp_rate == 0.25 and bare.consistency is None
    assert (bare.unique_bugs_found, bare.confirmed_novels) == (1, 1)


def test_bests_missed_and_header(tables):
    bests = {}
    for r in tables["metric_bests"].collect():
        bests.setdefault(r.metric, set()).add(r.condition_id)
    assert bests == {"recall": {"bare_audit"}, "fpRate": {"skill_x"}, "consistency": {"skill_x"},
                     "avgDuration": {"bare_audit"}, "confirmedNovelsFiltered": {"skill_x", "bare_audit"}}
    assert [(r.gt_id, r.title) for r in tables["missed_gt"].collect()] == [("M-01", "Return value dropped")]
    totals = tables["missed_totals"].first()
    assert (totals.gt_missed_total, totals.gt_total_all, totals.gt_missed_percent) == (1, 3, 33)
    header = tables["header"].first()
    assert (header.total_runs, header.valid_runs, header.invalid_runs, header.codebases) == (3, 3, 0, 1)
    assert tables["risk_excluded"].first().excluded == 1
    assert tables["integrity"].count() == 0


def test_ledger_in_display_order(tables):
    rows = tables["ledger"].collect()
    order = list(dict.fromkeys(r.title for r in rows))
    assert order == ["Reentrancy in exit", "Fees open to all", "Return value dropped", "Admin may take all",
                     "Flash loan moves the price", "Unchecked send result", "Compiler not pinned", "Style of storage"]
    cells = {(r.title, r.condition_id): (r.cell, r.status) for r in rows}
    assert cells[("Reentrancy in exit", "skill_x")] == ("✓", "H-01")
    assert cells[("Fees open to all", "skill_x")] == ("✓#1", "H-02")
    assert cells[("Return value dropped", "bare_audit")] == ("-", "M-01")
    assert cells[("Admin may take all", "skill_x")] == ("✓#2", "confirmed")
    assert cells[("Flash loan moves the price", "bare_audit")] == ("✓", "confirmed")
    assert cells[("Unchecked send result", "skill_x")] == ("✓#2", "plausible")
    assert cells[("Style of storage", "skill_x")] == ("✓#1", "FP") and cells[("Style of storage", "bare_audit")] == ("-", "FP")


def test_matrix_and_reliability(spark, folders, tables):
    loaded = report.load_results(spark, str(folders / "results"), str(folders / "ground_truth"), str(folders / "bench.json"))
    cells = {(r.gt_id, r.run_id): r.cell for r in ledger.dense_matrix(tables["matrix"], loaded.gt, loaded.runs).collect()}
    assert cells == {("H-01", "run-a1"): "1/1", ("H-01", "run-a2"): "1/1", ("H-01", "run-b1"): "1/1",
                     ("H-02", "run-a1"): "1/1", ("H-02", "run-a2"): "-", ("H-02", "run-b1"): "1/1",
                     ("M-01", "run-a1"): "-", ("M-01", "run-a2"): "-", ("M-01", "run-b1"): "-"}
    assert {(r.gt_id, r.label, r.found_count) for r in tables["reliability"].collect()} == {
        ("H-01", "RELIABLE", 2), ("H-02", "INCONSISTENT", 1)}


def test_run_rows(tables):
    got = by(tables["runs"], "run_id")
    assert (got["run-a1"].matched, got["run-a1"].novel, got["run-a1"].fp, got["run-a1"].uncertain) == (2, 1, 1, 0)
    assert got["run-a1"].precision == pytest.approx(2 / 3) and got["run-a2"].precision == 1.0
    assert got["run-a2"].f1 == pytest.approx(0.5)
    overview = by(tables["overview"], "run_id")
    assert [overview[r].run_label for r in ("run-a1", "run-a2", "run-b1")] == ["skill_x #1", "skill_x #2", "bare_audit"]
    chart = by(tables["recall_chart"], "run_id")
    assert (chart["run-a2"].found, chart["run-a2"].percent, chart["run-a2"].state) == (1, 33, "ok")
    order = by(tables["condition_order"], "condition_id")
    assert (order["skill_x"].condition_pos, order["bare_audit"].condition_pos) == (8000, 9000)


def test_latest_keeps_one_run_per_condition(spark, folders):
    loaded = report.load_results(
        spark, str(folders / "results"), str(folders / "ground_truth"), str(folders / "bench.json"), latest=True)
    assert {r.run_id for r in loaded.runs.collect()} == {"run-a2", "run-b1"}


def test_written_once_and_read_back(spark, tables, tmp_path):
    small = {name: tables[name] for name in ("conditions", "missed_totals")}
    feed.write_report_tables(small, str(tmp_path))
    assert feed.read_report_table(spark, str(tmp_path), "conditions").count() == 2
    assert feed.read_report_table(spark, str(tmp_path), "missed_totals").first().gt_missed_percent == 33


def test_preflight_on_files(spark, folders):
    metas = files.check_run_meta(files.read_files(spark, str(folders / "results"), "*.meta.json"))
    texts = files.parse_run_text(files.read_files(spark, str(folders / "results"), "*.stdout.txt"))
    truth = files.check_ground_truth(files.read_files(spark, str(folders / "ground_truth"), "*.json"))
    chars = texts.selectExpr("run_id", "length(text) as chars")
    got = {(r.file, r.reason) for r in refresh.preflight(metas, chars, truth).collect()}
    assert got == {("run-y.meta.json", "invalid JSON")}
    assert refresh.preflight(metas.filter("false"), chars, truth).first().reason == "no .meta.json files found"


def test_condition_names(spark, folders, rows):
    names = files.parse_conditions(files.read_files(spark, str(folders), "bench.json")).orderBy("position").collect()
    assert [(r.label, r.subtitle) for r in names] == [
        ("Bare CC", "No skill, audit prompt only"), ("Skill X V2", "skill-x_v2 skill")]
    frame = rows([("v2.beta-x", "skill"), ("(new) éa_b", "skill")], "condition_id string, type string")
    label = files.condition_names(frame.condition_id, frame.type)["label"]
    assert [r[0] for r in frame.select(label).collect()] == ["V2.Beta X", "(New) éA B"]


def test_a_log_of_several_splits_keeps_its_order(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / f"{run}.events.jsonl").write_text("".join(f"{run}{i}\n" for i in range(700)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        lines = files.read_event_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for run in ("a", "b"):
        own = sorted((r.seq, r.raw) for r in lines if r.run_id == run)
        assert own == [(i, f"{run}{i}") for i in range(700)]


def test_scope_and_source_files(spark, tmp_path):
    base = tmp_path / "sets" / "demo"
    for path, body in {"src/A.sol": "a", "test/T.sol": "t", "src/.hid/H.sol": "h", "lib/node_modules/N.sol": "n", "B.sol": "b",
                       "scope.txt": "./src/A.sol\n\n", "out_of_scope.txt": " ./src/mock/Mocker.sol "}.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(body)
    root = str(tmp_path / "sets")
    found = files.parse_source_files(files.read_files(spark, root, "*.sol", recursive=True), root)
    assert {(r.codebase_id, r.path, r.content) for r in found.collect()} == {("demo", "src/A.sol", "a"), ("demo", "B.sol", "b")}
    scope = files.parse_scope(files.read_files(spark, root, "*scope.txt", recursive=True))
    assert {(r.codebase_id, r.path, r.in_scope) for r in scope.collect()} == {
        ("demo", "src/A.sol", True), ("demo", "src/mock/Mocker.sol", False)}


def test_preflight_reads_each_metadata_file_once(spark, rows):
    calls = spark.sparkContext.accumulator(0)

    def checked(file):
        calls.add(1)
        return file != "bad.meta.json"

    listed = [("bad.meta.json", "r0", "cb", "c", 0), ("gone.meta.json", "r1", "cb", "c", 0), ("empty.meta.json", "r2", "cb", "c", 143)]
    listed += [("ok.meta.json", "r3", "cb", "c", 0), ("failed.meta.json", "r4", "cb", "c", 1), ("none.meta.json", None, "cb", "c", 0)]
    listed += [("open.meta.json", "r5", "cb", "c", None), ("r3", "r6", "cb", "c", 1)]
    frame = rows(listed, "file string, run_id string, codebase_id string, condition_id string, exit_code int")
    metas = frame.withColumn("valid_json", F.udf(checked, "boolean")("file"))
    texts = rows([("r2", 0), ("r3", 0), ("r3", 9), ("r4", 0), (None, 0)], "run_id string, chars int")
    truth = rows([("g.json", True, True)], "file string, valid_json boolean, has_findings boolean")
    got = sorted((r.file, r.reason) for r in refresh.preflight(metas, texts, truth).collect())
    assert got == [
        ("bad.meta.json", "invalid JSON"), ("none.meta.json", "missing required fields (runId, codebaseId, or conditionId)"),
        ("r1.stdout.txt", "missing (meta says exit 0 but no stdout file)"), ("r2.stdout.txt", "empty file (0 bytes)"),
        ("r3.stdout.txt", "empty file (0 bytes)"),
    ]
    assert calls.value == len(listed)
