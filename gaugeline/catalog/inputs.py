"""Registered queries for scans and sinks (A) and refresh checks (I).

File contents are derived row by row from the tables, so the parse steps run over whole tables; reading the same
contents from real files is covered by the tests.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.catalog.evaluation import CONDITION_ROUNDED
from gaugeline.catalog.oracle_views import six, sixes
from gaugeline.catalog.registry import Registry, named, rounded
from gaugeline.operators import clustering, metrics, refresh
from gaugeline.plans import refresh as refresh_plan
from gaugeline.plans import report
from gaugeline.plans import standins as s
from gaugeline.session import Scratch, ensure_checkpoint_dir, materialised
from gaugeline.sources import feed, files

register = Registry()


def _meta_files(t):
    """One metadata file per order; some are malformed or lack a field."""
    key = F.col("run_id")
    runs = s.runs(t)
    meta = F.to_json(
        F.struct(
            F.concat_ws("_", F.lit("r"), "codebase_id", "condition_id", key).alias("runId"),
            F.when(key % 29 != 0, F.col("codebase_id").cast("string")).alias("codebaseId"),
            F.col("condition_id").alias("conditionId"),
            (key % 5).alias("iteration"),
            F.when(key % 41 == 0, "other").otherwise(F.col("mode")).alias("mode"),
            F.when(key % 43 == 0, "yesterday")
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            .alias("timestampUtc"),
            F.col("duration_ms").alias("durationMs"),
            F.col("exit_code").alias("exitCode"),
            F.col("timed_out").alias("timedOut"),
            F.when(key % 3 == 0, F.when(key % 47 == 0, "XYZ").otherwise("abcdef0123")).alias("codebaseGitCommit"),
            F.when(key % 2 == 0, "v2").alias("skillVersion"),
            F.lit("model-a").alias("model"),
        )
    )
    content = F.when(key % 23 == 0, F.concat(F.lit("{broken"), meta)).otherwise(meta)
    return runs.select(F.concat(F.lit("r"), key, F.lit(".meta.json")).alias("file"), content.alias("content"))


METAS = """
metas as (select *, 'r_'||codebase_id||'_'||condition_id||'_'||run_id rid, run_id%23<>0 valid_json,
  case when run_id%29<>0 then codebase_id::varchar end cb, case when run_id%41=0 then 'other' else mode end md,
  case when run_id%43=0 then 'yesterday' else strftime(ts,'%Y-%m-%dT%H:%M:%S.000Z') end stamp from s_runs)"""


@register("a1_scan_runs", named(METAS, """
select rid run_id, cb codebase_id, condition_id, run_id%5 iteration, md as mode, stamp timestamp_utc, duration_ms, exit_code, timed_out
from metas where valid_json and exit_code in (0,143) and run_id%31<>0"""))
def scan_runs(t):
    metas = files.parse_run_meta(_meta_files(t))
    texts = s.runs(t).filter("run_id % 31 <> 0").select(
        F.concat_ws("_", F.lit("r"), "codebase_id", "condition_id", "run_id").alias("run_id")
    )
    return files.usable_runs(metas, texts).select(
        "run_id", "codebase_id", "condition_id", "iteration", "mode", "timestamp_utc", "duration_ms", "exit_code", "timed_out"
    )


@register("a2_scan_run_text", "select 'doc-'||doc_id run_id, md5(text) digest from documents")
def scan_run_text(t):
    raw = t.documents.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".stdout.txt")).alias("file"), F.col("text").alias("content"))
    return files.parse_run_text(raw).select("run_id", F.md5("text").alias("digest"))


@register("a3_event_lines", """
select 'doc-'||doc_id run_id, i seq, l raw from (select doc_id, unnest(string_split(text, chr(10))) l,
  generate_subscripts(string_split(text, chr(10)), 1)-1 i from documents)""")
def event_lines(t):
    raw = t.documents.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".events.jsonl")).alias("file"), F.col("text").alias("content"))
    return files.parse_event_lines(raw)


@register("a4_scan_ground_truth", """
select s_name codebase_id, case when g.i is not null then s_suppkey||'-'||g.i end gt_id, g.i-1 gt_pos,
  case when g.i%2=0 then 'high' end severity, case when g.i=3 then 'no title' else 'T'||g.i end title
from supplier left join (values (1),(2),(3)) g(i) on g.i<=s_suppkey%4 where g.i is not null
union all select s_name, null, null, null, null from supplier where s_suppkey%4=0""")
def scan_ground_truth(t):
    item = """concat('{"id":"', s_suppkey, '-', i, '"', case when i % 2 = 0 then ',"severity":"high"' else '' end,
      case when i = 3 then '' else concat(',"title":"T', i, '"') end, ',"description":"',
      case when i = 3 then 'no title' else 'why' end, '"}')"""
    listed = f"case when s_suppkey % 4 = 0 then '' else array_join(transform(sequence(1, cast(s_suppkey % 4 as int)), i -> {item}), ',') end"
    raw = t.supplier.select(
        F.concat("s_name", F.lit(".json")).alias("file"),
        F.expr(f"""concat('{{"codebaseId":"', s_name, '","findings":[', {listed}, ']}}')""").alias("content"),
    )
    return files.parse_ground_truth(raw).select(
        "codebase_id", "gt_id", "gt_pos", "severity", F.when(F.col("gt_id").isNotNull(), F.col("title")).alias("title")
    )


def _label_files(t):
    key = F.col("o_orderkey")
    entry = """concat('{"findingIndex":', i, ',"findingTitle":"F', i, '","category":"', case when i % 2 = 0 then 'fp' else 'novel' end,
      '","matchedGtId":null,"agreement":"1/1","reasoning":"r"}')"""
    listed = f"case when o_orderkey % 4 = 0 then '' else array_join(transform(sequence(1, cast(o_orderkey % 4 as int)), i -> {entry}), ',') end"
    content = f"""concat('{{"runId":"r', o_orderkey, '","codebaseId":"cb","conditionId":"', o_orderpriority, '","gtHash":"ab","classifications":[',
      {listed}, case when o_orderkey % 19 = 0 then '' else ']}}' end)"""
    return t.orders.select(F.concat(F.lit("r"), key, F.lit(".classifications.json")).alias("file"), F.expr(content).alias("content"))


@register("a5_classification_headers", """
select 'r'||o_orderkey run_id, o_orderpriority condition_id, o_orderkey%4 label_count from orders where o_orderkey%19<>0""")
def classification_headers(t):
    return files.parse_classification_headers(_label_files(t)).select("run_id", "condition_id", "label_count")


@register("a5_scan_classifications", """
select 'r'||o_orderkey run_id, g.i finding_index, 'F'||g.i title, case when g.i%2=0 then 'fp' else 'novel' end category
from orders join (values (1),(2),(3)) g(i) on g.i<=o_orderkey%4 where o_orderkey%19<>0""")
def scan_classifications(t):
    return files.parse_labels(_label_files(t)).select("run_id", "finding_index", "title", "category")


@register("a6_scan_clusters", """
select 'p'||p_partkey codebase_id, case when p_partkey%3=0 then 'new' else 'old' end cluster_id, p_name title, 'r'||p_size run_id from part""")
def scan_clusters(t):
    """Every part has an older cluster file, every third one also a current one."""
    body = """concat('{"clusters":[{"clusterId":"', kind, '","title":"', p_name, '","foundIn":[{"runId":"r', p_size,
      '","conditionId":"c","findingIndex":1,"findingTitle":"x"}],"conditionsCaught":["c"]}]}')"""
    old = t.part.withColumn("kind", F.lit("old")).withColumn("prefix", F.lit("novel-clusters-"))
    new = t.part.filter("p_partkey % 3 = 0").withColumn("kind", F.lit("new")).withColumn("prefix", F.lit("clusters-"))
    raw = old.unionByName(new).select(
        F.concat("prefix", F.lit("p"), "p_partkey", F.lit(".json")).alias("file"), F.expr(body).alias("content")
    )
    clusters = files.parse_clusters(raw).select("codebase_id", "cluster_id", "title")
    return clusters.join(
        files.parse_cluster_members(raw).select("codebase_id", "cluster_id", "run_id"), ["codebase_id", "cluster_id"]
    )


@register("a7_scan_validations", """
select 'p'||p_partkey codebase_id, p_brand cluster_id, case when p_size%2=0 then 'confirmed' else 'rejected' end verdict,
  case when p_size%3=0 then 'informational' end risk_category from part""")
def scan_validations(t):
    body = """concat('{"validations":[{"clusterId":"', p_brand, '","title":"', p_name, '","verdict":"',
      case when p_size % 2 = 0 then 'confirmed' else 'rejected' end, '","severity":"high"',
      case when p_size % 3 = 0 then ',"riskCategory":"informational"' else '' end, '}]}')"""
    raw = t.part.select(F.concat(F.lit("validations-p"), "p_partkey", F.lit(".json")).alias("file"), F.expr(body).alias("content"))
    return files.parse_validations(raw).select("codebase_id", "cluster_id", "verdict", "risk_category")


@register("a8_scan_dims", """
select 'v2.seg-'||lower(c_mktsegment)||'_x(b'||c_custkey||')' condition_id, 0 as position,
  'V2.Seg '||upper(left(c_mktsegment,1))||lower(substr(c_mktsegment,2))||' X(B'||c_custkey||')' as label,
  'v2.seg-'||lower(c_mktsegment)||'_x(b'||c_custkey||') skill' subtitle from customer
union all select 'plain_'||c_custkey, 1, 'Bare CC', 'No skill, audit prompt only' from customer""")
def scan_dims(t):
    body = """concat('{"conditions":[{"id":"v2.seg-', lower(c_mktsegment), '_x(b', c_custkey, ')","type":"skill"},{"id":"plain_', c_custkey,
      '","type":"bare"}]}')"""
    raw = t.customer.select(F.lit("bench.json").alias("file"), F.expr(body).alias("content"))
    return files.parse_conditions(raw).select("condition_id", "position", "label", "subtitle")


@register("a9_scan_scope", """
select 'cb'||(p_partkey%5) codebase_id, 'contracts/'||p_partkey||'.sol' path, p_partkey%2=0 in_scope from part
union all select 'cb'||(p_partkey%5), 'lib/'||p_name, p_partkey%2=0 from part""")
def scan_scope(t):
    raw = t.part.select(
        F.concat(F.lit("file:/data/cb"), F.col("p_partkey") % 5, F.lit("/list")).alias("path"),
        F.when(F.col("p_partkey") % 2 == 0, "scope.txt").otherwise("out_of_scope.txt").alias("file"),
        F.concat(F.lit("  ./contracts/"), "p_partkey", F.lit(".sol\t\n\n  lib/"), "p_name", F.lit(" \n")).alias("content"),
    )
    return files.parse_scope(raw)


@register("a10_scan_source_files", """
select 'cb'||(p_partkey%5) codebase_id, ['src','src/core','x/y'][1+p_partkey%7]||'/P'||p_partkey||'.sol' path, p_name "content"
from part where p_partkey%7<3 and p_size%2=0""")
def scan_source_files(t):
    folder = F.expr("element_at(array('src','src/core','x/y','test','src/tests','.git','a/node_modules/b'), cast(1 + p_partkey % 7 as int))")
    name = F.concat(F.lit("P"), "p_partkey", F.when(F.col("p_size") % 2 == 0, ".sol").otherwise(".md"))
    raw = t.part.select(
        F.concat(F.lit("file:/data/sets/cb"), F.col("p_partkey") % 5, F.lit("/"), folder, F.lit("/"), name).alias("path"),
        name.alias("file"),
        F.col("p_name").alias("content"),
    )
    return files.parse_source_files(raw, "/data/sets")


@register("a11_scan_eval_gt", """
select s_name codebase_id, 'H-'||s_suppkey gt_id, 2 gt_pos, 'High' severity, 'C'||s_nationkey contract, 'why '||s_suppkey description
from supplier""")
def scan_eval_gt(t):
    content = F.concat(
        F.lit("## Findings\n\nFINDING | id: H-"), "s_suppkey", F.lit(" | severity: High | contract: C"), "s_nationkey",
        F.lit(" | function: f | bug_class: b\ndescription: why "), "s_suppkey", F.lit("\n"),
    )
    raw = t.supplier.select(F.concat("s_name", F.lit(".md")).alias("file"), content.alias("content"))
    return files.parse_eval_ground_truth(raw).select("codebase_id", "gt_id", "gt_pos", "severity", "contract", "description")


# The report's tables, each with the query whose DuckDB counterpart states its rows.
REPORT_TABLES = {
    "header": "e20_report_header",
    "runs": "e5_run_metrics",
    "matches": "e5_run_matches",
    "conditions": "e6_condition_agg",
    "condition_order": "e4_condition_order",
    "cross_codebase": "e15_cross_codebase",
    "metric_bests": "e16_metric_bests",
    "missed_gt": "e9_missed_gt",
    "missed_totals": "e9_missed_totals",
    "risk_excluded": "e18_risk_excluded",
    "reliability": "e10_gt_reliability",
    "integrity": None,  # no violation in the stand-in
    "ledger": "f5_ledger",
    "matrix": "f6_findings_matrix",
    "comparison": "f7_comparison_table",
    "recall_chart": "f9_recall_chart",
    "breakdown": "f10_breakdown_rows",
    "validations": "f11_validation_rows",
    "overview": "f12_run_overview",
    "analysis_feed": "f13_analysis_feed",
    "dashboard": "f14_dashboard_rows",
}


def report_counts_sql(oracles: dict[str, str]) -> str:
    """The row count of every report table, from the finished statements of the queries named above."""
    parts = [
        f"select '{name}' table_name, count(*) row_count from ({oracles[query]})" if query else f"select '{name}', 0"
        for name, query in REPORT_TABLES.items()
    ]
    return "\nunion all ".join(parts)


def _stand_in(t, own, runs, changed):
    """The stand-in results and judges of a refresh; ``changed`` names runs whose text differs from the usual one."""
    text = F.concat(F.lit("text of "), F.col("run_id").cast("string"), F.when(changed, " before").otherwise(""))
    hashes = runs.select("run_id", "codebase_id", F.lit("gt").alias("gt_hash"), refresh.content_hash(text).alias("stdout_hash"))
    part = F.regexp_extract("title", "([0-9]+)$", 1).cast("long")

    def cluster(inputs):
        named = inputs.withColumns({"part_id": part, "category": F.lit("novel")})
        return s.clusters(t, named), s.members(t, named)

    judges = refresh_plan.Judges(
        classify=lambda findings, gt: s.labels(t, own.table(findings.select("run_id").distinct())),
        cluster=cluster,
        validate=lambda clusters, members: s.verdicts_of(clusters),
        prompt_hash="p", cluster_model="m", validator_model="m",
        inputs=lambda own, findings, own_runs, gt: clustering.collect_novel(own),
    )
    return refresh_plan.Current(runs, s.findings(t), s.ground_truth(t), s.conditions(t), hashes), judges


@register("i_refresh_tables", named("""
oldest as (select n_regionkey codebase_id from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
  qualify o_orderkey=min(o_orderkey) over ())""", f"""
select c.codebase_id, condition_id, valid_runs, total_runs, gt_total, total_fp, total_findings, {sixes(*CONDITION_ROUNDED)},
  {six('avg_duration_ms', 3)} avg_duration_ms, c.codebase_id=o.codebase_id rewritten, 1 runs_judged, 1 codebases_touched
from e_condition_agg c, oldest o"""))
def refresh_tables(t):
    """The conditions of a feed that was written when one run had another text, and then brought up to date."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/refreshed-{uuid.uuid4().hex}"
    oldest = t.orders.agg(F.min("o_orderkey")).first()[0]
    with Scratch(t.spark) as own:
        runs = own.table(metrics.invalid_runs(s.runs_counted(t)))
        for changed in (F.col("run_id") == oldest, F.lit(False)):
            current, judges = _stand_in(t, own, runs, changed)
            done = refresh_plan.refresh(t.spark, folder, current, judges, tables=("conditions",))
    written = feed.read_log(t.spark, folder).filter(f"version = {done.version} and `table` = 'conditions' and kind = 'rows'")
    rows = feed.read_report_table(t.spark, folder, "conditions").withColumn("part", feed.part_of(F.col("codebase_id")))
    flagged = rows.join(written.select("part", F.lit(True).alias("rewritten")), "part", "left").na.fill(False, ["rewritten"])
    shown = flagged.select(
        "codebase_id", "condition_id", "valid_runs", "total_runs", "gt_total", "total_fp", "total_findings", *CONDITION_ROUNDED,
        "avg_duration_ms", "rewritten", F.lit(done.runs_judged).alias("runs_judged"),
        F.lit(done.codebases_touched).alias("codebases_touched"),
    )
    return rounded(rounded(shown, *CONDITION_ROUNDED), "avg_duration_ms", digits=3)


@register("a14_write_report_tables", "")
def write_report_tables(t):
    """All report tables of the stand-in results, written to the shared folder, read back and counted."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4().hex}"
    labels = materialised(s.labels(t))
    members = materialised(s.members(t, labels))
    results = report.Results(
        runs=materialised(metrics.invalid_runs(s.runs_counted(t))),
        labels=labels,
        gt=s.ground_truth(t),
        clusters=s.clusters(t, labels),
        members=members,
        cluster_conditions=members.select("codebase_id", "cluster_id", "condition_id").distinct(),
        verdicts=s.verdicts(t, labels),
        conditions=s.conditions(t),
    )
    tables = report.report_tables(results)
    feed.write_report_tables(tables, folder)
    counts = [
        feed.read_report_table(t.spark, folder, name, table.schema).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("row_count")
        )
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@register("a15_build_manifest", """
select 'codebase' "section", codebase_id::varchar "key", null::varchar "value" from (select distinct codebase_id from s_runs)
union all select 'condition', condition_id, null from (select distinct condition_id from s_runs)
union all select 'runs', 'total', (count(*))::varchar from s_runs
union all select 'runs_per_codebase', case when run_id%29=0 then 'unknown' else codebase_id::varchar end, (count(*))::varchar from s_runs group by 2
union all select 'ground_truth', s_suppkey::varchar, substr(sha256(s_name),1,16) from supplier
union all select 'prompt', n_name, substr(sha256(n_name||'!'),1,16) from nation
union all select 'file', 'r'||run_id||'.meta.json', null from s_runs
union all select 'pipeline', r_name, (r_regionkey%2=0)::varchar from region
union all select 'skill_version', n_name, n_regionkey::varchar from nation
union all select 'config', c_mktsegment||c_custkey, '{"runs":'||c_custkey||'}' from customer""")
def build_manifest(t):
    metas = s.runs(t).select(
        F.when(F.col("run_id") % 29 != 0, F.col("codebase_id")).alias("codebase_id"), "condition_id"
    )
    truth = t.supplier.select(F.col("s_suppkey").alias("codebase_id"), F.col("s_name").alias("content"))
    prompts = t.nation.select(F.col("n_name").alias("name"), F.concat("n_name", F.lit("!")).alias("content"))
    names = s.runs(t).select(F.concat(F.lit("r"), "run_id", F.lit(".meta.json")).alias("file"))
    state = t.region.select(F.col("r_name").alias("key"), (F.col("r_regionkey") % 2 == 0).alias("value"))
    skills = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("version"))
    config = t.customer.select(
        F.concat("c_mktsegment", "c_custkey").alias("file"), F.format_string('{"runs":%d}', "c_custkey").alias("content")
    )
    return feed.build_manifest(metas, truth, prompts, names, state, skills, config)


# --- I: staleness and fitness ------------------------------------------------------------------------------------

@register("i1_content_hash", "select doc_id, substr(sha256(text),1,16) digest from documents")
def content_hash(t):
    return t.documents.select("doc_id", refresh.content_hash(F.col("text")).alias("digest"))


@register("i2_stale_classifications", """
select run_id from s_runs where run_id%5=0 or run_id%7=0 or run_id%11=0""")
def stale_classifications(t):
    """Texts of every fifth run changed, every seventh has no labels, every eleventh label file has no prompt hash."""
    key = F.col("run_id")
    current = s.runs(t).select(
        "run_id",
        refresh.content_hash(F.col("codebase_id").cast("string")).alias("gt_hash"),
        refresh.content_hash(key.cast("string")).alias("stdout_hash"),
        F.lit("p1").alias("prompt_hash"),
    )
    existing = current.filter(key % 7 != 0).withColumns(
        {
            "stdout_hash": F.when(key % 5 == 0, "old").otherwise(F.col("stdout_hash")),
            "prompt_hash": F.when(key % 11 != 0, F.col("prompt_hash")),
        }
    )
    return refresh.stale_classifications(current, existing)


def _rows_hash_sql(row: str) -> str:
    pieces = ", ".join(f"sum(('0x'||substr(sha256({row}),{start},12))::bigint)::varchar" for start in (1, 13, 25, 37))
    return f"substr(sha256(concat_ws(':', count(*)::varchar, {pieces})),1,16)"


LOOSE = "s_labels where category in ('novel','uncertain')"
INPUT_ROW = """'{"run_id":'||run_id||',"condition_id":"'||condition_id||'","finding_index":'||finding_index||',"title":"'||title||'","reasoning":"'||reasoning||'"}'"""


def _input_hashes(t, damaged=False):
    inputs = s.labels(t).filter(F.col("category").isin("novel", "uncertain"))
    if damaged:
        inputs = inputs.filter("codebase_id % 2 = 1 or part_id % 100 <> 0")
    return refresh.cluster_input_hash(inputs, "model-a")


@register("i3_cluster_input_hash", f"""
select codebase_id, substr(sha256(h||'model-a'||'false'),1,16) input_hash
from (select codebase_id, {_rows_hash_sql(INPUT_ROW)} h from {LOOSE} group by 1)""")
def cluster_input_hash(t):
    return _input_hashes(t)


@register("i3_stale_clusters", f"""
select distinct codebase_id from {LOOSE} and codebase_id%2=0 and part_id%100=0""")
def stale_clusters(t):
    """Clusters of even codebases were built without the findings on some parts."""
    existing = _input_hashes(t, damaged=True).withColumn("cluster_model", F.lit("model-a"))
    return refresh.stale_clusters(_input_hashes(t), existing, "model-a")


CLUSTER_ROW = """'{"cluster_id":"'||cluster_id||'","title":"'||title||'"}'"""
MEMBER_ROW = """'{"cluster_id":"'||cluster_id||'","member":"'||run_id||'::'||finding_index||'"}'"""


@register("i4_cluster_content_hash", f"""
select codebase_id, substr(sha256(h||'model-b'),1,16) cluster_hash from (
  select codebase_id, {_rows_hash_sql('r')} h from (
    select codebase_id, {CLUSTER_ROW} r from s_clusters union all select codebase_id, {MEMBER_ROW} from s_members) group by 1)""")
def cluster_content_hash(t):
    return refresh.cluster_content_hash(s.clusters(t), s.members(t), "model-b")


@register("i4_stale_validations", "select distinct codebase_id from s_clusters where codebase_id in (1,3)")
def stale_validations(t):
    """Validations of codebase 1 are missing and those of codebase 3 come from another model."""
    hashes = refresh.cluster_content_hash(s.clusters(t), s.members(t), "model-b")
    existing = hashes.filter("codebase_id <> 1").withColumn(
        "validator_model", F.when(F.col("codebase_id") == 3, "model-c").otherwise("model-b")
    )
    return refresh.stale_validations(hashes, existing, "model-b")


@register("i5_preflight", named(METAS, """
select file, reason from (
select 'r'||run_id||'.meta.json' file, case when not valid_json then 'invalid JSON'
  when cb is null then 'missing required fields (runId, codebaseId, or conditionId)' end reason from metas
union all select rid||'.stdout.txt', case when run_id%31=0 then 'missing (meta says exit 0 but no stdout file)'
  when run_id%37=0 then 'empty file (0 bytes)' end from metas where valid_json and cb is not null and exit_code in (0,143)
union all select 'ground_truth/'||s_name||'.json', case when s_suppkey%6=0 then 'invalid JSON'
  when s_suppkey%5=0 then 'missing or invalid "findings" array' end from supplier) where reason is not null"""))
def preflight(t):
    metas = files.check_run_meta(_meta_files(t))
    key = F.col("run_id")
    texts = s.runs(t).filter(key % 31 != 0).select(
        F.concat_ws("_", F.lit("r"), "codebase_id", "condition_id", "run_id").alias("run_id"),
        F.when(key % 37 == 0, 0).otherwise(100).alias("chars"),
    )
    supplier = F.col("s_suppkey")
    truth = t.supplier.select(
        F.concat("s_name", F.lit(".json")).alias("file"),
        F.when(supplier % 6 == 0, "[").when(supplier % 5 == 0, '{"findings":"none"}').otherwise('{"findings":[]}').alias("content"),
    )
    return refresh.preflight(metas, texts, files.check_ground_truth(truth))


@register("i6_provenance_check", named(METAS, """
select run_id, rule as "rule" from (
  select rid run_id, unnest(['identity','mode','timing','skill_version','commit','run_id_codebase','text_exists']) rule,
    unnest([cb is not null, md in ('bare','skill'), stamp<>'yesterday', md<>'skill' or run_id%2=0,
      not (run_id%3=0 and run_id%47=0), cb is not null, exit_code<>0 or run_id%31<>0]) ok
  from metas where valid_json) where not ok
union all select 'r'||o_orderkey, 'label_keys' from orders where o_orderkey%9=0
union all select 'r'||o_orderkey, 'prompt_hash' from orders where o_orderkey%14=0"""))
def provenance_check(t):
    metas = files.parse_run_meta(_meta_files(t))
    texts = s.runs(t).filter("run_id % 31 <> 0").select(
        F.concat_ws("_", F.lit("r"), "codebase_id", "condition_id", "run_id").alias("run_id")
    )
    key = F.col("o_orderkey")
    label_files = t.orders.select(
        F.concat(F.lit("r"), key).alias("run_id"),
        F.when(key % 9 != 0, "ab12").alias("gt_hash"),
        F.lit("cd34").alias("stdout_hash"),
        F.lit("model-a").alias("classifier_model"),
        F.lit("2026-01-01").alias("classified_at"),
        F.when(key % 14 == 0, "NOT HEX").when(key % 2 == 0, "ef56").alias("prompt_hash"),
    )
    return refresh.provenance_check(metas, texts, label_files)
