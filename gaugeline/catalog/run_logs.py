"""Registered queries for event logs (A12, A13, K) and source scoping (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.registry import Registry, named
from gaugeline.operators import leaks, logs, scope
from gaugeline.plans import standins as s
from gaugeline.session import cut_lineage

register = Registry()


def _events(t):
    return logs.parse_events(s.log_lines(t))


def _blocks(t):
    return logs.content_blocks(_events(t))


def _facts(t):
    """Facts with the scope checks; a run's text is the report of its number."""
    events, runs, listed = _events(t), s.logged_runs(t), s.scope_lists(t)
    blocks = logs.checked_blocks(events)
    compliance = scope.scope_compliance(scope.files_read(blocks, runs), runs, listed)
    mentions = scope.oos_mentions(s.reports(t), runs, scope.oos_names(listed))
    return logs.run_facts(runs, events, s.output_lines(t), compliance, mentions, blocks)


@register("a3_scan_events", "select run_id, seq, kind from k_events")
def scan_events(t):
    names = {"system": "signup", "assistant": "click", "user": "view", "result": "purchase", "rate_limit_event": "error"}
    kinds = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return _events(t).select("run_id", "seq", F.element_at(kinds, F.col("type")).alias("kind"))


@register("a12_run_cost", """
select run_id, (arg_min(seq, seq) filter (kind='purchase'))%400+0.25 cost_usd from k_events group by 1""")
def run_cost(t):
    return logs.run_cost(_events(t))


@register("a13_run_model", """
select run_id, 'model-'||((min(seq) filter (kind='click'))%3) model from k_events group by 1""")
def run_model(t):
    return logs.run_model(_events(t))


@register("k1_agent_spans", "select * from k_spans")
def agent_spans(t):
    return logs.agent_spans(_blocks(t), stretch=1000)


@register("k2_tool_errors", "select run_id, seq, tool, error from k_errors")
def tool_errors(t):
    return logs.tool_errors(_blocks(t)).select("run_id", "seq", "tool", "error")


@register("k2_tool_error_counts", "select run_id, tool, count(*) errors from k_errors group by 1,2")
def tool_error_counts(t):
    return logs.tool_error_counts(logs.tool_errors(_blocks(t)))


@register("k3_bundle_quality", "select * from k_bundles")
def bundle_quality(t):
    return logs.bundle_quality(_blocks(t))


@register("k4_session_inits", "select run_id, count(*) filter (kind='signup') inits from k_events group by 1")
def session_inits(t):
    return logs.session_inits(_events(t))


def _checks(t, *names):
    return logs.check_rows(_facts(t)).filter(F.col("check").isin(*names))


def _checks_sql(*names):
    return f"""select run_id, "check", ok, detail from k_checks where applies and "check" in ({', '.join(f"'{n}'" for n in names)})"""


@register("k5_check_exit_timeout", _checks_sql("exit_code", "not_timed_out"))
def check_exit_timeout(t):
    return _checks(t, "exit_code", "not_timed_out")


@register("k6_check_events_result", _checks_sql("has_events", "has_result", "stop_reason"))
def check_events_result(t):
    return _checks(t, "has_events", "has_result", "stop_reason")


AGENT_CHECKS = ("agents_spawned", "agents_all_returned", "agents_no_errors", "agents_result_quality", "bundle_quality")


@register("k7_check_agents", _checks_sql(*AGENT_CHECKS))
def check_agents(t):
    return _checks(t, *AGENT_CHECKS)


@register("k8_check_bare_clean", _checks_sql("no_skill_calls", "bare_no_skill_visible"))
def check_bare_clean(t):
    return _checks(t, "no_skill_calls", "bare_no_skill_visible")


@register("k9_check_output", _checks_sql("has_output"))
def check_output(t):
    return _checks(t, "has_output")


SCOPE_CHECKS = ("scope_no_oos_findings", "scope_in_scope_read")


@register("k10_scope_checks", _checks_sql(*SCOPE_CHECKS))
def check_scope(t):
    return _checks(t, *SCOPE_CHECKS)


@register("k10_verify_runs", """
select run_id, bool_and(ok) passed, count(*) checks, count(*) filter (not ok) failed from k_checks where applies group by 1""")
def verify_runs(t):
    return logs.verify_runs(logs.check_rows(_facts(t)))


@register("k10_suite_summary", """
select count(*) runs, count(*) filter (p) passed, count(*) filter (not p) failed
from (select run_id, bool_and(ok) p from k_checks where applies group by 1)""")
def suite_summary(t):
    return logs.suite_summary(logs.verify_runs(logs.check_rows(_facts(t))))


@register("k10_warnings", """
select run_id, 'tool_errors' warning, tool_errors amount from k_facts where tool_errors>0
union all select run_id, 'bundle_retry', was from k_facts where mode='skill' and was>0 and empty_now=0
union all select run_id, 'restarted_session', inits from k_facts where inits>1
union all select run_id, mode||'_read_out_of_scope', out_of_scope_read from k_facts where out_of_scope_read>0""")
def warnings(t):
    return logs.warning_rows(_facts(t))


@register("k11_oversize_results", """
select run_id, tool, sum(big)::bigint oversize, sum(f)::bigint full_reads from (
  select r.run_id, coalesce(n.tool,'unknown') tool, 1 big, 0 f from k_results r left join k_names n using (run_id, tid)
  where shape in ('big','marker')
  union all select run_id, tool, 0, 1 from k_uses where tool='Read' and seq%8<>1) group by 1,2""")
def oversize_results(t):
    return logs.oversize_results(_blocks(t))


# --- J: scoping and contamination --------------------------------------------------------------------------------

SOURCES = """
files as (select p_partkey%5 codebase_id, 'src/'||p_brand||'/P'||p_partkey||'.sol' path, repeat('line ', p_size)||p_name content from part),
listed as (select distinct p_partkey%5 codebase_id, 'src/'||p_brand||'/P'||p_partkey||'.sol' path from part where p_partkey%5 in (0,1) and p_partkey%9=0),
chosen as (
  select c.codebase_id, c.cluster_id, 1 as level, f.path from s_clusters c join files f on f.codebase_id=c.codebase_id
    and f.path='src/'||c.cluster_id||'/P'||c.codebase_id||'.sol' where c.n%3=0),
picked as (
  select * from chosen union all
  select c.codebase_id, c.cluster_id, case when l.path is not null then 2 else 3 end, coalesce(l.path, f.path)
  from s_clusters c left join listed l on l.codebase_id=c.codebase_id
  left join files f on l.path is null and f.codebase_id=c.codebase_id
  where not exists (select 1 from chosen x where x.codebase_id=c.codebase_id and x.cluster_id=c.cluster_id))"""


def _scoped(t):
    """(levels, files, source files) of the stand-in clusters."""
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/P"), "p_partkey", F.lit(".sol"))
    files = t.part.select(
        (F.col("p_partkey") % 5).alias("codebase_id"),
        path.alias("path"),
        F.concat(F.expr("repeat('line ', p_size)"), "p_name").alias("content"),
        "p_partkey",
    )
    listed = files.filter("codebase_id in (0, 1) and p_partkey % 9 = 0").select(
        "codebase_id", "path", F.lit(True).alias("in_scope")
    )
    own = F.concat(F.lit("src/"), "cluster_id", F.lit("/P"), "codebase_id", F.lit(".sol"))
    clusters = s.clusters(t).select(
        "codebase_id",
        "cluster_id",
        F.when(F.col("n") % 3 == 0, F.array(own, F.lit("src/absent.sol"))).alias("relevant_files"),
    )
    files = files.drop("p_partkey")
    levels = cut_lineage(scope.scoped_levels(clusters, listed, files))
    return levels, scope.scoped_files(levels, clusters, listed, files), files


@register("j1_scope_levels", f"/*with*/{SOURCES}/*end*/select distinct codebase_id, cluster_id, level from picked")
def scope_levels(t):
    return _scoped(t)[0]


SHARED_FILES = """select distinct codebase_id, level, case when level=1 then cluster_id end cluster_id, path from picked"""


@register("j1_scoped_source", f"/*with*/{SOURCES}/*end*/{SHARED_FILES}")
def scoped_source(t):
    return _scoped(t)[1]


@register("j1_scoped_sections", f"""/*with*/{SOURCES}/*end*/
select p.codebase_id, p.level, p.cluster_id, p.path, '// ═══ '||p.path||' ═══'||chr(10)||chr(10)||f.content "section"
from ({SHARED_FILES}) p join files f on f.codebase_id=p.codebase_id and f.path=p.path""")
def scoped_sections(t):
    _, picked, files = _scoped(t)
    return scope.scoped_sections(picked, files)


@register("j1_scoped_sizes", f"""/*with*/{SOURCES}/*end*/
select p.codebase_id, cluster_id, level, count(*) files,
  (sum(length('// ═══ '||p.path||' ═══')+2+length(f.content))+2*(count(*)-1))::bigint chars,
  level=3 and sum(length('// ═══ '||p.path||' ═══')+2+length(f.content))+2*(count(*)-1)>200000 too_large
from picked p join files f on f.codebase_id=p.codebase_id and f.path=p.path group by 1,2,3""")
def scoped_sizes(t):
    return scope.scoped_sizes(*_scoped(t))


@register("j2_oos_names", "select * from k_oos_names")
def oos_names(t):
    return scope.oos_names(s.scope_lists(t))


@register("j3_oos_mentions", "select * from k_mentions")
def oos_mentions(t):
    return scope.oos_mentions(s.reports(t), s.report_runs(t), scope.oos_names(s.scope_lists(t)))


@register("j4_files_read", "select run_id, path from k_reads")
def files_read(t):
    return scope.files_read(_blocks(t), s.logged_runs(t))


@register("j5_scope_compliance", "select * from k_compliance")
def scope_compliance(t):
    reads = scope.files_read(_blocks(t), s.logged_runs(t))
    return scope.scope_compliance(reads, s.logged_runs(t), s.scope_lists(t))


PASSAGES = """
grams as (select doc_id run_id, w.i-1 "start", array_to_string(ws[w.i:w.i+12], ' ') seq
  from (select doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') ws
    from documents), unnest(range(1, len(ws)-11)) w(i)),
known as (select distinct item_id, array_to_string(ws[w.i:w.i+12], ' ') seq
  from (select item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') ws
    from benchmark), unnest(range(1, len(ws)-11)) w(i)),
hits as (select distinct run_id, item_id, "start" from grams join known using (seq)),
breaks as (select *, coalesce("start"-lag("start") over (partition by run_id, item_id order by "start")>13, true) fresh from hits),
spans as (select *, sum(fresh::int) over (partition by run_id, item_id order by "start") span from breaks)"""


@register("j6_passage_leak", named(PASSAGES, """
select run_id, item_id, min("start") "start", max("start")-min("start")+13 words from spans group by run_id, item_id, span"""))
def passage_leak(t):
    """Passages of the benchmark in the documents."""
    return leaks.passage_leak(t.documents.select(F.col("doc_id").alias("run_id"), "text"), t.benchmark)


@register("j6_canary_leak", """
select doc_id run_id, doc_id%4 codebase_id, 'cond'||((doc_id//4)%3) condition_id,
  'BENCHMARK_CANARY_COND'||((doc_id//4)%3)||'_k'||(doc_id%4)||'z' canary
from documents where doc_id%2=1 and doc_id%7=0 and doc_id%5<>0""")
def canary_leak(t):
    """Every seventh report quotes the control string of a condition of its codebase (every fifth one of another)."""
    canary = F.expr(
        "concat('BENCHMARK_CANARY_COND', (run_id div 4) % 3, '_k', "
        "case when run_id % 5 = 0 then (run_id + 1) % 4 else run_id % 4 end, 'z')"
    )
    texts = s.reports(t).select(
        "run_id",
        F.when(F.col("run_id") % 7 == 0, F.concat("text", F.lit("\n<!-- "), canary, F.lit(" -->"))).otherwise(
            F.col("text")
        ).alias("text"),
    )
    canaries = s.report_runs(t).select("codebase_id", "condition_id").distinct().select(
        "codebase_id",
        "condition_id",
        F.concat(F.lit("BENCHMARK_CANARY_"), F.upper("condition_id"), F.lit("_k"), "codebase_id", F.lit("z")).alias("canary"),
    )
    return scope.canary_leak(texts, s.report_runs(t), canaries)
