"""Registered queries for the report relations (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.evaluation import (
    BESTS,
    Shared,
    condition_table,
    run_table,
    shared_labels,
)
from gaugeline.catalog.oracle_views import six
from gaugeline.catalog.registry import Registry, named, rounded
from gaugeline.operators import ledger, metrics
from gaugeline.plans import standins as s
from gaugeline.session import cut_lineage, materialised

register = Registry()


def _numbers(t):
    return metrics.run_numbers(s.runs(t))


def _cells(name: str, hits: str, row: str) -> str:
    """Cell pages of 1000 run numbers per (codebase, row, condition) from a hits subquery."""
    keys = f"codebase_id, {row}, condition_id"
    return f"""
{name}_hits as ({hits}),
{name}_totals as (select {keys}, count(*)=any_value(v.valid_runs) full_row, min((run_number-1)//1000) first_page
  from {name}_hits h join s_valid_counts v using (codebase_id, condition_id) group by {keys}),
{name}_cells as (
  select {keys}, 0 as page, '✓' cell from {name}_totals where full_row
  union all select {keys}, (run_number-1)//1000, case when (run_number-1)//1000=first_page then '✓' else '' end||
    string_agg('#'||run_number, '' order by run_number)
  from {name}_hits join {name}_totals using ({keys}) where not full_row
  group by {keys}, first_page, (run_number-1)//1000)"""


def _rows(name: str, listed: str, row: str) -> str:
    return f"""
{name}_rows as (select codebase_id, row_id, title, c.condition_id, coalesce(x.page,0) as page, coalesce(cell,'-') cell, status, sort_key
  from ({listed}) k join conds c using (codebase_id)
  left join {name}_cells x using (codebase_id, {row}, condition_id))"""


def _cut(title: str) -> str:
    return f"case when length({title})>50 then substr({title},1,47)||'...' else {title} end"


LEDGER = ",".join([
    "conds as (select distinct codebase_id, condition_id from s_runs)",
    _cells("gt", "select f.codebase_id, f.gt_id, f.condition_id, run_number from e_found f join s_numbers n on n.run_id=f.run_id", "gt_id"),
    _rows("gt", f"select codebase_id, gt_id, gt_id::varchar row_id, {_cut('title')} title, gt_id::varchar status, 0 sort_key from s_gt", "gt_id"),
    _cells("novel", """select distinct m.codebase_id, m.cluster_id, m.condition_id, n.run_number
      from s_members m join s_numbers n on n.run_id=m.run_id""", "cluster_id"),
    _rows("novel", f"""select codebase_id, cluster_id, cluster_id row_id, {_cut('title')} title,
      case when verdict is null then 'unvalidated' when verdict='rejected' then '~~rejected~~' else verdict end status,
      case verdict when 'confirmed' then 1 when 'plausible' then 2 when 'rejected' then 5 else 3 end sort_key
      from s_clusters left join (select codebase_id, cluster_id, arg_max(verdict,pos) verdict from s_verdicts group by 1,2)
      using (codebase_id, cluster_id)""", "cluster_id"),
    _cells("fp", """select l.codebase_id, l.title, l.condition_id, n.run_number from s_labels l join s_numbers n on n.run_id=l.run_id
      where category='fp' and l.is_valid""", "title"),
    _rows("fp", "select distinct codebase_id, title, title row_id, 'FP' status, 4 sort_key from fp_hits", "title"),
])

SHOWN = "codebase_id, row_id, title, condition_id, page, cell, status, sort_key"
SHOWN_COLUMNS = SHOWN.split(", ")


@register("f1_condition_cell", """
select r.run_id, case when f=0 then '-' when f=n then '✓' else '✓'||array_to_string(list_transform(range(1,f+1), lambda x: '#'||x),'') end cell
from (select run_id, run_id%9 f, greatest(findings_count,1)%9 n from s_runs_counted) r""")
def condition_cell(t):
    """The cell of run_id % 9 hits out of findings_count % 9 runs, for every run."""
    runs = s.runs_counted(t)
    size = (F.col("run_id") % 9).cast("int")
    numbers = F.when(size > 0, F.reverse(F.sequence(F.lit(1), size))).otherwise(F.array().cast("array<int>"))
    total = F.greatest("findings_count", F.lit(1)) % 9
    return runs.select("run_id", ledger.condition_cell(numbers, total).alias("cell"))


def _gt_rows(t, labels, numbers):
    return ledger.ledger_gt(s.ground_truth(t), s.runs(t), labels, numbers)


def _novel_rows(t, labels, numbers):
    return ledger.ledger_novel(s.clusters(t, labels), s.members(t, labels), s.verdicts(t, labels), s.runs(t), numbers)


def _fp_rows(t, labels, numbers):
    return ledger.ledger_fp(s.runs(t), labels, numbers)


@register("f2_ledger_gt", named(LEDGER, f"select {SHOWN} from gt_rows"))
def ledger_gt(t):
    return _gt_rows(t, s.labels(t), _numbers(t)).select(*SHOWN_COLUMNS)


@register("f3_ledger_novel", named(LEDGER, f"select {SHOWN} from novel_rows"))
def ledger_novel(t):
    return _novel_rows(t, shared_labels(t), _numbers(t)).select(*SHOWN_COLUMNS)


@register("f4_ledger_fp", named(LEDGER, f"select {SHOWN} from fp_rows"))
def ledger_fp(t):
    return _fp_rows(t, s.labels(t), _numbers(t)).select(*SHOWN_COLUMNS)


@register("f5_ledger", named(LEDGER, f"""
select {SHOWN} from gt_rows union all select {SHOWN} from novel_rows union all select {SHOWN} from fp_rows"""))
def whole_ledger(t):
    labels = materialised(s.labels(t).drop("reasoning", "agreement", "agreement_count", "position", "is_valid"))
    numbers = materialised(_numbers(t).select("run_id", "run_number"))
    rows = ledger.ledger(_gt_rows(t, labels, numbers), _novel_rows(t, labels, numbers), _fp_rows(t, labels, numbers))
    return rows.select(*SHOWN_COLUMNS)


@register("f6_findings_matrix", """
select codebase_id, run_id, null::bigint gt_id, null title, case when not is_valid then 'X' else '?' end cell
from s_runs where codebase_id<>4 and codebase_id in (select codebase_id from s_gt) and (not is_valid or not is_classified)
union all select l.codebase_id, l.run_id, g.gt_id, case when length(any_value(g.title))>45 then substr(any_value(g.title),1,42)||'...' else any_value(g.title) end,
  arg_min(l.agreement, l.finding_index)
from s_labels l join s_gt g on g.codebase_id=l.codebase_id and g.gt_id=l.matched_gt_id where l.is_valid group by 1,2,3""")
def findings_matrix(t):
    return ledger.findings_matrix(s.ground_truth(t), s.runs(t), s.labels(t))


COMPARISON = """
excluded as (select codebase_id, bool_or(confirmed_novels<>confirmed_novels_filtered) d from e_table group by 1),
listed as (select e.*, x.d, gt_total is not null g, codebase_id in (select codebase_id from s_verdicts) v,
  codebase_id in (select codebase_id from s_clusters) c from e_table e join excluded x using (codebase_id)),
compared as (
  select codebase_id, condition_id, 'recall' metric, avg_recall val from listed where g
  union all select codebase_id, condition_id, 'recall_matched', avg_matched from listed where g
  union all select codebase_id, condition_id, 'consistency', consistency from listed where g
  union all select codebase_id, condition_id, 'novel_confirmed', confirmed_novels_filtered from listed where v
  union all select codebase_id, condition_id, 'novel_excluded', confirmed_novels-confirmed_novels_filtered from listed where v and d
  union all select codebase_id, condition_id, 'novel_conditional', plausible_novels_filtered from listed where v
  union all select codebase_id, condition_id, 'total_findings', avg_findings_count from listed
  union all select codebase_id, condition_id, 'unique_bugs', unique_bugs_found from listed where c
  union all select codebase_id, condition_id, 'false_positives', floor(avg_fp+0.5) from listed where g
  union all select codebase_id, condition_id, 'uncertain', floor(avg_uncertain+0.5) from listed where g
  union all select codebase_id, condition_id, 'avg_cost', avg_cost from listed
  union all select codebase_id, condition_id, 'avg_duration_ms', avg_duration_ms from listed)"""


@register("f7_comparison_table", named(COMPARISON, f"""
select codebase_id, condition_id, metric, {six('val', 3)} "value" from compared"""))
def comparison_table(t):
    shared = Shared(t)
    labels = shared.labels
    table = ledger.comparison_table(condition_table(t, shared), s.clusters(t, labels), s.verdicts(t, labels))
    return rounded(table, "value", digits=3)


@register("f8_missed_table", """
select codebase_id, gt_id, case when length(title)>60 then substr(title,1,57)||'...' else title end title
from (select codebase_id, gt_id, repeat(title, 2) title from e_missed)""")
def missed_table(t):
    """Missed items with titles long enough to be cut."""
    truth = s.ground_truth(t).withColumn("title", F.repeat("title", F.lit(2)))
    return ledger.missed_table(metrics.missed_gt(truth, s.runs(t), s.labels(t)))


@register("f9_recall_chart", """
select codebase_id, run_id, case when not is_valid then 'INVALID' when matched is null then 'not classified' else 'ok' end state,
  case when is_valid and matched is not null then matched_ids end found, gt_total,
  case when is_valid and matched is not null then cast(floor(matched_ids::double/gt_total*100.0+0.5) as int) end percent
from e_runs where gt_total is not null""")
def recall_chart(t):
    return ledger.recall_chart(run_table(t))


@register("f10_breakdown_rows", """
select codebase_id, run_id, category, n as "count" from (
  select codebase_id, run_id, unnest(['matched','novel','fp','uncertain']) category, unnest([matched,novel,fp,uncertain]) n
  from e_runs where gt_total is not null and is_valid and matched is not null) where category<>'uncertain' or n>0
union all select codebase_id, run_id, case when not is_valid then 'INVALID' else 'not classified' end, null
from e_runs where gt_total is not null and (not is_valid or matched is null)""")
def breakdown_rows(t):
    return ledger.breakdown_rows(run_table(t))


@register("f11_validation_rows", """
select codebase_id, cluster_id, pos, substr(title,1,45) title, verdict, severity, substr(coalesce(code_evidence,'-'),1,60) evidence
from s_verdicts""")
def validation_rows(t):
    return ledger.validation_rows(s.verdicts(t))


@register("f12_run_overview", """
select r.codebase_id, r.run_id, r.condition_id, n.run_number, r.condition_id||' #'||n.run_number run_label, findings_count, duration_ms, cost_usd,
  case when r.mode='skill' and findings_count<1 then 'INVALID: skill run produced 0 findings (expected ≥1)'
    when r.mode='skill' and text_chars<500 then 'INVALID: stdout only '||text_chars||' chars (expected ≥500 for skill run)'
    when timed_out then 'timeout' end status
from s_runs_counted r join s_numbers n on n.run_id=r.run_id""")
def run_overview(t):
    return ledger.run_overview(metrics.invalid_runs(s.runs_counted(t)), _numbers(t))


@register("f13_analysis_feed", """
select b.codebase_id, 'codebase' kind, b.codebase_id::varchar "key", null::double recall, null::double precision_value, null::double cost_usd, '{"gt_count":'||coalesce(gt_total,0)||',"novel_clusters":'||coalesce(k,0)||
  coalesce(',"confirmed":'||c||',"plausible":'||p||',"rejected":'||x,'')||'}' feed
from (select distinct codebase_id from s_runs) b left join s_gt_total using (codebase_id)
left join (select codebase_id, count(*) k from s_clusters group by 1) using (codebase_id)
left join (select codebase_id, count(*) filter (verdict='confirmed') c, count(*) filter (verdict='plausible') p,
  count(*) filter (verdict='rejected') x from s_verdicts group by 1) using (codebase_id)
union all select codebase_id, 'missed', gt_id::varchar, null, null, null, '{"gt_id":'||gt_id||'}' from e_missed
union all select codebase_id, 'run', run_id::varchar, SIX_RECALL, SIX_PREC, SIX_COST, '{"condition_id":"'||condition_id||'"'||coalesce(',"matched":'||matched||',"novel":'||novel||',"fp":'||fp||
  ',"uncertain":'||uncertain,'')||',"duration_ms":'||duration_ms||',"findings_count":'||findings_count||'}' from e_run_metrics where is_valid""".replace("SIX_RECALL", six("recall")).replace("SIX_PREC", six("prec")).replace("SIX_COST", six("cost_usd")))
def analysis_feed(t):
    """Ratios and costs are compared as numbers beside the rest of the JSON, because engines write doubles differently."""
    shared = Shared(t)
    labels, truth = shared.labels, shared.gt
    runs = cut_lineage(metrics.run_metrics(shared.runs, labels, truth))
    missed = metrics.missed_gt(truth, shared.runs, labels)
    feed = ledger.analysis_feed(runs, missed, s.clusters(t, labels), s.verdicts(t, labels), truth)
    plain = F.regexp_replace("json", '"(recall|precision|cost_usd)":[^,}]*,', "")
    numbers = {"recall": "recall", "precision": "precision_value", "cost_usd": "cost_usd"}
    parsed = [F.get_json_object("json", f"$.{name}").cast("double").alias(alias) for name, alias in numbers.items()]
    return rounded(feed.select("codebase_id", "kind", "key", *parsed, plain.alias("feed")), *numbers.values())


@register("f14_dashboard_rows", named(BESTS + """,
dash as (select condition_id, valid_runs, unnest([0,1,2,3,4,5,6]) as pos,
  unnest(['GT Recall','Confirmed Novel Findings','Conditional Novel Findings','False Positive Rate','Consistency','Avg Cost / Run','Avg Duration']) as label,
  unnest(['recall','confirmedNovelsFiltered','confirmedNovelsFiltered','fpRate','consistency','avgCost','avgDuration']) metric,
  unnest([avg_recall, confirmed_novels_filtered::double, plausible_novels_filtered::double, fp_rate,
    case when valid_runs>=2 then consistency end, avg_cost, avg_duration_ms]) val from e_cross)""", f"""
select pos "position", label "row", d.condition_id, {six('val', 3)} "value", b.metric is not null and val is not null is_best, val is null is_missing
from dash d left join bests b on b.metric=d.metric and b.condition_id=d.condition_id"""))
def dashboard_rows(t):
    cross = cut_lineage(metrics.cross_codebase(condition_table(t)))
    return rounded(ledger.dashboard_rows(cross, metrics.metric_bests(cross)), "value", digits=3)
