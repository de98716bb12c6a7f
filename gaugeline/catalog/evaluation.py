"""Registered queries for voting (D) and metrics (E), each with the DuckDB statement of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.catalog.oracle_views import six, sixes
from gaugeline.catalog.registry import Registry, named, rounded
from gaugeline.operators import consistency, metrics, voting
from gaugeline.plans import standins as s
from gaugeline.plans.standins import Tables
from gaugeline.session import cut_lineage, materialised

register = Registry()

UNIT = ["codebase_id", "unit_user", "unit_day"]


class Shared:
    """Runs and labels written once to the shared folder, for queries that need them several times."""

    def __init__(self, t: Tables):
        self.runs = materialised(s.runs_counted(t))
        self.labels = shared_labels(t)
        self.gt = s.ground_truth(t)


def shared_labels(t: Tables) -> DataFrame:
    return materialised(s.labels(t).drop("reasoning", "agreement"))


def run_table(t: Tables) -> DataFrame:
    return materialised(metrics.run_metrics(s.runs_counted(t), s.labels(t), s.ground_truth(t)))


def condition_parts(t: Tables, shared: Shared) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run metrics, consistency and novel counts from the same runs and labels."""
    return (
        materialised(metrics.run_metrics(shared.runs, shared.labels, shared.gt)),
        consistency.consistency_jaccard(shared.runs, shared.labels, shared.gt),
        metrics.novel_counts(s.members(t, shared.labels), s.verdicts(t, shared.labels)),
    )


def condition_table(t: Tables, shared: Shared | None = None) -> DataFrame:
    runs, agreement, novels = condition_parts(t, shared or Shared(t))
    return metrics.condition_table(metrics.condition_agg(runs), agreement, novels)


CROSS_ROUNDED = ["avg_recall", "fp_rate", "consistency", "avg_cost"]


def round_cross(frame: DataFrame) -> DataFrame:
    return rounded(rounded(frame, *CROSS_ROUNDED), "avg_duration_ms", digits=3)


CROSS_COLUMNS = (
    "condition_id, valid_runs, gt_total, confirmed_novels, confirmed_novels_filtered, plausible_novels_filtered, "
    + sixes(*CROSS_ROUNDED)
    + f", {six('avg_duration_ms', 3)} avg_duration_ms"
)


@register("condition_leaderboard", f"""
select c.condition_id, c.valid_runs, {sixes('avg_recall', 'fp_rate', 'consistency')},
  avg_recall is not null and avg_recall=max(avg_recall) over () is_best
from e_cross c""")
def condition_leaderboard(t):
    """The flagship: labels, run metrics, consistency and novel counts, pooled per condition, with the best recall."""
    cross = cut_lineage(metrics.cross_codebase(condition_table(t)))
    best = metrics.metric_bests(cross).filter("metric = 'recall'").select("condition_id", F.lit(True).alias("is_best"))
    flagged = cross.join(best, "condition_id", "left").na.fill(False, ["is_best"])
    return rounded(
        flagged.select("condition_id", "valid_runs", "avg_recall", "fp_rate", "consistency", "is_best"),
        "avg_recall", "fp_rate", "consistency",
    )


# --- D: votes and labels -----------------------------------------------------------------------------------------

VOTE_GT = """select distinct codebase_id, gt_id from s_gt"""


@register("d1_validate_vote_gt", """
select v.codebase_id, unit_user, unit_day, vote_no,
  case when v.matched_gt_id is not null and v.category is not null then
    case when g.gt_id is null then 'fp' else 'matched' end else category end category,
  case when v.category is not null and v.matched_gt_id is not null and g.gt_id is null then null
    else matched_gt_id end matched_gt_id,
  case when v.category is not null and v.matched_gt_id is not null and g.gt_id is null then 'low'
    else confidence end confidence,
  case when v.category is not null and v.matched_gt_id is not null and g.gt_id is null
    then 'Invalid GT ID "'||matched_gt_id||'". '||reasoning else reasoning end reasoning
from s_votes v left join s_gt g on g.codebase_id=v.codebase_id and g.gt_id=v.matched_gt_id""")
def validate_vote_gt(t):
    return voting.validate_vote_gt(s.votes(t), s.ground_truth(t))


MAJORITY = """
with_votes as (select *, category||':'||case when category='matched' then
    coalesce(matched_gt_id::varchar,'null') else '' end k from s_votes),
tally as (select codebase_id, unit_user, unit_day, k, count(*) n, min(vote_no) first_vote,
    arg_min(category,vote_no) category, min_by(coalesce(matched_gt_id,-1),vote_no) gt, arg_min(reasoning,vote_no) why
  from with_votes where category is not null group by 1,2,3,4),
best as (select * from tally qualify row_number() over
    (partition by codebase_id, unit_user, unit_day order by n desc, first_vote)=1),
sizes as (select codebase_id, unit_user, unit_day, count(*) votes, count(category) cast_votes from s_votes group by 1,2,3)"""


@register("d2_majority_vote", named(MAJORITY, """
select s.codebase_id, s.unit_user, s.unit_day, votes, cast_votes,
  case when cast_votes=1 or n>=2 then category else 'uncertain' end category,
  case when cast_votes=1 or n>=2 then nullif(gt,-1) end matched_gt_id,
  case when cast_votes=1 or n>=2 then n||'/'||votes else 'no-majority' end agreement,
  case when cast_votes=1 or n>=2 then n else 0 end agreement_count,
  case when cast_votes=1 or n>=2 then why end reasoning
from sizes s left join best using (codebase_id, unit_user, unit_day)"""))
def majority_vote(t):
    return voting.majority_vote(s.votes(t), UNIT)


@register("d3_no_majority_reason", named(MAJORITY + """,
undecided as (select s.* from sizes s left join best using (codebase_id, unit_user, unit_day) where not (cast_votes=1 or coalesce(n,0)>=2)),
whys as (select codebase_id, unit_user, unit_day, arg_min(reasoning,vote_no) filter (category='novel') novel_why,
  arg_min(reasoning,vote_no) any_why, min(vote_no)//1000 first_page, max(vote_no)//1000 last_page from with_votes where category is not null group by 1,2,3),
listed as (select codebase_id, unit_user, unit_day, vote_no//1000 as page, string_agg(k, ', ' order by vote_no) keys
  from with_votes where category is not null group by 1,2,3,4)""", """
select codebase_id, unit_user, unit_day, page, case when page=first_page then 'No majority (' else ', ' end||keys||case when page=last_page then
  case when votes>cast_votes then ', '||(votes-cast_votes)||' failed' else '' end||'). '||coalesce(novel_why, any_why) else '' end reasoning
from undecided join whys using (codebase_id, unit_user, unit_day) join listed using (codebase_id, unit_user, unit_day)
union all select codebase_id, unit_user, unit_day, 0, 'All '||votes||' vote(s) failed — cannot classify.' from undecided where cast_votes=0"""))
def no_majority_reason(t):
    return voting.no_majority_reason(s.votes(t), UNIT)


@register("d4_dedup_gt_match", """
select run_id, finding_index "position", part_id%5 finding_index, category, matched_gt_id, agreement, reasoning from s_labels""")
def dedup_gt_match(t):
    """Printed numbers that repeat within a run; the position alone tells the labels apart."""
    labels = s.raw_labels(t).withColumn("finding_index", F.col("part_id") % 5)
    return voting.dedup_gt_match(labels).select(
        "run_id", "position", "finding_index", "category", "matched_gt_id", "agreement", "reasoning"
    )


@register("d5_class_summary", """
select run_id, count(*) filter (category='matched') matched, count(*) filter (category='novel') novel,
  count(*) filter (category='fp') fp, count(*) filter (category='uncertain') uncertain, count(*) total
from s_labels group by 1""")
def class_summary(t):
    return voting.class_summary(s.labels(t))


@register("d6_vote_stability", named(MAJORITY, f"""
select count(*) findings, count(*) filter (kinds>1) unstable, {six('count(*) filter (kinds>1)::double/count(*)')} instability
from (select codebase_id, unit_user, unit_day, count(*) kinds from tally group by 1,2,3)"""))
def vote_stability(t):
    return rounded(voting.vote_stability(s.votes(t), UNIT), "instability")


# --- E: run and condition metrics --------------------------------------------------------------------------------

@register("e1_invalid_runs", """
select run_id, case when mode='skill' and findings_count<1
    then 'skill run produced '||findings_count||' findings (expected ≥1)'
  when mode='skill' and text_chars<500
    then 'stdout only '||text_chars||' chars (expected ≥500 for skill run)' end invalid
from s_runs_counted""")
def invalid_runs(t):
    return metrics.invalid_runs(s.runs_counted(t)).select("run_id", "invalid")


@register("e2_latest_runs", """
select run_id, codebase_id, condition_id, duration_ms from s_runs
qualify row_number() over (partition by codebase_id, condition_id order by ts desc, run_id)=1""")
def latest_runs(t):
    return metrics.latest_runs(s.runs(t)).select("run_id", "codebase_id", "condition_id", "duration_ms")


@register("e3_run_numbers", "select codebase_id, condition_id, run_id, run_number from s_numbers")
def run_numbers(t):
    return metrics.run_numbers(s.runs(t)).select("codebase_id", "condition_id", "run_id", "run_number")


@register("e4_condition_order", """
select r.condition_id, case when r.condition_id='bare_audit' then 9000 else coalesce(position,8000) end condition_pos
from (select distinct condition_id from s_runs) r left join s_conditions using (condition_id)""")
def condition_order(t):
    return metrics.condition_order(s.runs(t), s.conditions(t))


@register("e5_run_metrics", f"""
select run_id, matched, novel, fp, uncertain, matched_ids, {six('recall')} recall, {six('prec')} as precision_value
from e_run_metrics""")
def run_metrics(t):
    return rounded(run_table(t), "recall", "precision").select(
        "run_id", "matched", "novel", "fp", "uncertain", "matched_ids", "recall",
        F.col("precision").alias("precision_value"),
    )


@register("e5_run_matches", """
select codebase_id, condition_id, run_id, matched_gt_id gt_id, matched_gt_id gt_pos
from s_labels where matched_gt_id is not null""")
def run_matches(t):
    return metrics.run_matches(s.labels(t), s.ground_truth(t))


CONDITION_ROUNDED = ["avg_matched", "avg_findings_count", "avg_uncertain", "avg_cost", "avg_recall", "avg_fp", "fp_rate"]


@register("e6_condition_agg", f"""
select codebase_id, condition_id, valid_runs, total_runs, gt_total, total_fp, total_findings,
  {sixes(*CONDITION_ROUNDED)}, {six('avg_duration_ms', 3)} avg_duration_ms from e_condition_agg""")
def condition_agg(t):
    return rounded(
        rounded(metrics.condition_agg(run_table(t)), *CONDITION_ROUNDED), "avg_duration_ms", digits=3
    )


@register("e7_consistency_jaccard", f"select codebase_id, condition_id, {six('consistency')} consistency from e_consistency")
def consistency_jaccard(t):
    table = consistency.consistency_jaccard(s.runs(t), s.labels(t), s.ground_truth(t))
    return rounded(table, "consistency")


@register("e7_consistency_wide", named("""
wide_runs as (select n_regionkey codebase_id, c_mktsegment condition_id, c_custkey run_id from customer join nation on c_nationkey=n_nationkey
  where c_custkey%9<>0 and c_custkey%10<>0 and n_regionkey<>2),
wide_ids as (select distinct codebase_id, condition_id, run_id, (l_suppkey*7+l_partkey)%400 id from lineitem join orders on l_orderkey=o_orderkey
  join wide_runs on run_id=o_custkey),
wide_sets as (select r.codebase_id, r.condition_id, r.run_id, count(id) a from wide_runs r left join wide_ids using (codebase_id, condition_id, run_id) group by 1,2,3),
wide_shared as (select x.codebase_id, x.condition_id, x.run_id xr, y.run_id yr, count(*) i from wide_ids x join wide_ids y
  on x.codebase_id=y.codebase_id and x.condition_id=y.condition_id and x.id=y.id and x.run_id<y.run_id group by 1,2,3,4),
wide_sum as (select s.codebase_id, s.condition_id, sum(i::double/(x.a+y.a-i)) j from wide_shared s
  join wide_sets x on x.run_id=xr join wide_sets y on y.run_id=yr group by 1,2)""", f"""
select codebase_id, condition_id, {six('case when n>=2 then (coalesce(j,0)+e*(e-1)/2.0)/(n*(n-1)/2.0) end')} consistency
from (select codebase_id, condition_id, count(*)::double n, count(*) filter (a=0)::double e from wide_sets group by 1,2)
left join wide_sum using (codebase_id, condition_id)"""))
def consistency_wide(t):
    """Sets out of 400 ids, most of them distinct."""
    return rounded(consistency.consistency_jaccard(*s.wide_runs(t)), "consistency")


@register("e8_novel_counts", "select * from e_novels")
def novel_counts(t):
    labels = shared_labels(t)
    return metrics.novel_counts(s.members(t, labels), s.verdicts(t, labels))


def _missed(t):
    return metrics.missed_gt(s.ground_truth(t), s.runs(t), s.labels(t))


@register("e9_missed_gt", "select codebase_id, gt_id, severity, title from e_missed")
def missed_gt(t):
    return _missed(t).select("codebase_id", "gt_id", "severity", "title")


@register("e9_missed_totals", """
select (select count(*) from e_missed) gt_missed_total, (select count(*) from s_gt) gt_total_all,
  cast(floor((select count(*) from e_missed)*100.0/(select count(*) from s_gt)+0.5) as int) gt_missed_percent""")
def missed_totals(t):
    return metrics.missed_totals(s.ground_truth(t), _missed(t))


@register("e10_gt_reliability", """
select f.codebase_id, f.condition_id, f.gt_id, substr(g.title,1,40) gt_title, found_count, total_classified, total_runs,
  case when found_count=total_classified then 'RELIABLE' when found_count=1 then 'INCONSISTENT'
    else found_count||'/'||total_classified end as label
from (select codebase_id, condition_id, gt_id, count(*) found_count from e_found group by 1,2,3) f
join (select codebase_id, condition_id, count(*) total_runs, count(*) filter (is_classified) total_classified
  from s_runs where is_valid group by 1,2) n using (codebase_id, condition_id)
join s_gt g on g.codebase_id=f.codebase_id and g.gt_id=f.gt_id
where total_runs>1 and total_classified>=1""")
def gt_reliability(t):
    return metrics.gt_reliability(s.runs(t), s.labels(t), s.ground_truth(t))


@register("e11_f1", f"select run_id, {six('f1')} f1 from e_run_metrics")
def f1(t):
    return rounded(run_table(t).select("run_id", "f1"), "f1")


@register("e12_recall_by_severity", f"""
select r.run_id, r.codebase_id, t.severity, coalesce(h.matched,0) matched, t.total,
  {six('coalesce(h.matched,0)::double/t.total')} rate
from s_runs r join (select codebase_id, severity, count(*) total from s_gt group by 1,2) t using (codebase_id)
left join (select run_id, severity, count(distinct matched_gt_id) matched from s_labels l
  join s_gt g on g.codebase_id=l.codebase_id and g.gt_id=matched_gt_id group by 1,2) h
  on h.run_id=r.run_id and h.severity is not distinct from t.severity
where r.is_classified""")
def recall_by_severity(t):
    return rounded(metrics.recall_by_severity(s.runs(t), s.labels(t), s.ground_truth(t)), "rate")


@register("e13_stat_summary", f"""
select condition_id, {six('avg(duration_ms)', 3)} duration_ms_mean, {six('stddev_pop(duration_ms)', 3)} duration_ms_std,
  min(duration_ms) duration_ms_min, max(duration_ms) duration_ms_max from s_runs group by 1""")
def stat_summary(t):
    table = s.runs(t).groupBy("condition_id").agg(*metrics.stat_summary("duration_ms"))
    return rounded(table, "duration_ms_mean", "duration_ms_std", digits=3)


STAT_COLUMNS = [
    f"{name}_{part}"
    for name in ("recall", "precision", "f1", "findings_count", "cost_usd")
    for part in ("mean", "std", "min", "max")
]


@register("e14_condition_stats", f"""
select m.codebase_id, m.condition_id, run_count, {", ".join(f"{six(c, 7)} {c}" for c in STAT_COLUMNS)},
  {six('duration_ms_mean', 3)} duration_ms_mean, {six('duration_ms_std', 3)} duration_ms_std, duration_ms_min, duration_ms_max,
  {six('consistency')} consistency, unique_bugs_found unique_novel_bugs
from (select codebase_id, condition_id, count(*) run_count,
  {", ".join(f"avg({src}) {name}_mean, stddev_pop({src}) {name}_std, min({src}) {name}_min, max({src}) {name}_max"
             for name, src in [("recall", "recall"), ("precision", "prec"), ("f1", "f1"),
                               ("findings_count", "findings_count"), ("cost_usd", "cost_usd"),
                               ("duration_ms", "duration_ms")])}
  from e_run_metrics where is_valid group by 1,2) m
left join e_consistency using (codebase_id, condition_id) left join e_novels using (codebase_id, condition_id)""")
def condition_stats(t):
    stats = metrics.condition_stats(*condition_parts(t, Shared(t)))
    stats = rounded(stats, "duration_ms_mean", "duration_ms_std", digits=3)
    return rounded(rounded(stats, *STAT_COLUMNS, digits=7), "consistency")


@register("e15_cross_codebase", f"select {CROSS_COLUMNS} from e_cross")
def cross_codebase(t):
    return round_cross(metrics.cross_codebase(condition_table(t)))


BESTS = """
scores as (select condition_id, 'recall' metric, avg_recall v from e_cross
  union all select condition_id, 'confirmedNovelsFiltered', confirmed_novels_filtered from e_cross
  union all select condition_id, 'fpRate', -fp_rate from e_cross
  union all select condition_id, 'consistency', consistency from e_cross
  union all select condition_id, 'avgCost', -avg_cost from e_cross
  union all select condition_id, 'avgDuration', -avg_duration_ms from e_cross),
bests as (select metric, condition_id from scores where v is not null
  qualify rank() over (partition by metric order by v desc)=1)"""


@register("e16_metric_bests", named(BESTS, "select metric, condition_id from bests"))
def metric_bests(t):
    return metrics.metric_bests(metrics.cross_codebase(condition_table(t)))


@register("e17_filter_by_codebases", f"""
select {CROSS_COLUMNS} from (
select condition_id, sum(valid_runs)::bigint valid_runs,
  sum(avg_matched) filter (avg_recall is not null)/sum(gt_total) filter (avg_recall is not null) avg_recall,
  nullif(sum(coalesce(gt_total,0))::bigint,0) gt_total, sum(confirmed_novels)::bigint confirmed_novels,
  sum(confirmed_novels_filtered)::bigint confirmed_novels_filtered,
  sum(plausible_novels_filtered)::bigint plausible_novels_filtered,
  case when sum(total_findings)>0 then sum(total_fp)::double/sum(total_findings) end fp_rate,
  avg(consistency) consistency, sum(avg_cost*valid_runs)/sum(valid_runs) filter (avg_cost is not null) avg_cost,
  sum(avg_duration_ms*valid_runs)/sum(valid_runs) filter (avg_duration_ms is not null) avg_duration_ms
from e_table where codebase_id in (1,2,4) and condition_id<>'4-NOT SPECIFIED' group by 1)""")
def filter_by_codebases(t):
    visible = ["1-URGENT", "2-HIGH", "3-MEDIUM", "bare_audit"]
    return round_cross(metrics.filter_by_codebases(condition_table(t), [1, 2, 4], visible))


@register("e17_subset_view", """
select t.*, (select count(*) from s_verdicts where codebase_id in (1,2,4) and risk_category is not null
    and verdict in ('confirmed','plausible')) excluded
from (select m gt_missed_total, n gt_total_all, cast(floor(m*100.0/n+0.5) as int) gt_missed_percent
  from (select (select count(*) from e_missed where codebase_id in (1,2,4)) m, (select count(*) from s_gt where codebase_id in (1,2,4)) n)) t""")
def subset_view(t):
    labels = shared_labels(t)
    missed = metrics.missed_gt(s.ground_truth(t), s.runs(t), labels)
    return metrics.subset_totals(s.ground_truth(t), missed, s.verdicts(t, labels), [1, 2, 4])


SUBSET_CROSS = """
cross_subset as (
select condition_id, sum(avg_matched) filter (avg_recall is not null)/sum(gt_total) filter (avg_recall is not null) avg_recall,
  sum(confirmed_novels_filtered)::bigint confirmed_novels_filtered,
  case when sum(total_findings)>0 then sum(total_fp)::double/sum(total_findings) end fp_rate, avg(consistency) consistency,
  sum(avg_cost*valid_runs)/sum(valid_runs) filter (avg_cost is not null) avg_cost,
  sum(avg_duration_ms*valid_runs)/sum(valid_runs) filter (avg_duration_ms is not null) avg_duration_ms
from e_table where codebase_id in (1,2,4) group by 1)"""


@register("e17_subset_bests", named(SUBSET_CROSS + "," + BESTS.replace("e_cross", "cross_subset"), "select metric, condition_id from bests"))
def subset_bests(t):
    return metrics.metric_bests(metrics.filter_by_codebases(condition_table(t), [1, 2, 4]))


@register("e18_risk_excluded", """
select count(*) filter (risk_category is not null and verdict in ('confirmed','plausible')) excluded from s_verdicts""")
def risk_excluded(t):
    return metrics.risk_excluded(s.verdicts(t))


@register("e19_integrity_check", """
select run_id, codebase_id, condition_id, 'lost' as rule, findings_count-coalesce(n,0) diff
from s_runs_counted left join (select run_id, count(*) n from s_labels where part_id%50<>0 group by 1) using (run_id)
where is_classified and coalesce(n,0)<findings_count
union all
select r.run_id, r.codebase_id, r.condition_id, 'category_sum', count(*) filter (part_id%45<>0)-count(*)
from s_runs r join s_labels l on l.run_id=r.run_id and part_id%50<>0
where r.is_classified group by 1,2,3 having count(*) filter (part_id%45=0)>0""")
def integrity_check(t):
    """Labels of every 50th part are lost and those of every 45th carry an unknown category, so both rules fire."""
    damaged = s.labels(t).filter("part_id % 50 <> 0").withColumn(
        "category", F.when(F.col("part_id") % 45 == 0, "other").otherwise(F.col("category"))
    )
    return metrics.integrity_check(s.runs_counted(t), damaged)


@register("e20_report_header", """
select count(*) total_runs, count(*) filter (is_valid) valid_runs, count(*) filter (not is_valid) invalid_runs,
  count(distinct codebase_id) codebases, 'all' as mode from s_runs""")
def report_header(t):
    return metrics.report_header(s.runs(t))


EVAL = """
evals as (select g.codebase_id, g.gt_id, g.severity, case when max(case when l.agreement_count>=2 and g.gt_id%5<>0 then 1 end)=1
    then 'FOUND' when count(l.run_id)>0 then 'LEAD' else 'MISSED' end status
  from s_gt g left join s_labels l on l.codebase_id=g.codebase_id and l.matched_gt_id=g.gt_id group by 1,2,3)"""


def _eval_status(t):
    """Matches of all runs; those with one vote, and all of every fifth item, count as leads."""
    hits = s.labels(t).filter("matched_gt_id is not null").select(
        "codebase_id", F.col("matched_gt_id").alias("gt_id"), "agreement_count"
    )
    sure = "agreement_count >= 2 and gt_id % 5 <> 0"
    return metrics.eval_status(s.ground_truth(t), hits.filter(sure), hits.filter(f"not ({sure})"))


@register("e21_eval_status", named(EVAL, "select * from evals"))
def eval_status(t):
    return _eval_status(t)


@register("e21_eval_tally", named(EVAL, f"""
select codebase_id, count(*) total, count(*) filter (status='FOUND') found, count(*) filter (status='LEAD') leads,
  count(*) filter (status='MISSED') missed, count(*) filter (status='FOUND' and severity='high') high_found,
  count(*) filter (severity='high') high_total, count(*) filter (status='FOUND' and severity='medium') medium_found,
  count(*) filter (severity='medium') medium_total,
  {six("count(*) filter (status='FOUND')::double/count(*)")} recall from evals group by 1"""))
def eval_tally(t):
    return rounded(metrics.eval_tally(_eval_status(t)), "recall")


@register("e22_gt_profile", """
select codebase_id, count(*) filter (severity='high') high, count(*) filter (severity='medium') medium,
  count(*) filter (severity='low') low, count(*) total from s_gt group by rollup (codebase_id)""")
def gt_profile(t):
    return metrics.gt_profile(s.ground_truth(t))
