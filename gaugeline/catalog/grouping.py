"""Registered queries for judge tables (C), clustering (G) and validations (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.oracle_views import word_set_sql
from gaugeline.catalog.registry import Registry, named
from gaugeline.catalog.run_logs import SOURCES, _scoped
from gaugeline.operators import clustering, extraction, judging, matching, scope
from gaugeline.plans import standins as s
from gaugeline.session import cut_lineage

register = Registry()


# --- C: requests, responses, rule-based votes --------------------------------------------------------------------

@register("c1_classify_requests", """
select f.codebase_id, f.run_id, f.line_no "position", f.idx finding_index, v.vote_no, f.title, coalesce(f.location,'unknown') "location",
  coalesce(f.confidence::varchar,'N/A') confidence, coalesce(f.severity,'N/A') severity, f.context
from (select f.*, coalesce((select string_agg(m.raw, chr(10) order by m.line_no) from r_lines m
    where m.run_id=f.run_id and m.line_no between h.first_no and h.first_no+39), f.title) context
  from r_owned f left join (select f.run_id, f.line_no, min(l.line_no) first_no
    from r_findings f join r_lines l on l.run_id=f.run_id
      and contains(regexp_replace(l.raw,'[`*]','','g'), substr(regexp_replace(f.title,'[`*]','','g'),1,20))
    group by 1,2) h on h.run_id=f.run_id and h.line_no=f.line_no) f, (values (0),(1),(2)) v(vote_no)
where f.codebase_id<>3""")
def classify_requests(t):
    found = s.report_findings(t)
    contexts = extraction.finding_context(s.reports(t), found)
    return judging.classify_requests(found, contexts, s.report_truth(t), votes=3)


@register("c1_gt_sections", """
select codebase_id, gt_id gt_pos, gt_id, '### '||gt_id||' ('||coalesce(severity,'unknown')||')'||chr(10)||'Title: '||title||chr(10)||
  'Location: N/A'||chr(10)||'Root Cause: N/A'||chr(10)||'Description: '||description "section" from r_truth""")
def gt_sections(t):
    return judging.gt_sections(s.report_truth(t))


@register("c2_cluster_requests", """
select codebase_id, chunk_no, count(*) findings, string_agg(member_index||'. '||title||chr(10)||'   '||reasoning, chr(10) order by member_index) listing
from (select *, (n-1)//15 chunk_no, (n-1)%15+1 member_index from (
  select *, row_number() over (partition by codebase_id order by run_id, finding_index) n from g_inputs)) group by 1,2""")
def cluster_requests(t):
    return judging.cluster_requests(judging.chunked(clustering.collect_novel(s.labels(t)), judging.FULL_CHUNK))


@register("c3_validate_requests", named(SOURCES, """
select c.codebase_id, c.cluster_id, 'Title: '||any_value(c.title)||chr(10)||'Claimed Severity: '||any_value(c.severity)||chr(10)||'Reasoning: seen' claim,
  p.level, count(*) files, (sum(length('// ═══ '||p.path||' ═══')+2+length(f.content))+2*(count(*)-1))::bigint chars
from s_clusters c join picked p on p.codebase_id=c.codebase_id and p.cluster_id=c.cluster_id
join files f on f.codebase_id=p.codebase_id and f.path=p.path group by c.codebase_id, c.cluster_id, p.level"""))
def validate_requests(t):
    clusters = s.clusters(t).withColumn("reasoning", F.lit("seen"))
    return judging.validate_requests(clusters, scope.scoped_sizes(*_scoped(t)))


def _responses(t):
    """Replies of a judge, one per order: plain, chatty, wrong value, not JSON, or broken JSON."""
    reply = """concat('{"category":"', case when o_orderkey % 6 = 2 then 'maybe' else 'novel' end, '","matchedGtId":null,"confidence":"',
      element_at(array('high','medium','low'), cast(1 + o_orderkey % 3 as int)), '","reasoning":"r', o_orderkey, '"}')"""
    raw = f"""case o_orderkey % 6 when 3 then 'no idea' when 4 then concat('{{', {reply}) when 1 then concat('Sure:\\n', {reply}, '\\nDone.')
      else {reply} end"""
    return t.orders.select(F.col("o_orderkey").alias("request_id"), F.expr(raw).alias("raw"))


@register("c4_parse_responses", """
select o_orderkey request_id, case o_orderkey%6 when 2 then 'validation' when 3 then 'parse' when 4 then 'parse' end error_code,
  case when o_orderkey%6 in (0,1,5) then 'novel' end category, case when o_orderkey%6 in (0,1,5) then ['high','medium','low'][1+o_orderkey%3] end confidence,
  case when o_orderkey%6 in (0,1,5) then 'r'||o_orderkey end reasoning from orders""")
def parse_responses(t):
    parsed = judging.parse_responses(
        _responses(t), judging.CLASSIFY_REPLY, judging.CLASSIFY_ENUMS, required=["reasoning"]
    )
    return parsed.select("request_id", "error_code", "reply.category", "reply.confidence", "reply.reasoning")


@register("c5_retry_eligible", """
select request_id, attempt, error_code from (
  select distinct user_id request_id, event_id%(1+user_id%4) attempt, ['parse','timeout','validation','exit'][1+(user_id//4+event_id%(1+user_id%4))%4] error_code
  from events)
qualify row_number() over (partition by request_id order by attempt desc)=1 and error_code in ('exit','parse','timeout') and attempt<3""")
def retry_eligible(t):
    attempt = F.col("event_id") % (1 + F.col("user_id") % 4)
    codes = F.array(*[F.lit(code) for code in ("parse", "timeout", "validation", "exit")])
    attempts = t.events.select(
        F.col("user_id").alias("request_id"),
        attempt.alias("attempt"),
        F.element_at(codes, (1 + (F.floor(F.col("user_id") / 4) + attempt) % 4).cast("int")).alias("error_code"),
    )
    return judging.retry_eligible(attempts, judging.MAX_ATTEMPTS["cluster"])


@register("c6_rule_matcher", f"""
select f.run_id, f.line_no "position", f.idx finding_index, f.codebase_id,
  case when c.gt_id is not null then 'same contract and keyword class' when b.gt_id is not null then 'similar title'
    else 'no ground-truth item is close' end reasoning,
  case when coalesce(c.gt_id,b.gt_id) is not null then 'matched' when split_part(root_cause,'::',1)='unknown' then 'fp' else 'novel' end category,
  coalesce(c.gt_id,b.gt_id) matched_gt_id, case when c.gt_id is not null then 'high' when b.gt_id is not null then 'medium' else 'low' end confidence
from r_owned f left join r_causes c on c.codebase_id=f.codebase_id and c.contract=split_part(root_cause,'::',1) and c.vuln_type=f.vuln_type
left join r_best b on b.codebase_id=f.codebase_id and b.words={word_set_sql('f.title')}""")
def rule_matcher(t):
    found = s.report_findings(t).withColumnRenamed("index", "finding_index")
    return matching.rule_matcher(found, s.report_truth(t), theta=0.5)


# --- G: clustering -----------------------------------------------------------------------------------------------

INPUT = "codebase_id, run_id, condition_id, finding_index, title, reasoning"
MEMBER_COLUMNS = ["codebase_id", "cluster_id", "run_id", "condition_id", "finding_index"]


@register("g1_collect_novel", f"select {INPUT} from g_inputs")
def collect_novel(t):
    return clustering.collect_novel(s.labels(t))


ALL_SQL = """
select f.codebase_id, f.run_id, f.condition_id, idx finding_index, title, case when description<>'' then description||' ' else '' end||
  'Location: '||coalesce(location,'unknown')||'. Type: '||vuln_type||'.' reasoning from r_owned f where f.run_id%19<>0"""


def _report_runs(t):
    key = F.col("run_id")
    return s.report_runs(t).withColumn("exit_code", F.when(key % 19 == 0, 1).when(key % 17 == 0, 143).otherwise(0))


@register("g2_collect_all", ALL_SQL)
def collect_all(t):
    return clustering.collect_all(extraction.extract_findings(s.reports(t)), _report_runs(t))


@register("g3_cluster_inputs", f"""
select v.codebase_id, v.run_id, 'cond'||(v.run_id%3) condition_id, idx finding_index, title, 'voted' reasoning
from r_owned v where codebase_id<>3 and idx%2=0
union all select * from ({ALL_SQL}) where codebase_id=3""")
def cluster_inputs(t):
    """Every second finding of a codebase with ground truth was labelled novel."""
    found = extraction.extract_findings(s.reports(t))
    labels = s.report_findings(t).select(
        "codebase_id", "run_id", "condition_id", F.col("index").alias("finding_index"), "title",
        F.lit("voted").alias("reasoning"), F.when(F.col("index") % 2 == 0, "novel").otherwise("fp").alias("category"),
    )
    return clustering.cluster_inputs(labels, found, _report_runs(t), s.report_truth(t))


def _old_members(t, labels):
    return s.members(t, labels).filter("condition_id in ('1-URGENT', '2-HIGH')")


@register("g4_new_findings", f"select {INPUT} from g_new")
def new_findings(t):
    labels = cut_lineage(s.labels(t))
    return clustering.new_findings(clustering.collect_novel(labels), _old_members(t, labels))


@register("g5_prune_stale", """
select codebase_id, cluster_id, condition_id, run_id, finding_index from s_members m join part on p_brand=cluster_id
  and p_partkey=(select any_value(part_id) from s_labels l where l.run_id=m.run_id and l.finding_index=m.finding_index)
where p_partkey%10<>0 and cluster_id<>'Brand#7'""")
def prune_stale(t):
    """Inputs without every tenth part and without one brand."""
    labels = cut_lineage(s.labels(t))
    parts = t.part.select(F.col("p_partkey").alias("part_id"), "p_brand")
    live = labels.filter("part_id % 10 <> 0").join(parts, "part_id").filter("p_brand <> 'Brand#7'")
    return clustering.prune_members(s.members(t, labels), live).select(
        "codebase_id", "cluster_id", "condition_id", "run_id", "finding_index"
    )


@register("g5_prune_summary", """
select m.codebase_id, count(*) filter (not keep) pruned_findings, count(distinct cluster_id)-count(distinct cluster_id) filter (keep) dropped_clusters
from (select m.*, l.part_id%10<>0 and cluster_id<>'Brand#7' keep from s_members m join s_labels l on l.run_id=m.run_id and l.finding_index=m.finding_index) m
group by 1""")
def prune_summary(t):
    labels = cut_lineage(s.labels(t))
    parts = t.part.select(F.col("p_partkey").alias("part_id"), "p_brand")
    live = labels.filter("part_id % 10 <> 0").join(parts, "part_id").filter("p_brand <> 'Brand#7'")
    members = s.members(t, labels)
    return clustering.prune_summary(members, clustering.prune_members(members, live))


@register("g6_cluster_id", "select doc_id, 'novel-'||substr(sha256(source||text),1,8) cluster_id from documents")
def cluster_id(t):
    return t.documents.select("doc_id", clustering.cluster_id(F.col("source"), F.col("text")).alias("cluster_id"))


def _incremental(t):
    """Chunks of new findings and a judge's assignments for them, by part number; every fourth part is left out."""
    labels = cut_lineage(s.labels(t))
    members = _old_members(t, labels)
    inputs = labels.filter(F.col("category").isin("novel", "uncertain")).select(*clustering.INPUT, "part_id")
    chunks = cut_lineage(judging.chunked(clustering.new_findings(inputs, members), judging.INCREMENTAL_CHUNK))
    key = F.col("part_id")
    opened = key % 8 == 0
    assignments = chunks.filter(key % 4 != 3).select(
        "codebase_id",
        "chunk_no",
        F.col("member_index").alias("position"),
        "member_index",
        F.when(key % 4 == 0, "new")
        .when(key % 4 == 1, F.concat(F.lit("Brand#"), 1 + key % 25))
        .otherwise(F.concat(F.lit("unknown-"), key % 5))
        .alias("assign_to"),
        F.when(opened, F.concat(F.lit("Opened for "), key % 16)).alias("new_title"),
        F.when(opened, "because").alias("new_reasoning"),
        F.when(opened, "high").alias("new_severity"),
    )
    out_of_range = assignments.filter("position = 1").withColumn("member_index", F.lit(99))
    clusters = s.clusters(t, labels).withColumn("reasoning", F.lit("seen"))
    return assignments.unionByName(out_of_range), chunks, clusters, members


@register("g7_apply_assignments", """
select codebase_id, cluster_id, run_id, condition_id, finding_index from g_old
union select codebase_id, cluster_id, run_id, condition_id, finding_index from g_placed""")
def apply_assignments(t):
    return clustering.apply_assignments(*_incremental(t))[1].select(*MEMBER_COLUMNS)


@register("g7_clusters_after", """
select codebase_id, cluster_id, severity from s_clusters
union all select codebase_id, cluster_id, arg_min(case when assign_to='new' then coalesce(new_severity,'unknown') else 'unknown' end, (chunk_no, member_index))
from g_placed where is_new group by 1,2""")
def clusters_after(t):
    return clustering.apply_assignments(*_incremental(t))[0].select("codebase_id", "cluster_id", "severity")


@register("g8_orphans", """
select codebase_id, run_id, finding_index, title, 'novel-orphan-'||finding_index cluster_id, 'unknown' severity from g_new where part_id%4=3""")
def orphans(t):
    assignments, chunks, _, _ = _incremental(t)
    return clustering.orphan_clusters(clustering.unassigned(chunks, assignments)).select(
        "codebase_id", "run_id", "finding_index", "title", "cluster_id", "severity"
    )


@register("g9_expand_members", """
select a.codebase_id, 'novel-'||substr(sha256('Cluster '||a.chunk_no||'because'),1,8) cluster_id, run_id, condition_id, finding_index
from (select distinct codebase_id, chunk_no from g_new) a join g_new n on n.codebase_id=a.codebase_id and n.chunk_no=a.chunk_no and n.member_index in (1,3,5)
union all select a.codebase_id, 'novel-'||substr(sha256('Other '||a.chunk_no||'because'),1,8), run_id, condition_id, finding_index
from (select distinct codebase_id, chunk_no from g_new) a join g_new n on n.codebase_id=a.codebase_id and n.chunk_no=a.chunk_no and n.member_index in (3,4)""")
def expand_members(t):
    """Two clusters per chunk; one finding is in both and one index does not exist."""
    _, chunks, _, _ = _incremental(t)
    every = chunks.select("codebase_id", "chunk_no").distinct()

    def answers(word, *members):
        return every.select(
            "codebase_id", "chunk_no", F.concat(F.lit(word + " "), "chunk_no").alias("title"), F.lit("because").alias("reasoning"),
            F.array(*[F.lit(m) for m in members]).alias("member_indices"),
        )

    return clustering.expand_members(answers("Cluster", 1, 3, 5, 77).unionByName(answers("Other", 3, 4)), chunks).select(
        *MEMBER_COLUMNS
    )


def _clustered(t):
    return clustering.cluster_findings(_caused(t))


def _caused(t):
    """Root causes link three neighbouring parts, titles the next three, with a break after every thirty.

    Every seventh part has one word more in its title, so titles are similar, not equal.
    """
    key = F.col("part_id")
    group = F.when(key % 30 == 29, F.floor(key / 3)).otherwise(F.floor((key + 1) / 3))
    loose = s.labels(t).filter(F.col("category").isin("novel", "uncertain"))
    return loose.withColumns(
        {"root_cause": F.concat(F.lit("k"), F.floor(key / 3)), "title": F.concat(F.lit("Weak group g"), group, F.when(key % 7 == 3, " again").otherwise(""))}
    )


COMPONENTS = """
edges as (select distinct codebase_id, a x, b y from g_keyed union select distinct codebase_id, b, a from g_keyed
  union select codebase_id, a, b from g_near union select codebase_id, b, a from g_near),
reach as (select codebase_id, x, x y from edges union select r.codebase_id, r.x, e.y from reach r join edges e on e.codebase_id=r.codebase_id and e.x=r.y),
roots as (select codebase_id, x, min(y) root from reach group by 1,2)"""


@register("g10_cluster_findings", named(COMPONENTS, """
select k.codebase_id, 'novel-'||substr(sha256(root),1,12) cluster_id, run_id, condition_id, finding_index
from g_keyed k join roots r on r.codebase_id=k.codebase_id and r.x=k.a"""))
def cluster_findings(t):
    return _clustered(t)[1].select(*MEMBER_COLUMNS)


@register("g11_extended_clusters", named(COMPONENTS, """
select distinct k.codebase_id, k.a cause_key, root component from g_keyed k join roots r on r.codebase_id=k.codebase_id and r.x=k.a"""))
def extended_clusters(t):
    """The components of all findings, reached in two rounds: those of even runs first, the others added."""
    found = cut_lineage(_caused(t))
    state = None
    for half in (0, 1):
        state, _ = clustering.extend_clusters(state, found.filter(F.pmod("run_id", F.lit(2)) == half))
    first = state.roots.groupBy("scope", "root").agg(F.min("node").alias("component"))
    return state.roots.filter(F.col("node").startswith("c:")).join(first, ["scope", "root"]).select(
        F.col("scope").alias("codebase_id"), F.col("node").alias("cause_key"), "component"
    )


@register("g11_assign_incremental", f"""
select codebase_id, chunk_no, member_index as "position", member_index, coalesce('gt-'||lpad(gt_id::varchar,12,'0'),'new') assign_to from (
  select f.codebase_id, (n-1)//5 chunk_no, ((n-1)%5+1)::int member_index, b.gt_id from (
    select *, row_number() over (partition by codebase_id order by run_id, idx, line_no) n from r_owned) f
  left join r_best b on b.codebase_id=f.codebase_id and b.words={word_set_sql('f.title')})""")
def assign_incremental(t):
    found = s.report_findings(t).withColumnRenamed("index", "finding_index").withColumn("reasoning", F.col("description"))
    chunks = judging.chunked(found.select(*clustering.INPUT), judging.INCREMENTAL_CHUNK)
    name = F.concat(F.lit("gt-"), F.lpad(F.col("gt_id").cast("string"), 12, "0"))
    clusters = s.report_truth(t).select("codebase_id", name.alias("cluster_id"), "title")
    return clustering.assign_incremental(chunks, clusters, theta=0.5).select(
        "codebase_id", "chunk_no", "position", "member_index", "assign_to"
    )


@register("g12_cluster_totals", """
select c.codebase_id, count(*) unique_bugs, any_value(m.n) total_findings from s_clusters c
join (select codebase_id, count(*) n from s_members group by 1) m on m.codebase_id=c.codebase_id group by 1""")
def cluster_totals(t):
    labels = cut_lineage(s.labels(t))
    return clustering.cluster_totals(s.clusters(t, labels), s.members(t, labels))


@register("g13_single_input", """
select doc_id codebase_id, 'novel-1' cluster_id, doc_id run_id from documents""")
def single_input(t):
    """Every document as the only finding of a codebase."""
    inputs = t.documents.select(
        F.col("doc_id").alias("codebase_id"), F.col("doc_id").alias("run_id"), F.lit("c").alias("condition_id"),
        F.lit(1).alias("finding_index"), F.col("source").alias("title"), F.lit("r").alias("reasoning"),
        F.lit("unknown::x").alias("root_cause"),
    )
    return clustering.cluster_findings(inputs)[1].select("codebase_id", "cluster_id", "run_id")


# --- H: validations ----------------------------------------------------------------------------------------------

def _validations(t):
    """Replies by cluster number: every fifth cluster has no source, every third reply failed."""
    labels = cut_lineage(s.labels(t))
    clusters = s.clusters(t, labels)
    n = F.col("n")
    failed = n % 3 == 0
    replies = clusters.filter("n % 11 <> 0").select(
        "codebase_id", "cluster_id",
        F.when(~failed, F.when(n % 2 == 0, "confirmed").otherwise("rejected")).alias("verdict"),
        F.when(~failed, "low").alias("severity"), F.when(~failed, "traced").alias("reasoning"),
        F.when(~failed, "f()").alias("code_evidence"), F.lit(None).cast("string").alias("risk_category"),
        F.when(failed, "timeout").alias("error_code"),
    )
    return clustering.validation_defaults(clusters, replies, clusters.filter("n % 5 <> 0"))


VALIDATIONS = """
validated as (select codebase_id, cluster_id, title, n%5<>0 and n%11<>0 and n%3<>0 ok, n,
  case when severity='unknown' then 'medium' else severity end own from s_clusters)"""


@register("h1_validation_defaults", named(VALIDATIONS, """
select codebase_id, cluster_id, title, case when not ok then 'plausible' when n%2=0 then 'confirmed' else 'rejected' end verdict,
  case when ok then 'low' else own end severity, case when ok then 'traced' when n%5=0 then 'No source code available for validation'
    when n%11=0 then 'Validation failed: no reply' else 'Validation failed: timeout' end reasoning,
  case when ok then 'f()' end code_evidence, null risk_category from validated"""))
def validation_defaults(t):
    return _validations(t)


@register("h2_validation_summary", named(VALIDATIONS, """
select codebase_id, count(*) filter (ok and n%2=0) confirmed, count(*) filter (not ok) plausible, count(*) filter (ok and n%2<>0) rejected
from validated group by 1"""))
def validation_summary(t):
    return clustering.validation_summary(_validations(t))
