"""DuckDB views that state the stand-in relations independently; ``with_views`` prefixes a query with those it names."""

from __future__ import annotations

import re

from gaugeline.catalog import oracle_patterns as p

VIEWS = {
    "s_runs": """
select o_orderkey run_id, n_regionkey codebase_id,
  case when o_orderpriority='5-LOW' then 'bare_audit' else o_orderpriority end condition_id,
  o_orderdate ts, cast(floor(o_totalprice) as bigint) duration_ms,
  case when o_orderkey%7<>0 then (o_orderkey%400)/4.0::double end cost_usd,
  case when o_orderpriority='5-LOW' then 'bare' else 'skill' end as mode,
  o_orderstatus<>'P' is_valid, o_orderkey%11<>0 is_classified, o_orderkey%13=0 timed_out,
  case when o_orderkey%17=0 then 143 when o_orderkey%19=0 then 1 else 0 end exit_code,
  cast(floor(o_totalprice/100) as bigint) text_chars
from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey""",
    "s_counts": "select l_orderkey run_id, count(*) findings_count from lineitem group by 1",
    "s_runs_counted": """
select r.*, coalesce(c.findings_count,0) findings_count from s_runs r left join s_counts c using (run_id)""",
    "s_conditions": """
select distinct case when o_orderpriority='5-LOW' then 'bare_audit' else o_orderpriority end condition_id,
  case when o_orderpriority='5-LOW' then 'bare' else 'skill' end as type,
  cast(substr(o_orderpriority,1,1) as int) as position
from orders where o_orderpriority<>'1-URGENT'""",
    "s_gt": """
select n_regionkey codebase_id, s_suppkey gt_id, s_suppkey gt_pos,
  case when s_suppkey%7=0 then null when s_suppkey%3=0 then 'high' when s_suppkey%3=1 then 'medium' else 'low' end severity,
  'Missing check of the stored balance in the vault of '||s_name title
from supplier join nation on s_nationkey=n_nationkey where n_regionkey<>4""",
    "s_gt_total": "select codebase_id, count(*) gt_total from s_gt group by 1",
    "s_findings": """
select r.run_id, (l_partkey*1000000000+cast(round(l_extendedprice*100) as bigint))*8+l_linenumber finding_index,
  codebase_id, condition_id, is_valid, is_classified, l_partkey part_id, l_suppkey supplier_id,
  'Finding on part '||l_partkey title, l_returnflag, l_linestatus
from lineitem join s_runs r on l_orderkey=r.run_id""",
    "s_labels0": """
select f.run_id, f.finding_index, f.codebase_id, f.condition_id, f.is_valid, f.part_id, f.title,
  1+part_id%3 agreement_count, (1+part_id%3)||'/3' agreement,
  case when l_returnflag='R' and g.gt_id%6<>5 then 'matched' when l_returnflag in ('R','A') then 'fp'
       when l_linestatus='F' then 'novel' else 'uncertain' end category,
  case when l_returnflag='R' and g.gt_id%6<>5 then g.gt_id end matched_gt_id, 'seen on part '||part_id reasoning
from s_findings f left join s_gt g on g.codebase_id=f.codebase_id and g.gt_id=f.supplier_id
where f.is_classified""",
    "s_ranked": """
select *, case when category='matched' then row_number() over
    (partition by run_id, matched_gt_id, category='matched' order by agreement_count desc, finding_index) end rk,
  max(agreement_count) over (partition by run_id, matched_gt_id, category='matched' order by finding_index
    rows between unbounded preceding and 1 preceding) earlier
from s_labels0""",
    "s_labels": """
select run_id, finding_index, codebase_id, condition_id, is_valid, part_id, title, agreement_count, agreement,
  case when rk>1 then 'uncertain' else category end category,
  case when rk>1 then null else matched_gt_id end matched_gt_id,
  case when rk>1 then 'Duplicate GT match for '||matched_gt_id||' — demoted'||
     case when earlier is null or agreement_count>earlier then ' ('||agreement||')' else '' end||'. '||reasoning
     else reasoning end reasoning
from s_ranked""",
    "s_votes": """
select user_id unit_user, strftime(ts,'%Y-%m-%d') unit_day, user_id%4 codebase_id, event_id vote_no,
  case event_type when 'click' then 'matched' when 'view' then 'novel' when 'error' then null else 'fp' end category,
  case when event_type='click' then event_id%3 end matched_gt_id, 'high' confidence, 'vote '||event_id reasoning
from events""",
    "s_members": """
select codebase_id, p_brand cluster_id, run_id, condition_id, finding_index, title
from s_labels join part on p_partkey=part_id where category in ('novel','uncertain')""",
    "s_clusters": """
select codebase_id, cluster_id, n, 'Weak accounting across the shared modules of '||cluster_id title,
  case when n%3=0 then 'unknown' else 'high' end severity
from (select distinct codebase_id, cluster_id,
        codebase_id+cast(regexp_replace(cluster_id,'[^0-9]','','g') as int) n from s_members)""",
    "s_verdicts": """
select codebase_id, cluster_id, title, case when n%5=0 then 'centralization-risk' end risk_category,
  case when n%2=0 then 'Guard missing in the withdraw path of the module kept by '||cluster_id end code_evidence,
  severity, pos, case when pos=1 then 'rejected' when n%4=0 then 'confirmed' when n%4=1 then 'plausible'
    else 'rejected' end verdict
from s_clusters, (values (0),(1)) v(pos) where n%4<>3 and (pos=0 or n%7=0)""",
    "e_runs": """
select r.*, t.gt_total,
  case when is_classified then coalesce(c.matched,0) end matched, case when is_classified then coalesce(c.novel,0) end novel,
  case when is_classified then coalesce(c.fp,0) end fp, case when is_classified then coalesce(c.uncertain,0) end uncertain,
  case when is_classified and t.gt_total is not null then coalesce(c.ids,0) else 0 end matched_ids
from s_runs_counted r left join s_gt_total t using (codebase_id) left join (
  select run_id, count(*) filter (category='matched') matched, count(*) filter (category='novel') novel,
    count(*) filter (category='fp') fp, count(*) filter (category='uncertain') uncertain, count(matched_gt_id) ids
  from s_labels group by 1) c using (run_id)""",
    "e_run_metrics": """
select *, case when f1p is null or f1r is null then null when f1p+f1r=0 then 0.0 else 2.0*f1p*f1r/(f1p+f1r) end f1
from (select *, recall f1r, prec f1p from (
  select *, case when gt_total is not null and is_classified then matched::double/gt_total end recall,
    case when gt_total is not null and is_classified and matched+fp>0 then matched::double/(matched+fp) end prec
  from e_runs))""",
    "e_conditions": """
select codebase_id, condition_id, count(*) filter (is_valid) valid_runs, count(*) total_runs,
  any_value(gt_total) gt_total, avg(matched) filter (is_valid and gt_total is not null) avg_matched,
  avg(findings_count) filter (is_valid) avg_findings_count,
  coalesce(sum(fp) filter (is_valid),0)::bigint total_fp,
  coalesce(sum(matched+novel+fp+uncertain) filter (is_valid),0)::bigint total_findings,
  avg(uncertain) filter (is_valid) avg_uncertain, avg(cost_usd) filter (is_valid) avg_cost,
  avg(duration_ms) filter (is_valid) avg_duration_ms
from e_runs group by 1,2""",
    "e_condition_agg": """
select *, avg_matched/gt_total avg_recall, case when valid_runs>0 then total_fp::double/valid_runs end avg_fp,
  case when total_findings>0 then total_fp::double/total_findings end fp_rate from e_conditions""",
    "e_sets": """
select r.codebase_id, r.condition_id, r.run_id, count(distinct matched_gt_id) a
from s_runs r left join s_labels l on l.run_id=r.run_id and matched_gt_id is not null
where r.is_valid and r.is_classified and r.codebase_id in (select codebase_id from s_gt) group by 1,2,3""",
    "e_ids": """
select distinct s.codebase_id, s.condition_id, s.run_id, s.a, matched_gt_id id
from e_sets s join s_labels l on l.run_id=s.run_id where matched_gt_id is not null""",
    "e_shared": """
select x.codebase_id, x.condition_id, x.run_id xr, y.run_id yr, any_value(x.a) xa, any_value(y.a) ya, count(*) i
from e_ids x join e_ids y on x.codebase_id=y.codebase_id and x.condition_id=y.condition_id and x.id=y.id
  and x.run_id<y.run_id group by 1,2,3,4""",
    "e_consistency": """
select s.codebase_id, s.condition_id, case when n>=2 then (coalesce(j,0)+e*(e-1)/2.0)/(n*(n-1)/2.0) end consistency
from (select codebase_id, condition_id, count(*)::double n, count(*) filter (a=0)::double e from e_sets group by 1,2) s
left join (select codebase_id, condition_id, sum(i::double/(xa+ya-i)) j from e_shared group by 1,2) p
using (codebase_id, condition_id)""",
    "e_first_verdicts": """
select codebase_id, cluster_id, arg_min(verdict,pos) verdict, min_by(coalesce(risk_category,'-'),pos) risk
from s_verdicts group by 1,2""",
    "e_novels": """
select codebase_id, condition_id, count(*) unique_bugs_found,
  count(*) filter (verdict='confirmed') confirmed_novels,
  count(*) filter (verdict='confirmed' and risk='-') confirmed_novels_filtered,
  count(*) filter (verdict='plausible') plausible_novels,
  count(*) filter (verdict='plausible' and risk='-') plausible_novels_filtered
from (select distinct codebase_id, condition_id, cluster_id from s_members)
left join e_first_verdicts using (codebase_id, cluster_id) group by 1,2""",
    "e_table": """
select a.*, consistency, coalesce(unique_bugs_found,0) unique_bugs_found,
  coalesce(confirmed_novels,0) confirmed_novels, coalesce(confirmed_novels_filtered,0) confirmed_novels_filtered,
  coalesce(plausible_novels,0) plausible_novels, coalesce(plausible_novels_filtered,0) plausible_novels_filtered
from e_condition_agg a left join e_consistency using (codebase_id, condition_id)
left join e_novels using (codebase_id, condition_id)""",
    "e_cross": """
select condition_id, sum(valid_runs)::bigint valid_runs,
  sum(avg_matched) filter (avg_recall is not null)/sum(gt_total) filter (avg_recall is not null) avg_recall,
  (sum(gt_total) filter (avg_recall is not null))::bigint gt_total, sum(confirmed_novels)::bigint confirmed_novels,
  sum(confirmed_novels_filtered)::bigint confirmed_novels_filtered,
  sum(plausible_novels_filtered)::bigint plausible_novels_filtered,
  case when sum(total_findings)>0 then sum(total_fp)::double/sum(total_findings) end fp_rate,
  avg(consistency) consistency,
  sum(avg_cost*valid_runs)/sum(valid_runs) filter (avg_cost is not null) avg_cost,
  sum(avg_duration_ms*valid_runs)/sum(valid_runs) filter (avg_duration_ms is not null) avg_duration_ms
from e_table group by 1""",
    "e_found": """
select distinct l.codebase_id, l.condition_id, l.run_id, matched_gt_id gt_id
from s_labels l where is_valid and matched_gt_id is not null""",
    "e_missed": """
select g.* from s_gt g where not exists
  (select 1 from e_found f where f.codebase_id=g.codebase_id and f.gt_id=g.gt_id)""",
    "s_numbers": """
select codebase_id, condition_id, run_id, is_valid,
  row_number() over (partition by codebase_id, condition_id order by ts, run_id) run_number from s_runs""",
    "s_valid_counts": """
select codebase_id, condition_id, count(*) filter (is_valid) valid_runs from s_runs group by 1,2""",
}


def _duck(pattern: str) -> str:
    return "'" + pattern + "'"


def _has(column: str, *patterns: str) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, {_duck(x)})" for x in patterns) + ")"


def _part(column: str, pattern: str, index: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {_duck(pattern)}, {index}), '')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


_KEYWORD = f"{_list(p.REPORT_KEYWORDS)}[1+(doc_id+i)%14]"
_CONTRACT = f"{_list(p.REPORT_CONTRACTS)}[1+(doc_id*3+i)%5]"
_FUNCTION = f"{_list(p.REPORT_FUNCTIONS)}[1+(doc_id+i*2)%5]"
_SEVERITY = f"{_list(p.REPORT_SEVERITIES)}[1+(doc_id+i)%5]"
_TITLE = (
    f"{_KEYWORD}||case (doc_id+i)%3 when 0 then ' in '||{_CONTRACT}||'.'||{_FUNCTION}"
    f" when 1 then ' in `'||{_FUNCTION}||'()`' else ' of part '||i end"
)
_BARE = dict(p.BARE_HEADERS)
_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)"


def keyword_sql(title: str) -> str:
    return "case " + " ".join(f"when {_has(title, x)} then '{n}'" for n, x in p.KEYWORD_RULES) + " else 'other' end"


def slug_sql(title: str) -> str:
    words = (
        f"list_filter(string_split_regex(lower(regexp_replace({title}, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+'),"
        " lambda w: length(w)>2)"
    )
    return f"coalesce(nullif(array_to_string(({words})[1:4], '-'), ''), 'unknown')"


def words_sql(text: str) -> str:
    return (
        f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+'),"
        " lambda w: length(w)>2)"
    )


def location_sql(title: str, explicit: str) -> str:
    contract, function = _part(explicit, p.SOURCE_FILE), _part(title, p.CALLED_FUNCTION)
    return (
        f"coalesce({_part(title, p.DOTTED_NAME, 1)}||'.'||{_part(title, p.DOTTED_NAME, 2)},"
        f" {contract}||'.'||{function}, {contract}, {function}, {_part(title, p.NAMED_FUNCTION)})"
    )


def root_cause_sql(title: str, location: str) -> str:
    contract = f"lower(split_part({location}, '.', 1))"
    function = f"nullif(lower(split_part({location}, '.', 2)), '')"
    return (
        f"case when {location} is null then 'unknown::'||{slug_sql(title)}"
        f" when {function} is not null then {contract}||'::'||{function}||'::'||{keyword_sql(title)}"
        f" when {keyword_sql(title)}<>'other' then {contract}||'::'||{keyword_sql(title)}"
        f" else {contract}||'::'||{slug_sql(title)} end"
    )


VIEWS |= {
    "r_items": """
select doc_id, text, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1)-1 i
from documents""",
    "r_reports": f"""
select doc_id run_id, case when doc_id%10=9 then any_value(text) else
  case when doc_id%20=0 then '🔐 Security Review'||chr(10)||chr(10) when doc_id%20=7 then '## High Severity'||chr(10) else '' end||
  string_agg(case when i%12=2 then '## '||{_CONTRACT}||'.sol'||chr(10) when i%20=6 then '## Medium Severity'||chr(10)
      when i%28=10 then '## Summary'||chr(10) when i%16=3 then '### Possible '||{_KEYWORD}||' risk'||chr(10) else '' end||
    case when i%4<>0 then '' else case doc_id%10
      when 0 then '['||(40+i%60)||'] **'||((i//4)%3+1)||'. '||{_TITLE}||'**'||
        case when i%8=0 then chr(10)||'`'||{_CONTRACT}||'.'||{_FUNCTION}||'` · Confidence: 80' else '' end
      when 1 then '### ['||{_SEVERITY}||'] '||{_TITLE}||case when i%8=0 then ' — '||{_CONTRACT}||'.sol:'||i else '' end
      when 2 then '### '||left({_SEVERITY},1)||'-'||i||': '||{_TITLE}
      when 3 then '## ['||left({_SEVERITY},1)||'-'||i||'] '||{_TITLE}
      when 4 then '### '||i||'. '||{_TITLE}||' — **'||{_SEVERITY}||'**'
      when 5 then '#### '||i||'. '||{_TITLE}||' ('||lower({_SEVERITY})||')'
      when 6 then '**'||i||'. ['||{_SEVERITY}||'] '||{_TITLE}||'**'
      when 7 then '### '||i||'. '||{_TITLE}
      else '## ['||(40+i%60)||'] '||i||'. '||{_TITLE} end||chr(10) end||
    case when i%12=1 then '```'||chr(10)||l||chr(10)||'```' else l end, chr(10) order by i)||
  chr(10)||'| Critical | 2 | open |'||chr(10)||'| High | Vault | Reentrancy |'||chr(10)||'| 3 | [95] | Reentrancy |' end as text
from r_items group by doc_id""",
    "r_lines": f"""
select run_id, line_no, raw, trim(raw, {_SPACES}) line from (
  select run_id, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1)-1 line_no
  from r_reports)""",
    "r_formats": f"""
select r.run_id, case when contains(text, '{p.SKILL_MARKER}') then 'skill'
    when {_has('text', *p.BARE_MARKERS)} or ({_has('text', p.SEVERITY_SECTION)} and {_has('text', p.NUMBERED_HEADING)})
    then 'bare' when l.run_id is not null then 'skill' else 'bare' end hint,
  contains(text, '{p.SKILL_MARKER}') or {_has('text', *p.BARE_MARKERS)}
    or ({_has('text', p.SEVERITY_SECTION)} and {_has('text', p.NUMBERED_HEADING)}) or l.run_id is not null sure
from r_reports r left join (select distinct run_id from r_lines where {_has('line', p.SKILL_FINDING)}) l using (run_id)""",
    "r_marks": f"""
select l.*, {_has('line', p.SEVERITY_SECTION)} is_severity,
  {_has('line', p.CONTRACT_SECTION)} and not {_has('line', p.SEVERITY_SECTION)} is_contract
from r_lines l join r_formats f using (run_id) where hint='bare'""",
    "r_state": f"""
select *, nullif(last_value(mark ignore nulls) over w, '') section_severity, last_value(owner ignore nulls) over w section_contract
from (select *, case when is_severity then case upper(regexp_extract(line, '(?i)(Critical|High|Medium|Low|Informational|Info)', 1))
      when 'CRITICAL' then 'HIGH' else upper(regexp_extract(line, '(?i)(Critical|High|Medium|Low|Informational|Info)', 1)) end
    when not is_contract and {_has('line', p.SECTION_RESET)} then '' end mark,
  case when is_contract then {_part('line', p.CONTRACT_SECTION)} end as owner from r_marks)
window w as (partition by run_id order by line_no rows between unbounded preceding and current row)""",
    "r_kinds": f"""
select *, case when is_severity or is_contract then null
  {" ".join(f"when {_has('line', x)}{' and section_severity is not null' if n == 'section' else ''} then '{n}'"
            for n, x in p.BARE_HEADERS)} end kind from r_state""",
    "r_bare": f"""
select run_id, line_no, kind, section_severity, section_contract,
  row_number() over (partition by run_id order by line_no) as idx,
  case kind when 'word' then upper({_part('line', _BARE['word'])}) when 'trailing' then upper({_part('line', _BARE['trailing'], 2)})
    when 'paren' then upper({_part('line', _BARE['paren'], 2)}) when 'inline' then upper({_part('line', _BARE['inline'])})
    when 'section' then section_severity when 'confidence' then '['||{_part('line', _BARE['confidence'])}||']'
    else case upper(case kind when 'prefix' then {_part('line', _BARE['prefix'])} else {_part('line', _BARE['bracket'])} end)
      when 'C' then 'CRITICAL' when 'H' then 'HIGH' when 'M' then 'MEDIUM' when 'L' then 'LOW' when 'I' then 'INFO' end end severity,
  trim(case kind {" ".join(f"when '{n}' then {_part('line', x, 1 if n in ('trailing', 'paren', 'section') else 2)}"
                           for n, x in p.BARE_HEADERS)} end, {_SPACES}) title,
  case kind {" ".join(f"when '{n}' then {_part('line', _BARE[n], 3)}" for n in ('word', 'prefix', 'bracket', 'inline'))} end explicit
from r_kinds where kind is not null""",
    "r_near": f"""
select l.run_id, l.line_no, arg_min({_part('m.line', p.SKILL_LOCATION)}, m.line_no) stated
from r_lines l join r_lines m on m.run_id=l.run_id and m.line_no between l.line_no+1 and l.line_no+3
where {_has('l.line', p.SKILL_FINDING)} and {_has('m.line', p.SKILL_LOCATION)} group by 1,2""",
    "r_heads": f"""
select l.run_id, l.line_no, {_part('line', p.SKILL_FINDING, 2)}::int as idx, {_part('line', p.SKILL_FINDING)}::int confidence,
  null severity, trim({_part('line', p.SKILL_FINDING, 3)}, {_SPACES}) title, n.stated, null explicit, null section_contract
from r_lines l join r_formats f using (run_id) left join r_near n on n.run_id=l.run_id and n.line_no=l.line_no
where hint='skill' and {_has('line', p.SKILL_FINDING)}
union all select run_id, line_no, idx, null, severity, title, null, explicit, section_contract from r_bare""",
    "r_located": f"""
select *, case when stated is not null then stated when own is null then section_contract
  when not contains(own,'.') and section_contract is not null then section_contract||'.'||own else own end location
from (select *, {location_sql('title', 'explicit')} own from r_heads)""",
    "r_stops": f"""
select h.run_id, h.line_no, min(m.line_no) stop from r_heads h join r_lines m on m.run_id=h.run_id
  and m.line_no between h.line_no+1 and h.line_no+{p.DESCRIPTION_LINES} where {_has('m.line', p.DESCRIPTION_STOP)} group by 1,2""",
    "r_bodies": f"""
select h.run_id, h.line_no, trim(regexp_replace(coalesce(string_agg(m.line, ' ' order by m.line_no),''), {_duck(p.CODE_FENCE)}, '', 'g'), {_SPACES}) body
from r_heads h left join r_stops s on s.run_id=h.run_id and s.line_no=h.line_no
left join r_lines m on m.run_id=h.run_id and m.line_no between h.line_no+1 and least(coalesce(s.stop-1, h.line_no+{p.DESCRIPTION_LINES}), h.line_no+{p.DESCRIPTION_LINES})
  and m.line<>'' and not {_has('m.line', p.DESCRIPTION_SKIP)} group by 1,2""",
    "r_findings": f"""
select l.run_id, l.line_no, l.idx, l.title, l.confidence, l.severity, l.location, {root_cause_sql('l.title', 'l.location')} root_cause,
  {keyword_sql('l.title')} vuln_type, case when length(body)>300 then substr(body,1,297)||'...' else body end description
from r_located l join r_bodies b on b.run_id=l.run_id and b.line_no=l.line_no""",
    "r_parsed": "select run_id, count(*) n, max(line_no) as last from r_findings group by 1",
    "r_above": f"""
select distinct l.run_id, l.line_no from r_lines l join r_lines m on m.run_id=l.run_id
  and m.line_no between l.line_no-{p.SEVERITY_ABOVE_LINES} and l.line_no-1
where {_has('l.line', p.NUMBERED_LINE)} and {_has('m.line', p.SEVERITY_ABOVE)}""",
    "r_estimates": f"""
select r.run_id, case when skill>0 then skill else likely end estimate from (
  select run_id, len(regexp_extract_all(text, {_duck(p.SKILL_HEADER_START)})) skill from r_reports) r join (
  select l.run_id, count(*) filter ((line like '#%' or line like '**%') and not {_has('line', *p.NOT_A_FINDING)}
    and ({_has('line', *p.FINDING_LIKE)} or a.run_id is not null)) likely
  from r_lines l left join r_above a on a.run_id=l.run_id and a.line_no=l.line_no group by 1) x using (run_id)""",
    "r_reported": f"""
select f.run_id, case hint when 'skill' then max({_part('line', p.SKILL_TABLE_ROW)}::int) filter ({_has('line', p.SKILL_TABLE_ROW)})
  else sum(case when {_has('line', p.SUMMARY_COUNT_ROW)} then {_part('line', p.SUMMARY_COUNT_ROW, 2)}::bigint else 1 end)
    filter ({_has('line', p.SUMMARY_ROW)}) end::bigint reported_count
from r_lines join r_formats f using (run_id) group by f.run_id, hint""",
    "r_results": """
select f.run_id, case when sure or p.n is not null then hint else 'unknown' end format, coalesce(p.n,0) parsed,
  case when sure or p.n is not null then reported_count end reported_count, greatest(estimate, coalesce(p.n,0)) raw_finding_estimate
from r_formats f left join r_parsed p using (run_id) join r_estimates using (run_id) join r_reported using (run_id)""",
    "r_blocks": f"""
select * from (select *, case when {_has('line', p.BLOCK_HEADING)} then regexp_replace(line, '^#{{2,4}}\\s+', '')
    else regexp_replace(regexp_replace(line, '^\\*\\*', ''), '\\*\\*\\s*$', '') end heading
  from r_lines where {_has('line', p.BLOCK_HEADING, p.BLOCK_BOLD)}) where not {_has('heading', *p.NOT_A_BLOCK)}""",
    "r_block_lines": f"""
select b.run_id, b.line_no, b.line head, b.heading, m.line_no place, m.line body,
  coalesce(max({_has('m.line', p.BLOCK_STOP)}::int) over (partition by b.run_id, b.line_no order by m.line_no), 0) stopped
from r_blocks b left join r_lines m on m.run_id=b.run_id and m.line_no between b.line_no+1 and b.line_no+{p.BLOCK_LINES - 1}""",
    "r_block_texts": """
select run_id, line_no, head, any_value(heading) heading,
  head||coalesce(' '||string_agg(body, ' ' order by place) filter (stopped=0), '') block,
  head||coalesce(chr(10)||string_agg(body, chr(10) order by place) filter (stopped=0 and place<=line_no+2 and body<>''), '') snippet
from r_block_lines group by 1,2,3""",
    "r_unmatched": f"""
select b.run_id, b.line_no, snippet, row_number() over (partition by b.run_id order by b.line_no) block_no
from (select *, {words_sql('heading')} words from r_block_texts where {_has('block', p.SIGNAL_WORDS)}) b
left join (select run_id, list({words_sql('title')}) titles from r_findings group by 1) t using (run_id)
where len(list_filter(coalesce(titles, []), lambda x: len(list_filter(words, lambda w: list_contains(x, w)))>=2))=0""",
}

VIEWS |= {
    "k_events": """
select user_id run_id, event_id seq, event_id%7 tid, event_type kind, value, user_id from events
where not (event_type='error' and event_id%9 in (0,1))""",
    "k_uses": """
select run_id, seq, tid, ['Agent','Read','Skill','Bash'][1+seq%4] tool from k_events where kind='click'""",
    "k_results": """
select run_id, seq, tid, value>15 is_error, case when seq%499=0 then 'big' when seq%2=0 then 'bundle'
  when seq%89=0 then 'marker' else 'parts' end shape from k_events where kind='view'""",
    "k_bound": """
select r.*, a.seq use_seq from k_results r asof join (select * from k_uses where tool='Agent') a
  on r.run_id=a.run_id and r.tid=a.tid and r.seq>a.seq""",
    "k_last": """
select run_id, tid, use_seq, arg_max(is_error, seq) err, arg_max(case shape when 'bundle' then 1+seq%15 when 'parts' then 3
  else 1 end, seq) lines from k_bound group by 1,2,3""",
    "k_spans": """
select u.run_id, 't'||u.tid tool_use_id, u.seq, 'scan '||u.seq description, case when u.seq%3=0 then 'small' else 'default' end model,
  l.run_id is not null returned, coalesce(l.err,false) returned_error, coalesce(l.lines,0)::int return_lines
from k_uses u left join k_last l on l.run_id=u.run_id and l.tid=u.tid and l.use_seq=u.seq where tool='Agent'""",
    "k_names": "select run_id, tid, arg_max(tool, seq) tool from k_uses group by 1,2",
    "k_errors": """
select r.run_id, r.seq, coalesce(n.tool,'unknown') tool, substr(case shape when 'big' then repeat('x',50010)
  when 'bundle' then 'agent-'||(seq%4)||'-bundle: '||((seq%3)*100)||' lines'||repeat(chr(10)||'row', (seq%15)::int)
  when 'marker' then '<persisted-output> too large' else 'part '||seq||chr(10)||'next  end' end, 1, 200) error
from k_results r left join k_names n using (run_id, tid) where is_error""",
    "k_bundles": """
select run_id, 'agent-'||(seq%4)||'-bundle' bundle, arg_max((seq%3)*100, seq) lines, bool_or(seq%3=0) was_empty
from k_results where shape='bundle' group by 1,2""",
    "k_runs": """
select distinct user_id run_id, user_id%4 codebase_id, 'cb'||(user_id%4) condition_id,
  case when user_id%2=0 then 'skill' else 'bare' end as mode,
  case when user_id%5=0 then 143 when user_id%7=0 then 1 else 0 end exit_code, user_id%3=0 timed_out,
  case when user_id%8=0 then 12 else 4 end expected,
  case when user_id%10<>9 then user_id%100 end output_lines from events""",
    "k_facts": """
select r.*, coalesce(e.n,0) events, coalesce(e.inits,0) inits, coalesce(e.results,0)>0 done, e.stop_reason,
  coalesce(e.skills,0) skill_calls, case when e.first_init%50=0 then 'auditor' end leaked,
  coalesce(a.agents,0) agents, coalesce(a.ret,0) ret, coalesce(a.failed,0) failed, coalesce(a.thin,0) thin,
  coalesce(b.bundles,0) bundles, coalesce(b.empty_now,0) empty_now, coalesce(b.was,0) was, coalesce(x.n,0) tool_errors,
  sc.in_scope_files, sc.files_read, sc.in_scope_read, sc.out_of_scope_read, coalesce(om.n,0) mentions
from k_runs r left join k_compliance sc using (run_id) left join (select run_id, count(*) n from k_mentions group by 1) om using (run_id) left join (select run_id, count(*) n, count(*) filter (kind='signup') inits,
    count(*) filter (kind='purchase') results, count(*) filter (kind='click' and seq%4=2) skills,
    min(seq) filter (kind='signup') first_init,
    case when min(seq) filter (kind='purchase')%5=0 then 'max_turns' else 'end_turn' end stop_reason from k_events group by 1) e using (run_id)
left join (select run_id, count(*) agents, count(*) filter (returned) ret, count(*) filter (returned_error) failed,
    count(*) filter (returned and not returned_error and return_lines<10) thin from k_spans group by 1) a using (run_id)
left join (select run_id, count(*) bundles, count(*) filter (lines=0) empty_now, count(*) filter (was_empty) was
    from k_bundles group by 1) b using (run_id)
left join (select run_id, count(*) n from k_errors group by 1) x using (run_id)""",
    "k_checks": """
select run_id, unnest(['exit_code','not_timed_out','has_events','has_result','stop_reason','agents_spawned','agents_all_returned',
    'agents_no_errors','agents_result_quality','no_skill_calls','bare_no_skill_visible','bundle_quality','has_output',
    'scope_no_oos_findings','scope_in_scope_read']) as "check",
  unnest([exit_code=0 or (exit_code=143 and done), not (timed_out and not done), events>0, done, stop_reason='end_turn',
    agents>=expected, ret=agents, failed=0, thin=0, skill_calls=0, leaked is null, empty_now=0,
    coalesce(output_lines>=case when mode='skill' then 50 else 10 end, false), mentions=0, in_scope_read>0]) ok,
  unnest([exit_code::varchar, case when timed_out and not done then 'timed out' when timed_out then 'killed after completion'
      else 'completed in time' end, events::varchar, case when done then stop_reason else 'no result event' end, stop_reason,
    agents||'/'||expected, ret||'/'||agents, failed::varchar, thin::varchar, skill_calls::varchar, coalesce(leaked,'none'),
    empty_now::varchar, coalesce(output_lines::varchar,'no stdout file'), mentions::varchar,
    in_scope_read||'/'||in_scope_files||' in scope, '||files_read||' in total']) detail,
  unnest([true,true,true,true,done,mode='skill',mode='skill',mode='skill',mode='skill',mode<>'skill',mode='bare' and inits>0,
    mode='skill' and bundles>0,true,in_scope_files is not null,in_scope_files is not null]) applies from k_facts""",
    "k_oos_names": """
select distinct codebase_id, replace(split_part(path,'/',-1),'.sol','') "name" from k_scope
where not in_scope and path like '%.sol' and length(replace(split_part(path,'/',-1),'.sol',''))>4
  and replace(split_part(path,'/',-1),'.sol','') not in ('Errors','Utils','Base','Common','Constants','Types','Events',
    'Helpers','Math','SafeMath','Context','Storage','Proxy','Test')""",
    "k_mentions": r"""
select run_id, "name" from r_reports r join k_oos_names n on n.codebase_id=r.run_id%4
where regexp_matches(text, '(?i)\b'||"name"||'\.sol\b') or regexp_matches(text, '(?i)\bcontract\s+'||"name"||'\b')
  or regexp_matches(text, '(?i)\bfinding[^\n]*\b'||"name"||'\b')""",
    "k_compliance": """
select r.run_id, r.codebase_id, r.mode, l.n in_scope_files, coalesce(c.files_read,0) files_read,
  coalesce(c.i,0) in_scope_read, coalesce(c.o,0) out_of_scope_read, coalesce(c.i,0)>0 ok
from k_runs r join (select codebase_id, count(*) n from k_scope where in_scope group by 1) l using (codebase_id)
left join (select run_id, count(*) files_read, count(*) filter (i) i, count(*) filter (o) o from (
  select k.run_id, k.path, bool_or(in_scope) i, bool_or(not in_scope) o from k_reads k
  left join k_scope s on s.codebase_id=k.run_id%4 and s.path=k.path group by 1,2) group by 1) c using (run_id)""",
    "k_scope": """
select distinct p_size%4 codebase_id, case when p_partkey%2=0 then 'contracts/' else 'lib/contracts/' end||
  ['F1','F2','F12','F31','Vault','Router','TokenSale','Errors','PriceOracle','Bridge','Ledger'][1+p_partkey%11]||
  case when p_partkey%13=0 then '.md' else '.sol' end path, (p_size+p_partkey)%3=0 in_scope from part""",
    "k_reads": """
select distinct run_id, case when seq%3=0 then 'contracts/F'||(seq%50)||'.sol' else 'contracts/F'||(seq%50)||'.sol' end path
from k_uses where tool='Read' and seq%5<>0""",
}


def word_set_sql(title: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({title}), '[^a-z0-9]+', ' ', 'g'), ' '),"
        " lambda w: w<>'')))"
    )


def jaccard_sql(x: str, y: str) -> str:
    shared = f"len(list_intersect({x}, {y}))"
    return f"({shared}::double/(len({x})+len({y})-{shared}))"


VIEWS |= {
    "r_truth": f"""
select s_suppkey%4 codebase_id, s_suppkey gt_id, {_list(p.REPORT_CONTRACTS)}[1+s_suppkey%5] contract,
  {_list(p.REPORT_KEYWORDS)}[1+s_suppkey%14]||' in '||{_list(p.REPORT_CONTRACTS)}[1+s_suppkey%5]||'.'||
  {_list(p.REPORT_FUNCTIONS)}[1+s_suppkey%3] title, case when s_suppkey%3=0 then 'high' end severity,
  'reported by '||s_name description from supplier where s_suppkey%4<>3""",
    "r_owned": """
select f.*, run_id%4 codebase_id, 'cond'||(run_id%3) condition_id from r_findings f""",
    "r_word_sets": f"""
select distinct codebase_id, {word_set_sql('title')} words from r_owned""",
    "r_best": f"""
select codebase_id, words, arg_min(gt_id, (-round(score, 12), gt_id)) gt_id from (
  select w.codebase_id, w.words, g.gt_id, {jaccard_sql('w.words', 'g.gw')} score
  from r_word_sets w join (select *, {word_set_sql('title')} gw from r_truth) g using (codebase_id))
where score>=0.5-1e-9 group by 1,2""",
    "r_causes": f"""
select codebase_id, lower(contract) contract, {keyword_sql('title')} vuln_type, min(gt_id) gt_id from r_truth
where {keyword_sql('title')}<>'other' group by 1,2,3""",
    "g_inputs": """
select codebase_id, run_id, condition_id, finding_index, title, reasoning, part_id from s_labels
where category in ('novel','uncertain')""",
    "g_old": "select * from s_members where condition_id in ('1-URGENT','2-HIGH')",
    "g_new": """
select *, (n-1)//5 chunk_no, (n-1)%5+1 member_index from (
  select *, row_number() over (partition by codebase_id order by run_id, finding_index) n from g_inputs
  where condition_id not in ('1-URGENT','2-HIGH'))""",
    "g_asked": """
select *, case part_id%4 when 0 then 'new' when 1 then 'Brand#'||(1+part_id%25) when 2 then 'unknown-'||(part_id%5) end assign_to,
  case when part_id%8=0 then 'Opened for '||(part_id%16) end new_title,
  case when part_id%8=0 then 'because' end new_reasoning, case when part_id%8=0 then 'high' end new_severity
from g_new where part_id%4<>3""",
    "g_placed": """
select a.*, case when k.cluster_id is not null then assign_to else 'novel-'||substr(sha256(
    case when assign_to='new' then coalesce(new_title,title) else title end||
    case when assign_to='new' then coalesce(new_reasoning,reasoning) else reasoning end),1,8) end cluster_id,
  k.cluster_id is null is_new
from g_asked a left join (select distinct codebase_id, cluster_id from s_clusters) k on k.codebase_id=a.codebase_id and k.cluster_id=a.assign_to""",
    "g_titled": """
select *, list_sort(list_concat(['weak','group','g'||case when part_id%30=29 then part_id//3 else (part_id+1)//3 end],
  case when part_id%7=3 then ['again'] else [] end)) words from g_inputs""",
    "g_keyed": """
select *, 'c:k'||(part_id//3) a, 'w:'||array_to_string(words,' ') b from g_titled""",
    "g_tokens": """
select codebase_id, words, unnest(words) token from (select distinct codebase_id, words from g_titled)""",
    "g_near": f"""
select distinct t.codebase_id, 'w:'||array_to_string(t.words,' ') a, 'w:'||array_to_string(h.head,' ') b
from g_tokens t join (select codebase_id, token, min(words) head from g_tokens group by 1,2) h using (codebase_id, token)
where t.words<>h.head and {jaccard_sql('t.words', 'h.head')}>=0.7-1e-9""",
}


def with_views(query: str) -> str:
    """Prefix the query with the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z]+_[a-z0-9_]+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    return "with " + ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed) + "\n" + query


def six(column: str, digits: int = 6) -> str:
    """Round half up in plain double arithmetic, the same as ``functions.numbers.half_up``."""
    scale = f"1e{digits}"
    return f"floor(({column})*{scale}+0.5)/{scale}"


def sixes(*columns: str) -> str:
    """A select list of columns rounded to six digits under their own names."""
    return ", ".join(f"{six(c)} {c}" for c in columns)
