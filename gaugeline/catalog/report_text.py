"""Registered queries for text extraction (B) over whole report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.catalog.oracle_views import keyword_sql, six, slug_sql
from gaugeline.catalog.registry import Registry, rounded
from gaugeline.functions import text
from gaugeline.operators import extraction
from gaugeline.plans import standins as s
from gaugeline.session import cut_lineage

register = Registry()


def _findings(t):
    return extraction.extract_findings(s.reports(t))


@register("b0_line_table", "select run_id, line_no, line from r_lines")
def line_table(t):
    return extraction.line_table(s.reports(t)).select("run_id", "line_no", "line")


@register("b1_detect_format", "select run_id, format from r_results")
def detect_format(t):
    return extraction.detect_format(s.reports(t))


@register("b2_extract_skill_findings", """
select f.run_id, idx, title, confidence from r_findings f join r_formats using (run_id) where hint='skill'""")
def extract_skill_findings(t):
    found = extraction.extract_skill_findings(s.reports(t))
    return found.select("run_id", F.col("index").alias("idx"), "title", "confidence")


@register("b3_extract_bare_findings", "select run_id, line_no, idx, title, severity from r_bare")
def extract_bare_findings(t):
    found = extraction.extract_bare_findings(s.reports(t))
    return found.select("run_id", "line_no", F.col("index").alias("idx"), "title", "severity")


def _sections(t):
    bare = extraction.candidate_lines(s.reports(t)).filter("format_hint = 'bare' and line like '#%'")
    return extraction.section_state(bare)


@register("b4_section_severity", "select run_id, line_no, section_severity from r_state where line like '#%'")
def section_severity(t):
    return _sections(t).select("run_id", "line_no", "section_severity")


@register("b5_section_contract", "select run_id, line_no, section_contract from r_state where line like '#%'")
def section_contract(t):
    return _sections(t).select("run_id", "line_no", "section_contract")


@register("b6_finding_location", "select run_id, line_no, location from r_findings")
def finding_location(t):
    return _findings(t).select("run_id", "line_no", "location")


@register("b7_classify_keyword", f"select run_id, line_no, {keyword_sql('line')} keyword from r_lines")
def classify_keyword(t):
    lines = extraction.line_table(s.reports(t))
    return lines.select("run_id", "line_no", text.classify_keyword(F.col("line")).alias("keyword"))


@register("b8_title_slug", f"select run_id, line_no, {slug_sql('line')} slug from r_lines")
def title_slug(t):
    lines = extraction.line_table(s.reports(t))
    return lines.select("run_id", "line_no", text.title_slug(F.col("line")).alias("slug"))


@register("b9_root_cause_key", "select run_id, line_no, root_cause, vuln_type from r_findings")
def root_cause_key(t):
    return _findings(t).select("run_id", "line_no", "root_cause", "vuln_type")


@register("b10_finding_description", "select run_id, line_no, description from r_findings")
def finding_description(t):
    return _findings(t).select("run_id", "line_no", "description")


@register("b11_reported_count", "select run_id, reported_count from r_reported where reported_count is not null")
def reported_count(t):
    counts = extraction.reported_count(s.reports(t))
    return counts.filter("reported_count is not null")


@register("b12_estimate_raw_findings", "select run_id, estimate from r_estimates")
def estimate_raw_findings(t):
    return extraction.estimate_raw_findings(s.reports(t))


@register("b13_unmatched_blocks", "select run_id, line_no, snippet, block_no from r_unmatched where block_no<=10")
def unmatched_blocks(t):
    return extraction.unmatched_blocks(s.reports(t), _findings(t))


@register("b14_parser_coverage", f"""
select run_id, format, parsed, reported_count, raw_finding_estimate,
  case when raw_finding_estimate>0 then {six('parsed::double/raw_finding_estimate')} end parser_coverage from r_results""")
def parser_coverage(t):
    return rounded(extraction.parse_results(s.reports(t)), "parser_coverage")


@register("b15_finding_context", """
select f.run_id, f.line_no "position", f.idx, coalesce((select string_agg(m.raw, chr(10) order by m.line_no) from r_lines m
    where m.run_id=f.run_id and m.line_no between h.first_no and h.first_no+39), f.title) context
from r_findings f left join (select f.run_id, f.line_no, min(l.line_no) first_no
  from r_findings f join r_lines l on l.run_id=f.run_id
    and contains(regexp_replace(l.raw,'[`*]','','g'), substr(regexp_replace(f.title,'[`*]','','g'),1,20))
  group by 1,2) h on h.run_id=f.run_id and h.line_no=f.line_no""")
def finding_context(t):
    reports = s.reports(t)
    found = extraction.finding_context(reports, extraction.extract_findings(reports))
    return found.select("run_id", "position", F.col("index").alias("idx"), "context")


@register("b16_assistant_text", """
select conv_id run_id, turn//1000 as page, string_agg(text, chr(10) order by turn) as text from conversations
where role='assistant' and text<>'' group by 1,2""")
def assistant_text(t):
    spoken = t.conversations.filter("role = 'assistant'").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.lit(0).alias("pos"), "text"
    )
    return extraction.assistant_text(spoken)


@register("b17_recovered_findings", """
select run_id, line_no "position", idx, title, severity, location, root_cause, false recovered from r_findings
union all
select u.run_id, coalesce(p.last,-1)+block_no, coalesce(p.n,0)+block_no, 'Recovered: '||split_part(snippet, chr(10), 1), null, 'Unknown',
  'Unknown::logic-error', true
from r_unmatched u left join r_parsed p using (run_id) where block_no<=10""")
def recovered_findings(t):
    """Every unmatched block answered as one recovered finding."""
    reports = s.reports(t)
    findings = cut_lineage(extraction.extract_findings(reports))
    answers = extraction.unmatched_blocks(reports, findings).select(
        "run_id",
        (F.col("block_no") - 1).alias("position"),
        F.concat(F.lit("Recovered: "), F.split("snippet", "\n")[0]).alias("title"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("location"),
        F.lit("Logic  Error").alias("vulnerability_type"),
        F.lit("").alias("description"),
    )
    return extraction.recovered_findings(findings, answers).select(
        "run_id", "position", F.col("index").alias("idx"), "title", "severity", "location", "root_cause", "recovered"
    )


@register("b18_narrative_number_check", """
select o_orderkey narrative_id, 'cost' kind, (o_orderkey%300)+0.5 "value" from orders where (o_orderkey%300)+0.5>100
union all select o_orderkey, 'percentage', (o_orderkey%140)::double from orders where o_orderkey%140>100""")
def narrative_number_check(t):
    text_column = F.format_string("Recall was %d%% at $%d.5 per run.", F.col("o_orderkey") % 140, F.col("o_orderkey") % 300)
    return extraction.narrative_number_check(
        t.orders.select(F.col("o_orderkey").alias("narrative_id"), text_column.alias("text"))
    )
