"""Findings out of report texts.

One pass over each text keeps only its candidate lines (headings, bold items, bracketed items, table rows), each
with the lines that follow it, so descriptions and locations need no join back to the text. Running state (severity
and contract sections) is a window over the few candidate lines of one text; a text is a single cell, so such a
window is never larger than the cell it came from.

Input: reports(run_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import report_patterns as p
from gaugeline.functions.numbers import cut_text, ratio
from gaugeline.functions.text import (
    classify_keyword,
    group,
    long_words,
    matches_any,
    root_cause_key,
    taken_until,
    title_location,
    title_slug,
    trimmed,
)

CANDIDATE = r"^(#|\*\*|\[|\|)"


def line_table(reports: DataFrame) -> DataFrame:
    """Every line of every text with its 0-based number, raw and trimmed."""
    return reports.select("run_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn(
        "line", trimmed(F.col("raw"))
    )


def header_format(text: Column) -> Column:
    """'skill' or 'bare' from the markers of the whole text, null when neither shows."""
    sectioned = text.rlike(p.SEVERITY_SECTION) & text.rlike(p.NUMBERED_HEADING)
    return F.when(text.contains(p.SKILL_MARKER), "skill").when(matches_any(text, p.BARE_MARKERS) | sectioned, "bare")


def _lines_of(reports: DataFrame) -> DataFrame:
    return reports.select(
        "run_id",
        header_format(F.col("text")).alias("header_format"),
        F.regexp_count("text", F.lit(p.SKILL_HEADER_START)).alias("skill_headers"),
        F.transform(F.split("text", "\n"), trimmed).alias("lines"),
    )


def candidate_lines(reports: DataFrame) -> DataFrame:
    """Candidate lines with the 19 lines after each and whether a severity heading stands in the 20 lines before.

    A text without candidates keeps one row with a null line.
    """

    def candidate(line: Column, index: Column) -> Column:
        above = F.slice(
            F.col("lines"),
            F.greatest(index - p.SEVERITY_ABOVE_LINES, F.lit(0)) + 1,
            F.least(index, F.lit(p.SEVERITY_ABOVE_LINES)),
        )
        numbered = line.rlike(p.NUMBERED_LINE)
        return F.when(
            line.rlike(CANDIDATE),
            F.struct(
                index.alias("line_no"),
                line.alias("line"),
                F.when(~line.startswith("|"), F.slice(F.col("lines"), index + 2, F.lit(p.DESCRIPTION_LINES))).alias(
                    "after"
                ),
                (numbered & F.exists(above, lambda one: one.rlike(p.SEVERITY_ABOVE))).alias("severity_above"),
            ),
        )

    skill_line = F.exists("lines", lambda line: line.rlike(p.SKILL_FINDING))
    hint = F.coalesce("header_format", F.when(skill_line, "skill").otherwise("bare"))
    return (
        _lines_of(reports)
        .select(
            "run_id",
            "header_format",
            hint.alias("format_hint"),
            "skill_headers",
            F.explode_outer(F.array_compact(F.transform("lines", candidate))).alias("c"),
        )
        .select("run_id", "header_format", "format_hint", "skill_headers", "c.*")
    )


def _order() -> Window:
    return Window.partitionBy("run_id").orderBy("line_no")


def section_state(candidates: DataFrame) -> DataFrame:
    """Running severity and contract of the section each line stands in."""
    line = F.col("line")
    words = [group(line, p.SEVERITY_SECTION, index) for index in range(1, 6)]
    word = F.upper(F.coalesce(*words))
    is_severity = line.rlike(p.SEVERITY_SECTION)
    is_contract = ~is_severity & line.rlike(p.CONTRACT_SECTION)
    is_reset = ~is_severity & ~is_contract & line.rlike(p.SECTION_RESET)
    marker = F.when(is_severity, F.when(word == "CRITICAL", "HIGH").otherwise(word)).when(is_reset, "")
    so_far = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return candidates.withColumns(
        {
            "is_section": is_severity | is_contract,
            "section_severity": F.nullif(F.last(marker, ignorenulls=True).over(so_far), F.lit("")),
            "section_contract": F.last(
                F.when(is_contract, F.regexp_extract(line, p.CONTRACT_SECTION, 1)), ignorenulls=True
            ).over(so_far),
        }
    )


def _header_kind(line: Column) -> Column:
    """'skill' in structured reports, else the first free-form pattern that fits; the plain numbered one needs a
    severity section."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(p.BARE_HEADERS):
        fits = line.rlike(pattern)
        if name == "section":
            fits = fits & F.col("section_severity").isNotNull()
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    return F.when(F.col("format_hint") == "skill", F.when(line.rlike(p.SKILL_FINDING), "skill")).otherwise(
        F.when(~F.col("is_section"), kind)
    )


def _header_parts(kind: Column, line: Column) -> dict[str, Column]:
    """Severity, title and explicit location of a finding header."""
    patterns = dict(p.BARE_HEADERS) | {"skill": p.SKILL_FINDING}
    letters = F.create_map(*[F.lit(x) for pair in p.SEVERITY_LETTERS.items() for x in pair])

    def part(name: str, index: int) -> Column:
        return group(line, patterns[name], index)

    def pick(**by_kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, value in by_kind.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    severity = pick(
        word=F.upper(part("word", 1)),
        prefix=F.element_at(letters, F.upper(part("prefix", 1))),
        bracket=F.element_at(letters, F.upper(part("bracket", 1))),
        trailing=F.upper(part("trailing", 2)),
        paren=F.upper(part("paren", 2)),
        inline=F.upper(part("inline", 1)),
        section=F.col("section_severity"),
        confidence=F.concat(F.lit("["), part("confidence", 1), F.lit("]")),
    )
    title_group = {"trailing": 1, "paren": 1, "section": 1, "skill": 3}
    title = pick(**{name: part(name, title_group.get(name, 2)) for name in patterns})
    explicit = pick(**{name: part(name, 3) for name in ("word", "prefix", "bracket", "inline")})
    return {"severity": severity, "title": trimmed(title), "explicit": explicit}


def finding_description(after: Column) -> Column:
    """Body text of the following lines up to the next header, without code blocks, capped."""
    body = F.filter(taken_until(after, p.DESCRIPTION_STOP), lambda x: (x != "") & ~x.rlike(p.DESCRIPTION_SKIP))
    raw = trimmed(F.regexp_replace(F.array_join(body, " "), p.CODE_FENCE, ""))
    return cut_text(raw, p.DESCRIPTION_CHARS)


def _stated_location(after: Column) -> Column:
    """The location given in one of the next three lines."""
    stated = F.transform(F.slice(after, 1, 3), lambda x: F.regexp_extract(x, p.SKILL_LOCATION, 1))
    return F.get(F.filter(stated, lambda x: x != ""), F.lit(0))


def parsed_lines(candidates: DataFrame) -> DataFrame:
    """Candidate lines with their section state and the kind of finding header they are (null: none).

    What the following lines say is worked out before the window, so those lines are not shuffled.
    """
    digested = candidates.withColumns(
        {
            "description": finding_description(F.col("after")),
            "stated_location": _stated_location(F.col("after")),
        }
    ).drop("after")
    return section_state(digested).withColumn("kind", _header_kind(F.col("line")))


def findings_of(parsed: DataFrame) -> DataFrame:
    """Findings of all formats: structured ones carry their own number, free-form ones count in text order.

    ``index`` is the number as printed and may repeat within a run; ``position`` (the line) tells findings apart.
    """
    skill, line = F.col("kind") == "skill", F.col("line")
    headed = parsed.filter(F.col("kind").isNotNull()).withColumns(_header_parts(F.col("kind"), line))
    own, contract = F.col("own_location"), F.col("section_contract")
    stated = F.when(skill, F.coalesce("stated_location", own))
    in_section = F.when(own.isNull(), contract).when(
        ~own.contains(".") & contract.isNotNull(), F.concat_ws(".", contract, own)
    ).otherwise(own)
    located = (
        headed.withColumns(
            {
                "own_location": title_location(F.col("title"), F.col("explicit")),
                "vuln_type": classify_keyword(F.col("title")),
                "slug": title_slug(F.col("title")),
            }
        )
        .withColumn("location", F.when(skill, stated).otherwise(in_section))
    )
    return located.select(
        "run_id",
        "line_no",
        F.col("line_no").cast("int").alias("position"),
        F.when(skill, F.regexp_extract(line, p.SKILL_FINDING, 2).try_cast("int"))
        .otherwise(F.row_number().over(_order()))
        .alias("index"),
        "title",
        F.when(skill, F.regexp_extract(line, p.SKILL_FINDING, 1).try_cast("int")).alias("confidence"),
        "severity",
        "location",
        root_cause_key(F.col("location"), F.col("vuln_type"), F.col("slug")).alias("root_cause"),
        "vuln_type",
        "description",
    )


def extract_skill_findings(reports: DataFrame) -> DataFrame:
    """Findings of structured reports."""
    return findings_of(parsed_lines(candidate_lines(reports)).filter("kind = 'skill'"))


def extract_bare_findings(reports: DataFrame) -> DataFrame:
    """Findings of free-form reports."""
    return findings_of(parsed_lines(candidate_lines(reports)).filter("kind <> 'skill'"))


def extract_findings(reports: DataFrame) -> DataFrame:
    """All findings of all reports, whatever their format."""
    return findings_of(parsed_lines(candidate_lines(reports)))


def report_format(header_format: Column, format_hint: Column, parsed: Column) -> Column:
    """The markers decide; without markers the parser that finds something; else 'unknown'."""
    return F.coalesce(header_format, F.when((format_hint == "skill") | (parsed > 0), format_hint), F.lit("unknown"))


def _is_estimated(line: Column, severity_above: Column) -> Column:
    """Whether a heading-like line counts as a finding in the estimate."""
    headed = line.startswith("#") | line.startswith("**")
    return headed & ~matches_any(line, p.NOT_A_FINDING) & (matches_any(line, p.FINDING_LIKE) | severity_above)


def _stated_count() -> Column:
    """The finding count a report states in its own tables; null when it states none."""
    line = F.col("line")
    row_number = F.when(line.rlike(p.SKILL_TABLE_ROW), F.regexp_extract(line, p.SKILL_TABLE_ROW, 1).try_cast("long"))
    stated = F.when(
        line.rlike(p.SUMMARY_COUNT_ROW), F.regexp_extract(line, p.SUMMARY_COUNT_ROW, 2).try_cast("long")
    ).when(line.rlike(p.SUMMARY_ROW), F.lit(1).cast("long"))
    return F.coalesce(
        F.max(F.when(F.col("format_hint") == "skill", row_number)),
        F.sum(F.when(F.col("format_hint") == "bare", stated)),
    )


def _estimate() -> Column:
    """Structured headers if there are any, else the heading-like lines."""
    likely = F.count_if(_is_estimated(F.col("line"), F.col("severity_above")))
    return F.when(F.first("skill_headers") > 0, F.first("skill_headers").cast("long")).otherwise(likely)


def reported_count(reports: DataFrame) -> DataFrame:
    return candidate_lines(reports).groupBy("run_id").agg(_stated_count().alias("reported_count"))


def estimate_raw_findings(reports: DataFrame) -> DataFrame:
    """Estimated findings per run, before comparing with the parsed ones."""
    return candidate_lines(reports).groupBy("run_id").agg(_estimate().alias("estimate"))


def detect_format(reports: DataFrame) -> DataFrame:
    return parse_results(reports).select("run_id", "format")


def parse_results(reports: DataFrame) -> DataFrame:
    """Per run: format, parsed and reported counts, the estimate and the parser's coverage of it."""
    counted = (
        parsed_lines(candidate_lines(reports))
        .groupBy("run_id")
        .agg(
            F.first("header_format").alias("header_format"),
            F.first("format_hint").alias("format_hint"),
            F.count("kind").alias("parsed"),
            _stated_count().alias("stated"),
            _estimate().alias("estimate"),
        )
        .withColumn("format", report_format(F.col("header_format"), F.col("format_hint"), F.col("parsed")))
    )
    estimate = F.greatest("estimate", "parsed")
    return counted.select(
        "run_id",
        "format",
        "parsed",
        F.when(F.col("format") != "unknown", F.col("stated")).alias("reported_count"),
        estimate.alias("raw_finding_estimate"),
        parser_coverage(F.col("parsed"), estimate).alias("parser_coverage"),
    )


def parser_coverage(parsed: Column, estimate: Column) -> Column:
    return ratio(parsed, estimate)


def unmatched_blocks(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Heading blocks with a signal word that no parsed title covers: the first ten of each run, up to 3 lines each.

    The parsed titles of a run travel to its blocks as one array of word lists (they all come from one text), and a
    block is covered when two or more of its heading words occur in one title.
    """
    line, after = F.col("line"), F.col("after")
    heading = F.when(line.rlike(p.BLOCK_HEADING), F.regexp_replace(line, r"^#{2,4}\s+", "")).otherwise(
        F.regexp_replace(F.regexp_replace(line, r"^\*\*", ""), r"\*\*\s*$", "")
    )
    body = taken_until(F.slice(after, 1, p.BLOCK_LINES - 1), p.BLOCK_STOP)
    snippet = F.filter(F.concat(F.array(line), F.slice("body", 1, p.SNIPPET_LINES - 1)), lambda x: x != "")
    blocks = (
        candidate_lines(reports)
        .filter(line.rlike(p.BLOCK_HEADING) | line.rlike(p.BLOCK_BOLD))
        .withColumns({"heading": heading, "body": body})
        .filter(~matches_any(F.col("heading"), p.NOT_A_BLOCK))
        .filter(F.array_join(F.concat(F.array(line), F.col("body")), " ").rlike(p.SIGNAL_WORDS))
        .select(
            "run_id",
            "line_no",
            F.array_join(snippet, "\n").alias("snippet"),
            long_words(F.col("heading")).alias("words"),
        )
    )
    titles = findings.groupBy("run_id").agg(F.collect_list(long_words(F.col("title"))).alias("titles"))
    covered = F.exists(
        F.coalesce("titles", F.array().cast("array<array<string>>")),
        lambda title: F.size(F.filter("words", lambda word: F.array_contains(title, word))) >= 2,
    )
    return (
        blocks.join(titles, "run_id", "left")
        .filter(~covered)
        .select("run_id", "line_no", "snippet")
        .withColumn("block_no", F.row_number().over(_order()))
        .filter(F.col("block_no") <= p.MAX_BLOCKS)
    )


def finding_context(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """40 lines from the first line that holds the title (or its first 20 characters); the title when none does.

    One row per finding: (run_id, position, index, context).

    The titles of a run join its text as one array, so a text is never copied per finding. A title holds no line
    break, so the line is found by one substring search in the whole text.
    """

    def plain(text: Column) -> Column:
        return F.regexp_replace(text, "[`*]", "")

    start = F.substring(plain(F.col("title")), 1, p.CONTEXT_TITLE_CHARS)
    sought = findings.select("run_id", "position", "index", "title", start.alias("start"))
    titles = sought.groupBy("run_id").agg(F.collect_list(F.struct("position", "index", "title", "start")).alias("titles"))
    texts = reports.join(titles, "run_id").select(
        "run_id", "titles", F.split("text", "\n").alias("lines"), plain(F.col("text")).alias("clean")
    )

    def context(finding: Column) -> Column:
        place = F.instr(F.col("clean"), finding["start"])
        before = F.regexp_count(F.left(F.col("clean"), F.greatest(place - 1, F.lit(0))), F.lit("\n")) + 1
        found = F.array_join(F.slice("lines", before, F.lit(p.CONTEXT_LINES)), "\n")
        return F.struct(
            finding["position"].alias("position"),
            finding["index"].alias("index"),
            F.when(place > 0, found).otherwise(finding["title"]).alias("context"),
        )

    return texts.select("run_id", F.inline(F.transform("titles", context)))


def recovered_findings(findings: DataFrame, recovered: DataFrame) -> DataFrame:
    """Append findings recovered by a judge, numbered and placed after the parsed ones.

    ``recovered`` holds run_id, position, title, severity, location, vulnerability_type, description; positions
    count from 0 within a run.
    """
    counts = findings.groupBy("run_id").agg(F.count("*").alias("_parsed"), F.max("position").alias("_last"))
    location = F.coalesce(F.nullif("location", F.lit("")), F.lit("Unknown"))
    kind = F.coalesce(F.nullif("vulnerability_type", F.lit("")), F.lit("unknown"))
    extra = recovered.join(counts, "run_id", "left").select(
        "run_id",
        (F.coalesce("_last", F.lit(-1)) + recovered["position"] + 1).cast("int").alias("position"),
        (F.coalesce("_parsed", F.lit(0)) + recovered["position"] + 1).cast("int").alias("index"),
        "title",
        F.nullif("severity", F.lit("")).alias("severity"),
        location.alias("location"),
        F.concat_ws("::", location, F.regexp_replace(F.lower(kind), r"\s+", "-")).alias("root_cause"),
        kind.alias("vuln_type"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(True).alias("recovered"),
    )
    return findings.withColumn("recovered", F.lit(False)).unionByName(extra, allowMissingColumns=True)


def narrative_number_check(narratives: DataFrame) -> DataFrame:
    """Percentages and dollar amounts above 100 in generated text (narrative_id, text)."""
    texts = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(r"(\d+)%"), F.lit(1)),
                    lambda x: F.struct(F.lit("percentage").alias("kind"), x.alias("amount"))),
        F.transform(F.regexp_extract_all("text", F.lit(r"\$(\d+\.?\d*)"), F.lit(1)),
                    lambda x: F.struct(F.lit("cost").alias("kind"), x.alias("amount"))),
    )
    return (
        narratives.select("narrative_id", F.inline(texts))
        .withColumn("value", F.col("amount").cast("double"))
        .filter(F.col("value") > 100)
        .select("narrative_id", "kind", "value")
    )


def assistant_text(blocks: DataFrame, page: int = 1000) -> DataFrame:
    """Text of the assistant blocks (run_id, seq, pos, text) in order, as pages of ``page`` sequence numbers.

    A run shorter than a page has one row; pages joined by newlines in order give the whole text of longer runs.
    """
    spoken = blocks.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    return (
        spoken.groupBy("run_id", F.floor(F.col("seq") / page).alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "text"))).alias("b"))
        .select("run_id", "page", F.array_join(F.col("b.text"), "\n").alias("text"))
    )
