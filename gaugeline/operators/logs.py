"""Batch verification of run event logs.

Input: log lines (run_id, seq, raw), one JSON event per line; ``seq`` is the line order within the run. All per-run
facts are aggregates that combine map-side, so one very long run does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.ordering import last_seen
from gaugeline.schemas import EVENT
from gaugeline.session import cut_lineage, materialised

# Limits of the checks.
EXPECTED_MIN_AGENTS = 4
MIN_AGENT_LINES = 10
MIN_OUTPUT_LINES = {"skill": 50, "bare": 10}
ERROR_CHARS = 200
BUILT_IN_COMMANDS = ["help", "clear"]
MAX_RESULT_CHARS = 50_000
PERSISTED_MARKER = "<persisted-output>"
BUNDLE_LINE = (
    r"(?i)(?:agent[- ]?(\d+)[- ]?bundle[^:]*:\s*(\d+)\s*lines)|(?:audit-\S+-agent-(\d+)-bundle\.md:\s*(\d+)\s*lines)"
)


def _at() -> Column:
    """Place of a block in its run."""
    return F.struct("seq", "pos")


def parse_events(lines: DataFrame) -> DataFrame:
    """Typed events; empty and malformed lines are dropped, order stays in ``seq``."""
    valid = lines.filter((F.trim("raw") != "") & F.try_parse_json("raw").isNotNull())
    return valid.select("run_id", "seq", F.from_json("raw", EVENT).alias("e")).select("run_id", "seq", "e.*")


def run_cost(events: DataFrame) -> DataFrame:
    """The first stated cost of each run."""
    stated = F.when(F.col("total_cost_usd").isNotNull(), F.col("seq"))
    return events.groupBy("run_id").agg(F.min_by("total_cost_usd", stated).alias("cost_usd"))


def run_model(events: DataFrame) -> DataFrame:
    """The model named by the first assistant event that names one."""
    named = F.when((F.col("type") == "assistant") & (F.col("message.model") != ""), F.col("seq"))
    return events.groupBy("run_id").agg(F.min_by(F.col("message.model"), named).alias("model"))


def result_text(content: Column, separator: str, only_text: bool) -> Column:
    """Text of a tool result: the string itself, or the texts of its parts."""
    parts = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    if only_text:
        parts = F.filter(parts, lambda part: part["type"] == "text")
    joined = F.array_join(F.transform(parts, lambda part: F.coalesce(part["text"], F.lit(""))), separator)
    is_string = F.schema_of_variant(content) == "STRING"
    return F.coalesce(F.when(is_string, F.try_variant_get(content, "$", "string")).otherwise(joined), F.lit(""))


def content_blocks(events: DataFrame, keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """One row per message block, with the event type it came in and the event's columns named in ``keep``.

    With ``outer``, an event without blocks keeps one row whose ``pos`` is null.

    Of a tool result's content only what the checks need is kept: its line count, the start of an error text, the
    bundle lines it reports and its size. Columns that are not used are never computed.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    blocks = events.select(
        "run_id",
        "seq",
        *keep,
        F.col("type").alias("event_type"),
        "parent_tool_use_id",
        explode("message.content").alias("pos", "b"),
    ).select("run_id", "seq", *keep, "pos", "event_type", "parent_tool_use_id", "b.*")
    content = F.col("content")
    is_result = (F.col("event_type") == "user") & (F.col("type") == "tool_result")
    whole = result_text(content, "\n", only_text=False)
    groups = [F.regexp_extract_all(whole, F.lit(BUNDLE_LINE), F.lit(index)) for index in range(1, 5)]
    return blocks.withColumns(
        {
            "result_lines": F.when(is_result, F.size(F.split(result_text(content, "\n", only_text=True), "\n"))),
            "error_text": F.when(
                is_result & F.col("is_error"), F.substring(result_text(content, " ", only_text=False), 1, ERROR_CHARS)
            ),
            "bundle_reports": F.when(is_result & whole.rlike(BUNDLE_LINE), F.arrays_zip(*groups)),
            "result_chars": F.when(is_result, F.length(whole)),
            "is_pointer": F.when(is_result, whole.contains(PERSISTED_MARKER)),
        }
    ).drop("content")


def tool_uses(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("event_type") == "assistant") & (F.col("type") == "tool_use"))


def tool_results(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("event_type") == "user") & (F.col("type") == "tool_result"))


def agent_spans(blocks: DataFrame, stretch: int = 100_000) -> DataFrame:
    """Agent calls with what they returned.

    A result belongs to the latest earlier call with its id (an as-of join); a later result replaces an earlier one.
    """
    is_use = (F.col("event_type") == "assistant") & (F.col("type") == "tool_use") & (F.col("name") == "Agent")
    is_result = (F.col("event_type") == "user") & (F.col("type") == "tool_result") & (F.col("tool_use_id") != "")
    given = F.col("input")
    calls = cut_lineage(
        blocks.filter(is_use | is_result).select(
            "run_id",
            F.when(is_use, F.coalesce("id", F.lit("unknown"))).otherwise(F.col("tool_use_id")).alias("tool_use_id"),
            "seq",
            "pos",
            is_use.alias("is_use"),
            F.when(is_use, F.coalesce(given["description"], F.lit(""))).alias("description"),
            F.when(is_use, F.coalesce(given["model"], F.lit("default"))).alias("model"),
            F.coalesce("is_error", F.lit(False)).alias("is_error"),
            F.col("result_lines").alias("lines"),
        )
    )
    keys = ["run_id", "tool_use_id"]
    bound = last_seen(
        calls, keys, ["seq", "pos"], F.when(F.col("is_use"), _at()), "use", width=stretch
    ).filter(F.col("use").isNotNull())
    is_use, returned_at = F.col("is_use"), F.when(~F.col("is_use"), _at())
    return (
        bound.groupBy(*keys, "use")
        .agg(
            F.max(F.when(is_use, F.col("description"))).alias("description"),
            F.max(F.when(is_use, F.col("model"))).alias("model"),
            (F.count_if(~is_use) > 0).alias("returned"),
            F.coalesce(F.max_by("is_error", returned_at), F.lit(False)).alias("returned_error"),
            F.coalesce(F.max_by("lines", returned_at), F.lit(0)).alias("return_lines"),
        )
        .select(*keys, F.col("use.seq").alias("seq"), "description", "model", "returned", "returned_error", "return_lines")
    )


def tool_errors(blocks: DataFrame) -> DataFrame:
    """Failed tool results with the tool's name and the start of the error text."""
    names = (
        tool_uses(blocks)
        .filter("id <> '' and name <> ''")
        .groupBy("run_id", F.col("id").alias("tool_use_id"))
        .agg(F.max_by("name", _at()).alias("tool"))
    )
    failed = tool_results(blocks).filter("is_error").select("run_id", "tool_use_id", "seq", "pos", F.col("error_text").alias("error"))
    return failed.join(names, ["run_id", "tool_use_id"], "left").select(
        "run_id", "seq", "pos", F.coalesce("tool", F.lit("unknown")).alias("tool"), "error"
    )


def tool_error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("run_id", "tool").agg(F.count("*").alias("errors"))


def bundle_quality(blocks: DataFrame) -> DataFrame:
    """Line count last reported per agent bundle, and whether it was empty at some point."""
    found = (
        tool_results(blocks)
        .filter(F.col("bundle_reports").isNotNull())
        .select("run_id", "seq", F.col("pos").alias("block"), F.posexplode("bundle_reports").alias("place", "m"))
    )
    blank = F.lit("")
    agent = F.coalesce(F.nullif(F.col("m")["0"], blank), F.nullif(F.col("m")["2"], blank), F.lit("?"))
    lines = F.coalesce(F.nullif(F.col("m")["1"], blank), F.nullif(F.col("m")["3"], blank), F.lit("0")).cast("long")
    rows = found.select(
        "run_id",
        F.struct("seq", "block", "place").alias("at"),
        F.concat(F.lit("agent-"), agent, F.lit("-bundle")).alias("bundle"),
        lines.alias("lines"),
    )
    return rows.groupBy("run_id", "bundle").agg(
        F.max_by("lines", F.col("at")).alias("lines"), F.max(F.col("lines") == 0).alias("was_empty")
    )


def session_inits(events: DataFrame) -> DataFrame:
    """Init events per run; more than one means the session was restarted."""
    is_init = (F.col("type") == "system") & (F.col("subtype") == "init")
    return events.groupBy("run_id").agg(F.count_if(is_init).alias("inits"))


def event_facts(blocks: DataFrame) -> DataFrame:
    """Per run: event and init counts, the first result's stop reason and the first init's visible commands.

    Taken from ``checked_blocks``: every event has one row there without a place or with place 0.
    """
    events = blocks.filter(F.col("pos").isNull() | (F.col("pos") == 0))
    is_result = F.col("event_type") == "result"
    is_init = (F.col("event_type") == "system") & (F.col("subtype") == "init")
    return events.groupBy("run_id").agg(
        F.count("*").alias("events"),
        F.count_if(is_init).alias("inits"),
        (F.count_if(is_result) > 0).alias("has_result"),
        F.min_by("stop_reason", F.when(is_result, F.col("seq"))).alias("stop_reason"),
        F.count_if("skill_call").alias("skill_calls"),
        F.min_by("leaked", F.when(is_init, F.col("seq"))).alias("leaked_command"),
    )


def agent_facts(spans: DataFrame) -> DataFrame:
    """Agents per run: spawned, returned, failed, and returned with too little text."""
    thin = F.col("returned") & ~F.col("returned_error") & (F.col("return_lines") < MIN_AGENT_LINES)
    return spans.groupBy("run_id").agg(
        F.count("*").alias("agents"),
        F.count_if("returned").alias("agents_returned"),
        F.count_if("returned_error").alias("agents_failed"),
        F.count_if(thin).alias("agents_thin"),
    )


def bundle_facts(bundles: DataFrame) -> DataFrame:
    return bundles.groupBy("run_id").agg(
        F.count("*").alias("bundles"),
        F.count_if(F.col("lines") == 0).alias("bundles_empty"),
        F.count_if("was_empty").alias("bundles_were_empty"),
    )


def checked_blocks(events: DataFrame) -> DataFrame:
    """The message blocks and the events without any, with what the checks read of them: the log is parsed and written
    once, and ``event_facts`` and all block checks start from there."""
    skill_call = (F.col("type") == "assistant") & F.exists(
        "message.content", lambda block: (block["type"] == "tool_use") & (block["name"] == "Skill")
    )
    leaked = F.get(
        F.filter(F.coalesce("slash_commands", F.array().cast("array<string>")), lambda c: ~c.isin(BUILT_IN_COMMANDS)),
        F.lit(0),
    )
    marked = events.withColumns({"skill_call": F.coalesce(skill_call, F.lit(False)), "leaked": leaked})
    own = ["subtype", "stop_reason", "skill_call", "leaked"]
    return materialised(
        content_blocks(marked, keep=own, outer=True).select(
            "run_id", "seq", "pos", *own, "event_type", "type", "name", "id", "input", "tool_use_id", "is_error",
            "result_lines", "error_text", "bundle_reports",
        )
    )


def run_facts(
    runs: DataFrame,
    events: DataFrame,
    output_lines: DataFrame,
    compliance: DataFrame | None = None,
    mentions: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Everything the checks need, one row per run.

    ``runs`` holds run_id, mode, exit_code, timed_out and expected_min_agents; ``output_lines`` run_id, output_lines.
    ``compliance`` (of ``scope.scope_compliance``) has a row for every run of a codebase with a scope list, ``mentions``
    (of ``scope.oos_mentions``) the out-of-scope names in its text; without them no scope check applies. ``blocks`` are
    the ``checked_blocks`` of the events if they exist already.
    """
    if blocks is None:
        blocks = checked_blocks(events)
    counts = ["events", "inits", "skill_calls", "agents", "agents_returned", "agents_failed", "agents_thin",
              "bundles", "bundles_empty", "bundles_were_empty", "tool_errors"]
    errors = tool_errors(blocks).groupBy("run_id").agg(F.count("*").alias("tool_errors"))
    scope_columns = ["in_scope_files", "files_read", "in_scope_read", "out_of_scope_read"]
    if compliance is None:
        no_scope = [F.lit(None).cast("long").alias(c) for c in (*scope_columns, "oos_mentions")]
        runs = runs.select("*", *no_scope)
    else:
        named = mentions.groupBy("run_id").agg(F.count("*").alias("oos_mentions"))
        runs = runs.join(compliance.select("run_id", *scope_columns), "run_id", "left").join(named, "run_id", "left")
        counts = [*counts, "oos_mentions"]
    return (
        runs.join(event_facts(blocks), "run_id", "left")
        .join(agent_facts(agent_spans(blocks)), "run_id", "left")
        .join(bundle_facts(bundle_quality(blocks)), "run_id", "left")
        .join(errors, "run_id", "left")
        .join(output_lines, "run_id", "left")
        .na.fill(0, counts)
        .na.fill(False, ["has_result", "timed_out"])
    )


def _check(name: str, ok: Column, detail: Column, applies: Column | None = None) -> Column:
    entry = F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"))
    return entry if applies is None else F.when(applies, entry)


def check_rows(facts: DataFrame) -> DataFrame:
    """One row per run and check that applies to it; ``facts`` comes from ``run_facts``."""
    col = F.col
    skill, bare = col("mode") == "skill", col("mode") == "bare"
    done = col("has_result")
    late = col("timed_out") & ~done
    scoped = col("in_scope_files").isNotNull()
    expected = F.coalesce("expected_min_agents", F.lit(EXPECTED_MIN_AGENTS))
    wanted_lines = F.when(skill, MIN_OUTPUT_LINES["skill"]).otherwise(MIN_OUTPUT_LINES["bare"])
    checks = [
        _check("exit_code", (col("exit_code") == 0) | ((col("exit_code") == 143) & done), col("exit_code")),
        _check(
            "not_timed_out",
            ~late,
            F.when(late, "timed out").when(col("timed_out"), "killed after completion").otherwise("completed in time"),
        ),
        _check("has_events", col("events") > 0, col("events")),
        _check("has_result", done, F.coalesce("stop_reason", F.lit("no result event"))),
        _check("stop_reason", F.coalesce(col("stop_reason") == "end_turn", F.lit(False)), col("stop_reason"), done),
        _check("agents_spawned", col("agents") >= expected, F.concat_ws("/", "agents", expected), skill),
        _check(
            "agents_all_returned",
            col("agents_returned") == col("agents"),
            F.concat_ws("/", "agents_returned", "agents"),
            skill,
        ),
        _check("agents_no_errors", col("agents_failed") == 0, col("agents_failed"), skill),
        _check("agents_result_quality", col("agents_thin") == 0, col("agents_thin"), skill),
        _check("no_skill_calls", col("skill_calls") == 0, col("skill_calls"), ~skill),
        _check(
            "bare_no_skill_visible",
            col("leaked_command").isNull(),
            F.coalesce("leaked_command", F.lit("none")),
            bare & (col("inits") > 0),
        ),
        _check("bundle_quality", col("bundles_empty") == 0, col("bundles_empty"), skill & (col("bundles") > 0)),
        _check(
            "has_output",
            F.coalesce(col("output_lines") >= wanted_lines, F.lit(False)),
            F.coalesce(col("output_lines").cast("string"), F.lit("no stdout file")),
        ),
        _check("scope_no_oos_findings", F.coalesce(col("oos_mentions") == 0, F.lit(True)), col("oos_mentions"), scoped),
        _check(
            "scope_in_scope_read",
            col("in_scope_read") > 0,
            F.concat("in_scope_read", F.lit("/"), "in_scope_files", F.lit(" in scope, "), "files_read", F.lit(" in total")),
            scoped,
        ),
    ]
    return facts.select("run_id", F.inline(F.array_compact(F.array(*checks))))


def warning_rows(facts: DataFrame) -> DataFrame:
    """Warnings that do not fail a run: tool errors, rebuilt bundles, restarted sessions, reads out of scope by mode.

    The single tool errors behind a count are the rows of ``tool_errors``.
    """
    col = F.col
    retried = (col("mode") == "skill") & (col("bundles_were_empty") > 0) & (col("bundles_empty") == 0)

    def warning(name: str, amount: str, applies: Column) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("warning"), col(amount).alias("amount")))

    found = [
        warning("tool_errors", "tool_errors", col("tool_errors") > 0),
        warning("bundle_retry", "bundles_were_empty", retried),
        warning("restarted_session", "inits", col("inits") > 1),
        *[
            warning(f"{mode}_read_out_of_scope", "out_of_scope_read", (col("mode") == mode) & (col("out_of_scope_read") > 0))
            for mode in ("skill", "bare")
        ],
    ]
    return facts.select("run_id", F.inline(F.array_compact(F.array(*found))))


def verify_runs(checks: DataFrame) -> DataFrame:
    """A run passes when every check that applies to it is ok."""
    return checks.groupBy("run_id").agg(
        F.bool_and("ok").alias("passed"),
        F.count("*").alias("checks"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def suite_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count("*").alias("runs"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    )


def oversize_results(blocks: DataFrame) -> DataFrame:
    """Per run and tool: results above the size limit or replaced by a pointer, and reads without offset and limit."""
    names = (
        tool_uses(blocks)
        .filter("id <> ''")
        .groupBy("run_id", F.col("id").alias("tool_use_id"))
        .agg(F.max_by("name", _at()).alias("tool"))
    )
    big = (
        tool_results(blocks)
        .filter((F.col("result_chars") > MAX_RESULT_CHARS) | F.col("is_pointer"))
        .select("run_id", "tool_use_id")
        .join(names, ["run_id", "tool_use_id"], "left")
        .select("run_id", F.coalesce("tool", F.lit("unknown")).alias("tool"), F.lit(1).alias("big"), F.lit(0).alias("full"))
    )
    given = F.coalesce(F.map_contains_key("input", "offset") | F.map_contains_key("input", "limit"), F.lit(False))
    full = tool_uses(blocks).filter((F.col("name") == "Read") & ~given).select(
        "run_id", F.col("name").alias("tool"), F.lit(0).alias("big"), F.lit(1).alias("full")
    )
    return big.unionByName(full).groupBy("run_id", "tool").agg(
        F.sum("big").alias("oversize"), F.sum("full").alias("full_reads")
    )
