"""Registered queries for live monitoring (L): the event table read as a stream and run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeline.catalog.registry import Registry
from gaugeline.plans import standins as s
from gaugeline.plans.standins import Tables
from gaugeline.session import ensure_checkpoint_dir, state_session
from gaugeline.streaming import growing, monitor

register = Registry()

# Longer limits than the defaults, to suit the spacing of the stand-in events.
GRACE_MS = 12 * 3600 * 1000
TIMEOUT_MS = 3 * 24 * 3600 * 1000
LONG_MS = 10 * 365 * 24 * 3600 * 1000
CLOCK_MS = 2_000
KINDS = {"system": "signup", "assistant": "click", "user": "view", "result": "purchase", "rate_limit_event": "error"}


def _stream(t):
    schema = t.events.schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return monitor.stream_events(s.log_lines_of(source))


@register("l1_stream_events", "select run_id, seq, kind from k_events")
def stream_events(t):
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    typed = _stream(t).select("run_id", "seq", F.element_at(kinds, F.col("type")).alias("kind"))
    return monitor.run_to_table(typed, "append").drop("batch")


@register("l1_growing_log", "select run_id, seq, kind from k_events")
def growing_log(t):
    """The events written as text logs in two rounds, and followed by byte offsets after each."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/followed-{uuid.uuid4().hex}"
    lines = s.log_lines(t).select("run_id", F.concat_ws("\t", F.col("run_id").cast("string"), F.col("seq").cast("string"), "raw").alias("line"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    for half in (0, 1):
        own = lines.filter(F.col("run_id") % 2 == half).select("line")
        own.write.option("lineSep", "\n").text(f"{folder}/logs/round={half}")
        raw = growing.growing_lines(t.spark, f"{folder}/logs", ".txt").select(F.split("raw", "\t", 3).alias("f"))
        typed = monitor.stream_events(
            raw.select(
                F.col("f")[0].cast("long").alias("run_id"), F.col("f")[1].cast("long").alias("seq"),
                F.current_timestamp().alias("ts"), F.col("f")[2].alias("raw"),
            )
        )
        rows = monitor.run_to_table(typed.select("run_id", "seq", F.element_at(kinds, F.col("type")).alias("kind")), "append", f"{folder}/read")
    return rows.drop("batch")


@register("l2_live_counters", """
select run_id, 'turns' counter, count(*) n from k_events where kind='click' and seq%6<>0 group by 1
union all select run_id, 'tool:'||tool, count(*) from k_uses group by 1,2
union all select run_id, 'spawns', count(*) from k_uses where tool='Agent' group by 1""")
def live_counters(t):
    return monitor.counter_totals(_counter_rows(t))


def _counter_rows(t):
    return monitor.run_to_table(monitor.live_counters(_stream(t), width="1 day"), "update")


def _with_state(t, clock):
    """The tables in a session whose streams may keep maps and timers."""
    return Tables(state_session(t.spark, clock), t.folder)


def _agent_rows(t):
    return monitor.run_to_table(monitor.active_agents(_stream(_with_state(t, clock=False)), LONG_MS), "update")


AGENTS = """select run_id, 't'||tid tool_use_id, coalesce(arg_max(spawn, seq), false) is_open, count(*) filter (spawn) spawns,
  count(*) filter (not spawn and before) "returns"
from (select *, lag(spawn) over (partition by run_id, tid order by seq) before from (
  select run_id, tid, seq, true spawn from k_uses where tool='Agent' union all select run_id, tid, seq, false from k_results))
group by 1,2"""


@register("l3_active_agents", AGENTS)
def active_agents(t):
    return monitor.agent_totals(_agent_rows(t))


@register("l3_agent_returns", f"""
select run_id, 'returns' counter, sum("returns")::bigint n from ({AGENTS}) group by 1""")
def agent_returns(t):
    """The returns counter of each run."""
    totals = monitor.agent_totals(_agent_rows(t))
    return totals.groupBy("run_id").agg(F.sum("returns").alias("n")).select("run_id", F.lit("returns").alias("counter"), "n")


LIFE = f"""/*with*/marks as (select user_id run_id, event_id seq, epoch_us(ts)//1000 ms, event_type='purchase' is_result from events
  where event_type in ('signup','purchase')),
starts as (select run_id, arg_min(ms, seq) start_ms from marks group by 1),
firsts as (select m.run_id, min(ms) result_ms from marks m join starts s using (run_id) where is_result and ms<=start_ms+{TIMEOUT_MS} group by 1),
lives as (select s.run_id, start_ms, result_ms, coalesce(result_ms+{GRACE_MS}, start_ms+{TIMEOUT_MS}) deadline, (select max(ms) from marks) final
  from starts s left join firsts using (run_id)),
phases as (
  select run_id, 'started' phase, start_ms at_ms from lives
  union all select run_id, 'result', result_ms from lives where result_ms is not null
  union all select m.run_id, 'restart', ms from marks m join lives l using (run_id) where not is_result and ms>result_ms and ms<=deadline
  union all select run_id, case when result_ms is null then 'stuck' else 'closed' end, deadline from lives where deadline<final)/*end*/"""


def _phases(t):
    return monitor.run_to_table(monitor.life_cycle(_stream(t), GRACE_MS, TIMEOUT_MS, "0 seconds", LONG_MS), "append").drop("batch")


@register("l4_result_grace", LIFE + "select * from phases where phase in ('result','restart','closed')")
def result_grace(t):
    return monitor.result_grace(_phases(t))


@register("l4_clock_grace", """
with marks as (select user_id run_id, event_id seq, event_type='purchase' is_result from events where event_type in ('signup','purchase')),
firsts as (select run_id, min(seq) filter (is_result) result_seq from marks group by 1)
select run_id, phase, count(*) n from (
  select run_id, 'started' phase from firsts
  union all select run_id, 'result' from firsts where result_seq is not null
  union all select run_id, 'restart' from marks join firsts using (run_id) where not is_result and seq>result_seq
  union all select run_id, case when result_seq is null then 'stuck' else 'closed' end from firsts) group by 1,2""")
def clock_grace(t):
    """Phases by the clock: all events come at once, the grace then ends without any further one."""
    stream = monitor.live_life_cycle(_stream(_with_state(t, clock=True)), CLOCK_MS, CLOCK_MS, LONG_MS)

    def all_over(rows):
        over = F.col("phase").isin("closed", "stuck")
        counts = rows.agg(F.count_if(F.col("phase") == "started"), F.count_if(over)).first()
        return counts[0] > 0 and counts[0] == counts[1]

    rows = monitor.run_to_table(stream, "append", until=all_over, seconds=600)
    return rows.groupBy("run_id", "phase").agg(F.count("*").alias("n"))


@register("l5_rate_limits", """
select run_id, seq, 'rejected' status from k_events where kind='error' and seq%2=1""")
def rate_limits(t):
    return monitor.run_to_table(monitor.rate_limits(_stream(t)).select("run_id", "seq", "status"), "append").drop("batch")


@register("l6_run_done", f"""
select d.*, coalesce(a.returned,0) returned, coalesce(c.tools,'none') tools from (
select run_id, count(*) filter (kind='purchase') results, arg_max(seq%30, seq) filter (kind='purchase') turns,
  count(*) filter (kind='click' and seq%4=0) agents, case when max(seq) filter (kind='purchase')%5=0 then 'max_turns' else 'end_turn' end stop_reason,
  max(seq) filter (kind='purchase')%400+0.25 cost_usd
from k_events group by 1 having count(*) filter (kind='purchase')>0) d
left join (select run_id, sum("returns")::bigint returned from ({AGENTS}) group by 1) a using (run_id)
left join (select run_id, string_agg(tool||':'||n, ', ' order by tool) tools from (select run_id, tool, count(*) n from k_uses group by 1,2) group by 1) c
using (run_id)""")
def run_done(t):
    progress = monitor.run_to_table(monitor.run_progress(_stream(t), width="1 day"), "update")
    return monitor.run_done(progress, _counter_rows(t), _agent_rows(t))


@register("l7_stuck_runs", LIFE + "select * from phases where phase='stuck'")
def stuck_runs(t):
    return monitor.stuck_runs(_phases(t))
