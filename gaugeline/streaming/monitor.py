"""Live monitoring of run events with Structured Streaming.

Input streams hold run_id, seq, ts, raw (one JSON event per row, in order per run). Counting uses built-in streaming
aggregates over time slices. Only what depends on order and time within a key runs in Python state: open agents (maps whose
entries expire, by hash of the call) and the life cycle of a run (fed by its few init and result events), by event time for
logs that are read again and by the clock, with timers, for logs that are followed. All state ends: slices behind the
watermark, returned or abandoned calls, and runs that are over.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeline.operators.logs import content_blocks
from gaugeline.schemas import EVENT
from gaugeline.session import ensure_checkpoint_dir

# The state functions travel with the query, so executors do not need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Grace after the result and the time limit of a run.
RESULT_GRACE_MS = 15_000
RUN_TIMEOUT_MS = 10 * 60 * 1000
KEEP_CLOSED_MS = 60 * 60 * 1000


def stream_events(lines: DataFrame) -> DataFrame:
    """Typed events of a line stream; empty and malformed lines are dropped."""
    valid = lines.filter((F.trim("raw") != "") & F.try_parse_json("raw").isNotNull())
    return valid.select("run_id", "seq", "ts", F.from_json("raw", EVENT).alias("e")).select("run_id", "seq", "ts", "e.*")


def rate_limits(events: DataFrame) -> DataFrame:
    """Rate-limit events that did not pass."""
    status = F.col("rate_limit_info.status")
    limited = (F.col("type") == "rate_limit_event") & F.col("rate_limit_info").isNotNull()
    return events.filter(limited & ~status.eqNullSafe("allowed")).select("run_id", "seq", "ts", status.alias("status"))


def _windowed(events: DataFrame, delay: str, width: str) -> DataFrame:
    """Events with the time slice they count in; a slice's state goes once the watermark has passed its end."""
    return events.withWatermark("ts", delay).withColumn("slice", F.window("ts", width))


def live_counters(events: DataFrame, delay: str = "1 minute", width: str = "1 hour") -> DataFrame:
    """Running counts per run and time slice: turns, agent spawns and calls per tool, as (run_id, counter, since, n).

    ``counter_totals`` adds the slices up. Events further behind the newest one than slice and ``delay`` do not count.
    """
    assistant = (F.col("type") == "assistant") & F.col("message.content").isNotNull()
    calls = F.filter("message.content", lambda block: block["type"] == "tool_use")
    counters = F.concat(
        F.when(F.col("parent_tool_use_id").isNull(), F.array(F.lit("turns"))).otherwise(F.array().cast("array<string>")),
        F.transform(calls, lambda block: F.concat(F.lit("tool:"), F.coalesce(block["name"], F.lit("?")))),
        F.transform(F.filter(calls, lambda block: block["name"] == "Agent"), lambda block: F.lit("spawns")),
    )
    return (
        _windowed(events.filter(assistant).select("run_id", "ts", F.explode(counters).alias("counter")), delay, width)
        .groupBy("slice", "run_id", "counter")
        .agg(F.count("*").alias("n"))
        .select("run_id", "counter", F.col("slice.start").alias("since"), "n")
    )


def counter_totals(rows: DataFrame) -> DataFrame:
    """(run_id, counter, n) over all slices of a written ``live_counters`` stream."""
    return latest_updates(rows, ["run_id", "counter", "since"]).groupBy("run_id", "counter").agg(F.sum("n").alias("n"))


def run_progress(events: DataFrame, delay: str = "1 minute", width: str = "1 hour") -> DataFrame:
    """Per run and time slice: results and the last of them, own turns and agent spawns."""
    is_result = F.col("type") == "result"
    assistant = (F.col("type") == "assistant") & F.col("message.content").isNotNull()
    agents = F.size(F.filter("message.content", lambda b: (b["type"] == "tool_use") & (b["name"] == "Agent")))
    last = F.when(is_result, F.struct("seq", "num_turns", "stop_reason", "total_cost_usd"))
    return (
        _windowed(events, delay, width)
        .groupBy("slice", "run_id")
        .agg(
            F.count_if(is_result).alias("results"),
            F.count_if(assistant & F.col("parent_tool_use_id").isNull()).alias("own_turns"),
            F.coalesce(F.sum(F.when(assistant, agents)), F.lit(0)).cast("long").alias("agents"),
            F.max(last).alias("last"),
        )
        .select("run_id", F.col("slice.start").alias("since"), "results", "own_turns", "agents", "last")
    )


def run_done(progress: DataFrame, counters: DataFrame, agents: DataFrame) -> DataFrame:
    """Summary of every run that has a result, from the written streams of ``run_progress``, ``live_counters`` and
    ``active_agents``: turns, agents, how many of them returned, calls per tool, stop reason and cost."""
    returned = agent_totals(agents).groupBy("run_id").agg(F.sum("returns").alias("returned"))
    calls = counter_totals(counters).filter(F.col("counter").startswith("tool:"))
    listed = F.struct(F.substring("counter", 6, 2**31 - 1).alias("tool"), "n")
    tools = calls.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(listed)), lambda x: F.concat_ws(":", x["tool"], x["n"])), ", "
        ).alias("tools")
    )
    return (
        latest_updates(progress, ["run_id", "since"])
        .groupBy("run_id")
        .agg(
            F.sum("results").alias("results"),
            F.sum("own_turns").alias("own_turns"),
            F.sum("agents").alias("agents"),
            F.max("last").alias("last"),
        )
        .filter("results > 0")
        .join(returned, "run_id", "left")
        .join(tools, "run_id", "left")
        .select(
            "run_id",
            "results",
            F.coalesce("last.num_turns", "own_turns").alias("turns"),
            "agents",
            F.coalesce("returned", F.lit(0)).alias("returned"),
            F.coalesce("tools", F.lit("none")).alias("tools"),
            "last.stop_reason",
            F.col("last.total_cost_usd").alias("cost_usd"),
        )
    )


AGENT_KEYS = 1024  # the calls of all runs are kept under so many keys by hash: a run is not one task, nor a key a call
AGENT_OUTPUT = "run_id long, tool_use_id string, is_open boolean, spawns long, returns long"


class OpenCalls(StatefulProcessor):
    """Open agent calls of one of AGENT_KEYS parts of all calls, as a map from run and call id to the time of the spawn.

    A spawn opens the call id, the next result closes it; results of closed ids do not count. A call that stays open
    longer than the time to live is given up: the state store drops it, and a later result of it does not count. The rows
    of a batch are counted together; the state is asked only where it holds any calls.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "run_id long, tool_use_id string", "since_ms long", self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["run_id", "tool_use_id", "seq", "pos"])
        now = timerValues.getCurrentProcessingTimeInMs()
        names = frame[["run_id", "tool_use_id"]]
        first = (names != names.shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(first)
        calls = [(int(run), call) for run, call in names.iloc[starts].itertuples(index=False)]
        any_open = self.open.exists()
        was_open = np.array([any_open and self.open.containsKey(call) for call in calls], dtype=bool)
        spawn = frame["is_spawn"].to_numpy(dtype=bool)
        open_before = np.concatenate(([False], spawn[:-1]))
        open_before[starts] = was_open
        is_open = spawn[np.append(starts[1:], len(spawn)) - 1]
        for at in np.flatnonzero(is_open | was_open):
            if is_open[at]:
                self.open.updateValue(calls[at], (now,))
            else:
                self.open.removeKey(calls[at])
        yield pd.DataFrame(
            {
                "run_id": [run for run, _ in calls],
                "tool_use_id": [call for _, call in calls],
                "is_open": is_open,
                "spawns": np.add.reduceat(spawn.astype(np.int64), starts),
                "returns": np.add.reduceat((~spawn & open_before).astype(np.int64), starts),
            }
        )

    def close(self) -> None:
        pass


def active_agents(events: DataFrame, timeout_ms: int = RUN_TIMEOUT_MS) -> DataFrame:
    """Agent calls per (run, call id) as they open and return, with the spawns and returns since the last update.

    ``agent_totals`` adds the updates up. A call is open for ``timeout_ms`` of processing time at most. The stream must be
    read in a ``session.state_session``, with ``clock`` if it goes on, without if it ends with its input.
    """
    blocks = content_blocks(events, keep=["ts"])
    spawn = (F.col("event_type") == "assistant") & (F.col("type") == "tool_use") & (F.col("name") == "Agent")
    back = (F.col("event_type") == "user") & (F.col("type") == "tool_result")
    relevant = blocks.filter(spawn | back).select(
        "run_id",
        F.coalesce(F.when(spawn, F.col("id")).otherwise(F.col("tool_use_id")), F.lit("")).alias("tool_use_id"),
        "seq",
        "pos",
        spawn.alias("is_spawn"),
    )
    part = F.pmod(F.xxhash64("run_id", "tool_use_id"), F.lit(AGENT_KEYS)).cast("int").alias("part")
    return relevant.select("*", part).groupBy("part").transformWithStateInPandas(
        OpenCalls(timeout_ms), AGENT_OUTPUT, "Update", "ProcessingTime"
    )


def agent_totals(rows: DataFrame) -> DataFrame:
    """(run_id, tool_use_id, is_open, spawns, returns) of a written ``active_agents`` stream."""
    return rows.groupBy("run_id", "tool_use_id").agg(
        F.max_by("is_open", "batch").alias("is_open"), F.sum("spawns").alias("spawns"), F.sum("returns").alias("returns")
    )


LIFE_OUTPUT = "run_id long, phase string, at_ms long"
LIFE_STATE = "start_ms long, result_ms long, over boolean"


def _life_cycle(grace_ms: int, timeout_ms: int, keep_ms: int):
    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, result, over = state.get if state.exists else (-1, -1, False)
        found = []

        def deadline() -> int:
            return result + grace_ms if result >= 0 else start + timeout_ms

        def finish() -> None:
            found.append(("closed" if result >= 0 else "stuck", deadline()))

        if state.hasTimedOut and over:  # nothing of the run is expected any more
            state.remove()
            return
        if state.hasTimedOut:
            finish()
            over = True
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for at, is_result in zip(rows["at_ms"], rows["is_result"]):
                if over:
                    break
                if start < 0:
                    start = int(at)
                    found.append(("started", start))
                if at > deadline():
                    finish()
                    over = True
                elif is_result and result < 0:
                    result = int(at)
                    found.append(("result", result))
                elif not is_result and result >= 0:
                    found.append(("restart", int(at)))
        state.update((start, result, over))
        until = deadline() + (keep_ms if over else 0)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"run_id": [key[0]] * len(found), "phase": [p for p, _ in found], "at_ms": [a for _, a in found]}
        )

    return track


def life_cycle(
    events: DataFrame,
    grace_ms: int = RESULT_GRACE_MS,
    timeout_ms: int = RUN_TIMEOUT_MS,
    delay: str = "1 minute",
    keep_ms: int = KEEP_CLOSED_MS,
) -> DataFrame:
    """Phases of each run: started, result, restart (an init within the grace), closed (grace over), stuck (no result).

    Time is event time; marks that arrive more than ``delay`` behind the newest are too late to count. A run without
    result is stuck after ``timeout_ms``; one with a result closes ``grace_ms`` later, and events after that are ignored.
    A run that is over is remembered for ``keep_ms`` more and then forgotten, so the state holds recent runs only. Only
    init and result events reach it.
    """
    init = (F.col("type") == "system") & (F.col("subtype") == "init")
    is_result = F.col("type") == "result"
    marks = (
        events.withWatermark("ts", delay)
        .filter(init | is_result)
        .select("run_id", "seq", "ts", F.unix_millis("ts").alias("at_ms"), is_result.alias("is_result"))
    )
    return marks.groupBy("run_id").applyInPandasWithState(
        _life_cycle(grace_ms, timeout_ms, keep_ms), LIFE_OUTPUT, LIFE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


class RunLife(StatefulProcessor):
    """The life of a run by the clock: what happened (start, result, over) and a timer for what must come next."""

    def __init__(self, grace_ms: int, timeout_ms: int, keep_ms: int):
        self.grace_ms, self.timeout_ms, self.keep_ms = grace_ms, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "start_ms long, result_ms long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        start, result, over = self.life.get() if self.life.exists() else (-1, -1, False)
        found = []
        marks = pd.concat(list(rows)).sort_values("seq")["is_result"]
        for is_result in () if over or 0 <= result < now - self.grace_ms else marks:
            if start < 0:
                start = now
                found.append("started")
                self.handle.registerTimer(start + self.timeout_ms)
            if is_result and result < 0:
                result = now
                found.append("result")
                self.handle.deleteTimer(start + self.timeout_ms)
                self.handle.registerTimer(result + self.grace_ms)
            elif not is_result and result >= 0:
                found.append("restart")
        self.life.update((start, result, over))
        yield self.phases(key, found, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, result, over = self.life.get()
        if over:  # nothing of the run is expected any more
            self.life.clear()
            yield self.phases(key, [], 0)
            return
        self.life.update((start, result, True))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        yield self.phases(key, ["closed" if result >= 0 else "stuck"], expiredTimerInfo.getExpiryTimeInMs())

    @staticmethod
    def phases(key, found: list[str], at: int) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]] * len(found), "phase": found, "at_ms": [at] * len(found)}).astype(
            {"run_id": "int64", "phase": "object", "at_ms": "int64"}
        )

    def close(self) -> None:
        pass


def live_life_cycle(
    events: DataFrame, grace_ms: int = RESULT_GRACE_MS, timeout_ms: int = RUN_TIMEOUT_MS, keep_ms: int = KEEP_CLOSED_MS
) -> DataFrame:
    """``life_cycle`` by the clock, for logs that are followed as they grow: a run whose result has come closes
    ``grace_ms`` later, and one without result is stuck after ``timeout_ms``, also if no event of any run follows.

    An init within the grace is a restart; events after it are ignored. at_ms is processing time. The stream must be read
    in a ``session.state_session`` with ``clock``.
    """
    init = (F.col("type") == "system") & (F.col("subtype") == "init")
    is_result = F.col("type") == "result"
    marks = events.filter(init | is_result).select("run_id", "seq", is_result.alias("is_result"))
    return marks.groupBy("run_id").transformWithStateInPandas(
        RunLife(grace_ms, timeout_ms, keep_ms), LIFE_OUTPUT, "Append", "ProcessingTime"
    )


def result_grace(phases: DataFrame) -> DataFrame:
    """Results with the end of their grace, and restarts that were ignored within it."""
    return phases.filter(F.col("phase").isin("result", "restart", "closed"))


def stuck_runs(phases: DataFrame) -> DataFrame:
    return phases.filter("phase = 'stuck'")


def run_to_table(
    stream: DataFrame,
    output_mode: str,
    folder: str | None = None,
    until: Callable[[DataFrame], bool] | None = None,
    seconds: float = 120,
) -> DataFrame:
    """Run a stream over all available input and return what it wrote, with the micro-batch it came from.

    Each micro-batch overwrites its own folder, so a retried batch leaves no duplicates. With ``until``, a test of what was
    written, the stream goes on by the clock until that holds, or raises after ``seconds``.
    """
    spark = stream.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    def rows() -> DataFrame:
        return spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch bigint").parquet(f"{folder}/rows")

    query = (
        stream.writeStream.outputMode(output_mode)
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**{"processingTime": "1 second"} if until else {"availableNow": True})
        .start()
    )
    if until is None:
        query.awaitTermination()
        return rows()
    end = time.monotonic() + seconds
    try:
        while not (query.lastProgress and until(rows())):
            if query.awaitTermination(1):  # it failed
                raise RuntimeError("the stream ended by itself")
            if time.monotonic() > end:
                raise TimeoutError(f"the stream did not get there in {seconds} s")
    finally:
        query.stop()
    return rows()


def latest_updates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of each key of an update-mode stream."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v")).select(*keys, "v.*")
