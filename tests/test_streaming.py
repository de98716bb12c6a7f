"""Streams over several micro-batches must agree with the batch operators."""

import datetime as dt
import json

import pandas as pd
import pytest

from gaugeline.operators import logs
from gaugeline.session import state_session
from gaugeline.streaming import monitor

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
LINES = "run_id long, seq long, ts timestamp, raw string"


def assistant(*blocks, parent=None):
    return {"type": "assistant", "parent_tool_use_id": parent, "message": {"content": list(blocks)}}


def use(id_, name="Agent"):
    return {"type": "tool_use", "id": id_, "name": name, "input": {}}


def back(id_):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": id_, "content": "ok"}]}}


INIT = {"type": "system", "subtype": "init"}
DONE = {"type": "result", "stop_reason": "end_turn", "num_turns": 9, "total_cost_usd": 1.5}

EVENTS = [  # run, second, event
    (1, 0, INIT), (1, 1, assistant(use("a"), use("r", "Read"))), (1, 2, back("a")), (1, 3, assistant(use("a"))),
    (1, 4, back("zz")), (1, 5, assistant(use("b"), parent="a")), (1, 6, back("a")), (1, 7, back("a")),
    (2, 1, INIT), (2, 2, assistant({"type": "text", "text": "x"})), (1, 20, DONE), (1, 25, INIT), (1, 90, INIT),
    (3, 95, INIT), (2, 30, {"type": "rate_limit_event", "rate_limit_info": {"status": "rejected"}}),
    (2, 31, {"type": "rate_limit_event", "rate_limit_info": {"status": "allowed"}}), (3, 700, DONE), (4, 800, INIT),
    (4, 810, DONE), (5, 900, INIT),
]


@pytest.fixture
def batch_lines(rows):
    data = [(run, seq, START + dt.timedelta(seconds=at), json.dumps(event)) for seq, (run, at, event) in enumerate(EVENTS)]
    return rows(data + [(1, 99, START, "{broken"), (1, 100, START, "")], LINES)


@pytest.fixture
def source(batch_lines, tmp_path):
    """The lines in five files, read one per micro-batch."""
    folder = tmp_path / "lines"
    for part in range(5):
        batch_lines.filter(f"seq div 4 = {part} or ({part} = 0 and seq > 90)").coalesce(1).write.mode("append").parquet(str(folder))
    return folder


@pytest.fixture
def stream(spark, source):
    return events_of(spark, source)


@pytest.fixture
def replayed(spark, source):
    """The same in a session for state with maps."""
    return events_of(state_session(spark, clock=False), source)


def events_of(spark, source):
    reader = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1)
    return monitor.stream_events(reader.parquet(str(source)))


def test_counters_and_summary(stream, replayed, tmp_path):
    counts = monitor.run_to_table(monitor.live_counters(stream), "update", str(tmp_path / "a"))
    assert {(r.run_id, r.counter): r.n for r in monitor.counter_totals(counts).collect()} == {
        (1, "turns"): 2, (1, "tool:Agent"): 3, (1, "tool:Read"): 1, (1, "spawns"): 3, (2, "turns"): 1}
    progress = monitor.run_to_table(monitor.run_progress(stream), "update", str(tmp_path / "b"))
    agents = monitor.run_to_table(monitor.active_agents(replayed), "update", str(tmp_path / "d"))
    done = monitor.run_done(progress, counts, agents)
    got = {r.run_id: (r.turns, r.agents, r.returned, r.tools, r.stop_reason, r.cost_usd) for r in done.collect()}
    assert got == {1: (9, 3, 2, "Agent:3, Read:1", "end_turn", 1.5), 3: (9, 0, 0, "none", "end_turn", 1.5),
                   4: (9, 0, 0, "none", "end_turn", 1.5)}
    limited = monitor.run_to_table(monitor.rate_limits(stream), "append", str(tmp_path / "c"))
    assert [(r.run_id, r.status) for r in limited.collect()] == [(2, "rejected")]


def test_open_agents_equal_the_batch_spans(replayed, batch_lines, tmp_path):
    rows = monitor.run_to_table(monitor.active_agents(replayed), "update", str(tmp_path / "a"))
    state = {(r.run_id, r.tool_use_id): r for r in monitor.agent_totals(rows).collect()}
    assert (state[(1, "a")].spawns, state[(1, "a")].returns, state[(1, "a")].is_open) == (2, 2, False)
    assert (state[(1, "b")].is_open, state[(1, "zz")].returns) == (True, 0)
    spans = logs.agent_spans(logs.content_blocks(logs.parse_events(batch_lines))).collect()
    assert {(r.run_id, r.tool_use_id) for r in spans if not r.returned} == {k for k, r in state.items() if r.is_open}


def test_life_cycle(stream, tmp_path):
    rows = monitor.run_to_table(monitor.life_cycle(stream, delay="0 seconds"), "append", str(tmp_path / "a"))
    origin = int(START.timestamp() * 1000)
    phases = {(r.run_id, r.phase, (r.at_ms - origin) / 1000) for r in rows.collect()}
    assert {p for p in phases if p[0] == 1} == {(1, "started", 0), (1, "result", 20), (1, "restart", 25), (1, "closed", 35)}
    assert {p for p in phases if p[0] in (2, 3)} == {
        (2, "started", 1), (2, "stuck", 601), (3, "started", 95), (3, "stuck", 695)}
    assert {p for p in phases if p[0] == 4} == {(4, "started", 800), (4, "result", 810), (4, "closed", 825)}
    assert {p for p in phases if p[0] == 5} == {(5, "started", 900)}
    assert monitor.stuck_runs(rows).count() == 2 and monitor.result_grace(rows).count() == 5


def state_sizes(stream, mode, folder):
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.count())
        .option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_ends(spark, rows, tmp_path):
    """Every batch holds one run an hour later than the one before: state must not grow with the runs."""
    source = tmp_path / "runs"
    for run in range(6):
        data = [(0, INIT), (1, assistant(use("a"))), (2, back("a")), (3, assistant(use("b"))), (9, DONE)]
        at = START + dt.timedelta(hours=3 * run)
        lines = [(run, run * 10 + i, at + dt.timedelta(seconds=s), json.dumps(e)) for i, (s, e) in enumerate(data)]
        rows(lines, LINES).coalesce(1).write.mode("append").parquet(str(source))
    reader = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1)
    events = monitor.stream_events(reader.parquet(str(source)))
    for name, (stream, mode) in {
        "counters": (monitor.live_counters(events), "update"),
        "progress": (monitor.run_progress(events), "update"),
        "life": (monitor.life_cycle(events), "append"),
    }.items():
        sizes = state_sizes(stream, mode, tmp_path / name)
        assert max(sizes) <= 8 and any(b < a for a, b in zip(sizes, sizes[1:])), (name, sizes)


def test_state_functions_run_where_the_package_is_missing(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = {"OpenCalls": monitor.OpenCalls(1), "RunLife": monitor.RunLife(1, 2, 3), "function": monitor._life_cycle(1, 2, 3)}
    for name, function in functions.items():
        file = tmp_path / name
        file.write_bytes(cloudpickle.dumps(function))
        code = f"from pyspark import cloudpickle; print(type(cloudpickle.loads(open({str(file)!r}, 'rb').read())).__name__)"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
        assert done.stdout.strip() == name, done.stderr


def started(stream, folder, rows, mode="append"):
    def save(batch, number):
        rows.extend((r.run_id, r.phase) if "phase" in batch.columns else (r.run_id, r.tool_use_id, r.is_open, r.returns) for r in batch.collect())

    return (
        stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", str(folder))
        .trigger(processingTime="500 milliseconds").start()
    )


def wait_for(query, condition, seconds=60):
    import time

    end = time.monotonic() + seconds
    while not condition():
        assert query.exception() is None and time.monotonic() < end
        time.sleep(0.2)


def test_a_silent_run_closes_by_the_clock(spark, rows, tmp_path):
    """No event of any run follows; a restart within the grace is marked, one after it is ignored."""
    source, found = tmp_path / "lines", []

    def add(*lines):
        data = [(run, seq, START, json.dumps(event)) for run, seq, event in lines]
        rows(data, LINES).coalesce(1).write.mode("append").parquet(str(source))

    add((1, 0, INIT), (2, 1, INIT))
    events = monitor.stream_events(state_session(spark).readStream.schema(LINES).parquet(str(source)))
    query = started(monitor.live_life_cycle(events, 8_000, 25_000, 3_600_000), tmp_path / "state", found)
    try:
        wait_for(query, lambda: len(found) == 2)
        add((1, 2, DONE))
        wait_for(query, lambda: (1, "result") in found)
        add((1, 3, INIT))
        wait_for(query, lambda: (1, "restart") in found)
        wait_for(query, lambda: (1, "closed") in found)
        add((1, 4, INIT), (1, 5, DONE), (3, 6, INIT), (3, 7, DONE))
        wait_for(query, lambda: (2, "stuck") in found and (3, "closed") in found)
    finally:
        query.stop()
    assert sorted(found) == [(1, "closed"), (1, "restart"), (1, "result"), (1, "started"), (2, "started"), (2, "stuck"),
                             (3, "closed"), (3, "result"), (3, "started")]


def test_calls_that_stay_open_expire(spark, rows, tmp_path):
    source, found = tmp_path / "lines", []

    def add(*lines):
        data = [(run, seq, START, json.dumps(event)) for run, seq, event in lines]
        rows(data, LINES).coalesce(1).write.mode("append").parquet(str(source))

    add((1, 0, assistant(use("a"))), (1, 1, assistant(use("b"))))
    events = monitor.stream_events(state_session(spark).readStream.schema(LINES).parquet(str(source)))
    query = started(monitor.active_agents(events, 6_000), tmp_path / "state", found, "update")
    try:
        wait_for(query, lambda: len(found) == 2)
        add((1, 2, back("a")))
        wait_for(query, lambda: (1, "a", False, 1) in found or (1, "a", False, 0) in found)
        wait_for(query, lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
        add((1, 3, back("b")))
        wait_for(query, lambda: any(r[:3] == (1, "b", False) for r in found))
    finally:
        query.stop()
    assert (1, "b", False, 0) in found


class Calls(dict):
    """A map state that counts what it is asked."""

    asked = 0

    def exists(self):
        return len(self) > 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    updateValue, removeKey = dict.__setitem__, dict.__delitem__


def test_calls_of_many_runs_share_a_key():
    state, calls = monitor.OpenCalls(1), Calls()
    state.open = calls
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 5})()

    def counted(*rows):
        frame = pd.DataFrame(rows, columns=["run_id", "tool_use_id", "seq", "pos", "is_spawn"])
        found = pd.concat(state.handleInputRows((0,), iter([frame[1:], frame[:1]]), clock))
        return [tuple(r) for r in found.itertuples(index=False)]

    first = counted((1, "a", 0, 0, False), (1, "a", 1, 0, True), (2, "a", 1, 0, True), (1, "b", 2, 0, True), (2, "a", 2, 1, True), (2, "a", 3, 0, False))
    assert first == [(1, "a", True, 1, 0), (1, "b", True, 1, 0), (2, "a", False, 2, 1)]
    assert calls.asked == 0 and set(calls) == {(1, "a"), (1, "b")}
    assert counted((1, "a", 4, 0, False), (1, "a", 5, 0, False), (3, "a", 4, 0, False)) == [(1, "a", False, 0, 1), (3, "a", False, 0, 0)]
    assert set(calls) == {(1, "b")} and calls.asked == 2
