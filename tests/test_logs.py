import json

import pytest

from gaugeline.operators import logs, scope


def use(id_, name="Agent", **given):
    return {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": id_, "name": name, "input": given}]}}


def result(id_, content, error=None):
    block = {"type": "tool_result", "tool_use_id": id_, "content": content}
    if error is not None:
        block["is_error"] = error
    return {"type": "user", "message": {"content": [block]}}


def init(*commands):
    return {"type": "system", "subtype": "init", "slash_commands": list(commands), "model": "m"}


DONE = {"type": "result", "stop_reason": "end_turn", "num_turns": 3}
LONG = "found\n" + "\n".join(f"line {i}" for i in range(12))

LOGS = {
    "good-bare": [init(), {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}]}}, DONE],
    "leaky-bare": [init("auditor"), use("s", "Skill"), DONE],
    "good-skill": [init("auditor")] + [e for i in range(4) for e in (use(f"a{i}", description=f"scan {i}"), result(f"a{i}", LONG))] + [DONE],
    "bad-skill": [
        init("auditor"), use("a1", description="one", model="small"), use("a2", description="two"), use("a3"),
        result("a1", [{"type": "text", "text": "x\ny"}, {"type": "image"}, {"type": "text", "text": "z"}]),
        result("a2", "boom", error=True), result("zz", "late", error=True), use("r", "Read", file_path="/w/skill/src/A.sol"),
        result("r", "agent-1-bundle.md: 0 lines\nAgent 2 bundle: 30 lines"), result("r", "agent-1-bundle: 7 lines"), init("auditor"),
        {"type": "result", "stop_reason": "max_tokens"}, DONE],
}


@pytest.fixture
def events(rows):
    lines = [(run, seq, json.dumps(e)) for run, es in LOGS.items() for seq, e in enumerate(es)]
    lines += [("good-bare", 50, ""), ("good-bare", 51, '{"type":'), ("good-bare", 52, "  ")]
    return logs.parse_events(rows(lines, "run_id string, seq long, raw string"))


@pytest.fixture
def facts(rows, events):
    runs = rows(
        [("good-bare", "bare", 143, True, None), ("leaky-bare", "bare", 0, False, None), ("good-skill", "skill", 0, False, None),
         ("bad-skill", "skill", 1, True, 2), ("absent", "bare", 143, True, None)],
        "run_id string, mode string, exit_code int, timed_out boolean, expected_min_agents int",
    )
    output = rows([("good-bare", 10), ("leaky-bare", 9), ("good-skill", 50), ("bad-skill", 49)], "run_id string, output_lines int")
    return logs.run_facts(runs, events, output)


def test_malformed_lines_are_dropped(events):
    assert events.filter("run_id = 'good-bare'").count() == 3


def test_checks(facts):
    checks = {}
    for r in logs.check_rows(facts).collect():
        checks.setdefault(r.run_id, {})[r.check] = r.ok
    assert all(checks["good-bare"].values()) and all(checks["good-skill"].values())
    assert {c for c, ok in checks["leaky-bare"].items() if not ok} == {"no_skill_calls", "bare_no_skill_visible", "has_output"}
    assert {c for c, ok in checks["bad-skill"].items() if not ok} == {
        "exit_code", "stop_reason", "agents_all_returned", "agents_no_errors", "agents_result_quality", "has_output"}
    assert checks["bad-skill"]["bundle_quality"] and checks["bad-skill"]["agents_spawned"]
    assert {c for c, ok in checks["absent"].items() if not ok} == {
        "exit_code", "not_timed_out", "has_events", "has_result", "has_output"}
    assert "stop_reason" not in checks["absent"] and "bare_no_skill_visible" not in checks["absent"]
    verified = {r.run_id: r.passed for r in logs.verify_runs(logs.check_rows(facts)).collect()}
    assert verified == {"good-bare": True, "good-skill": True, "leaky-bare": False, "bad-skill": False, "absent": False}


def test_warnings(facts):
    got = {(r.run_id, r.warning, r.amount) for r in logs.warning_rows(facts).collect()}
    assert got == {("bad-skill", "tool_errors", 2), ("bad-skill", "bundle_retry", 1), ("bad-skill", "restarted_session", 2)}


def test_agent_spans_and_errors(events):
    blocks = logs.content_blocks(events).filter("run_id = 'bad-skill'")
    spans = {r.tool_use_id: r for r in logs.agent_spans(blocks, stretch=2).collect()}
    assert (spans["a1"].description, spans["a1"].model, spans["a1"].returned, spans["a1"].return_lines) == ("one", "small", True, 3)
    assert spans["a2"].returned_error and not spans["a3"].returned and spans["a3"].model == "default"
    errors = {(r.tool, r.error) for r in logs.tool_errors(blocks).collect()}
    assert errors == {("Agent", "boom"), ("unknown", "late")}
    bundles = {r.bundle: (r.lines, r.was_empty) for r in logs.bundle_quality(blocks).collect()}
    assert bundles == {"agent-1-bundle": (7, True), "agent-2-bundle": (30, False)}


def test_a_result_binds_to_the_latest_earlier_call(rows):
    order = [use("a", description="first"), result("a", "1"), use("a", description="second"), result("a", "1\n2"), result("a", "1\n2\n3")]
    lines = [("r", seq * 10, json.dumps(e)) for seq, e in enumerate(order)] + [("r", 100, json.dumps(use("a", description="third")))]
    blocks = logs.content_blocks(logs.parse_events(rows(lines, "run_id string, seq long, raw string")))
    for stretch in (5, 25, 1000):
        got = {r.description: (r.returned, r.return_lines) for r in logs.agent_spans(blocks, stretch).collect()}
        assert got == {"first": (True, 1), "second": (True, 3), "third": (False, 0)}


def test_cost_and_model(rows):
    lines = [("r", 0, '{"type":"assistant","message":{"content":[]}}'), ("r", 1, '{"type":"assistant","message":{"model":"m1"}}'),
             ("r", 2, '{"type":"result","total_cost_usd":1.5}'), ("r", 3, '{"type":"result","total_cost_usd":9}')]
    events = logs.parse_events(rows(lines, "run_id string, seq long, raw string"))
    assert logs.run_cost(events).first().cost_usd == 1.5
    assert logs.run_model(events).first().model == "m1"


def test_scope(rows, monkeypatch, events):
    listed = rows(
        [("cb", "src/A.sol", True), ("cb", "src/B.sol", False), ("cb", "mock/Mocker.sol", False), ("cb", "x/Errors.sol", False),
         ("cb", "x/Abc.sol", False), ("cb", "x/Other.t.sol", False)], "codebase_id string, path string, in_scope boolean")
    runs = rows([("bad-skill", "cb", "skill", "skill"), ("t", "cb", "bare", "bare")],
                "run_id string, codebase_id string, condition_id string, mode string")
    reads = scope.files_read(logs.content_blocks(events), runs)
    assert [(r.run_id, r.path) for r in reads.collect()] == [("bad-skill", "src/A.sol")]
    got = {r.run_id: (r.in_scope_read, r.out_of_scope_read, r.ok) for r in scope.scope_compliance(reads, runs, listed).collect()}
    assert got == {"bad-skill": (1, 0, True), "t": (0, 0, False)}
    names = scope.oos_names(listed)
    assert {r.name for r in names.collect()} == {"Mocker", "Other.t"}
    texts = [("the mockers", 0), ("Mocker.sol:3", 1), ("the contract  MOCKER is", 1), ("finding 3: in Mocker", 1), ("finding\nMocker", 0),
             ("aMocker.sol", 0), ("findings of Mocker_x", 0), ("see Other.t.sol", 1)]
    reports = rows([(f"t{i}", text) for i, (text, _) in enumerate(texts)], "run_id string, text string")
    owners = rows([(f"t{i}", "cb") for i in range(len(texts))], "run_id string, codebase_id string")
    want = {f"t{i}" for i, (_, hit) in enumerate(texts) if hit}
    assert {r.run_id for r in scope.oos_mentions(reports, owners, names).collect()} == want
    monkeypatch.setattr(scope, "MAX_BROADCAST_BYTES", -1)
    assert {r.run_id for r in scope.oos_mentions(reports, owners, names).collect()} == want


def test_canary(rows):
    runs = rows([("b", "cb", "bare"), ("s", "cb", "skill"), ("o", "other", "bare")], "run_id string, codebase_id string, mode string")
    mark = "BENCHMARK_CANARY_SKILL_V2_kx1"
    texts = rows([("b", f"x {mark} y"), ("b", f"again {mark}"), ("s", mark), ("o", mark), ("b", mark + "z")], "run_id string, text string")
    canaries = rows([("cb", "skill_v2", mark)], "codebase_id string, condition_id string, canary string")
    assert [(r.run_id, r.canary) for r in scope.canary_leak(texts, runs, canaries).collect()] == [("b", mark)]


def test_scope_checks_apply_where_there_is_a_scope_list(rows):
    runs = rows([("in", "cb", "skill", "skill"), ("out", "cb", "bare", "bare"), ("free", "zz", "bare", "bare")],
                "run_id string, codebase_id string, condition_id string, mode string")
    runs = runs.selectExpr("*", "0 as exit_code", "false as timed_out", "cast(null as int) as expected_min_agents")
    reads = rows([("in", "a.sol"), ("out", "b.sol")], "run_id string, path string")
    listed = rows([("cb", "a.sol", True), ("cb", "b.sol", False)], "codebase_id string, path string, in_scope boolean")
    mentions = rows([("out", "Mocker")], "run_id string, name string")
    events = logs.parse_events(rows([("in", 0, '{"type":"result"}')], "run_id string, seq long, raw string"))
    none = rows([], "run_id string, output_lines int")
    facts = logs.run_facts(runs, events, none, scope.scope_compliance(reads, runs, listed), mentions)
    got = {(r.run_id, r.check): r.ok for r in logs.check_rows(facts).collect() if r.check.startswith("scope")}
    assert got == {("in", "scope_no_oos_findings"): True, ("in", "scope_in_scope_read"): True,
                   ("out", "scope_no_oos_findings"): False, ("out", "scope_in_scope_read"): False}
    warned = {(r.run_id, r.warning) for r in logs.warning_rows(facts).collect()}
    assert warned == {("out", "bare_read_out_of_scope")}
    assert not [r for r in logs.check_rows(logs.run_facts(runs, events, none)).collect() if r.check.startswith("scope")]
