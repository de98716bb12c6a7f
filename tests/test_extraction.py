import pytest

from gaugeline.operators import extraction, judging

STRUCTURED = """🔐 Security Review

[90] **1. Reentrancy when Pool.exit pays out**
`Pool.exit` · Confidence: 90

Funds leave before the balance is written.

[70] **2. Missing Access Control for fees**
Nobody checks the caller.
```solidity
function setFee() external {}
```
Any account may call it.

| # | Confidence | Title |
|---|---|---|
| 1 | [90] | Reentrancy |
| 2 | [70] | Missing Access Control |
"""

SAMPLES = {
    "word": (
        "# Audit\n\n### [CRITICAL] Reentrancy in Pool.exit\n\nPays first.\n\n"
        "### [low] Floating Pragma in `build()` — Pool.sol:3-9\n\nNot pinned.\n\n| High | 2 | x |\n| Low | y |",
        [("CRITICAL", "Reentrancy in Pool.exit", "Pool.exit", "pool::exit::reentrancy", "Pays first."),
         ("LOW", "Floating Pragma in `build()`", "Pool.build", "pool::build::other", "Not pinned. | High | 2 | x | | Low | y |")],
        3,
    ),
    "prefix": (
        "### H-1: Flash Loan against Oracle.read\nSpot price.\n### C-2. Unbounded loop\nGrows.\n### i-3: Note\nInfo.",
        [("HIGH", "Flash Loan against Oracle.read", "Oracle.read", "oracle::read::flash-loan", "Spot price."),
         ("CRITICAL", "Unbounded loop", None, "unknown::unbounded-loop", "Grows."),
         ("INFO", "Note", None, "unknown::note", "Info.")],
        None,
    ),
    "bracket": (
        "## [M-1] Unchecked return in Bridge.send\nIgnored.",
        [("MEDIUM", "Unchecked return in Bridge.send", "Bridge.send", "bridge::send::unchecked-return", "Ignored.")],
        None,
    ),
    "trailing": (
        "### 1. Overflow in mint — **HIGH**\nWraps.",
        [("HIGH", "Overflow in mint", None, "unknown::overflow-mint", "Wraps.")],
        None,
    ),
    "paren": (
        "#### 4. Sandwich on `swap` (Medium)\nNo limit.",
        [("MEDIUM", "Sandwich on `swap`", "swap", "swap::frontrunning", "No limit.")],
        None,
    ),
    "inline": (
        "**1. [HIGH] Delegatecall to user target — Proxy.sol:9**\nAny target.",
        [("HIGH", "Delegatecall to user target", "Proxy", "proxy::delegatecall", "Any target.")],
        None,
    ),
    "section": (
        "## Critical / High Severity\n\n## Vault.sol\n\n### 1. Price set in `open()`\nStale.\n\n## Summary\n\n### 2. Not a finding\nText.",
        [("HIGH", "Price set in `open()`", "Vault.open", "vault::open::other", "Stale.")],
        None,
    ),
    "confidence": (
        "## [85] 1. Denial of service in loop\nLong list.",
        [("[85]", "Denial of service in loop", None, "unknown::denial-service-loop", "Long list.")],
        None,
    ),
}


@pytest.fixture
def reports(rows):
    data = [("structured", STRUCTURED), ("empty", ""), ("prose", "nothing\nto see")] + [(k, v[0]) for k, v in SAMPLES.items()]
    return rows(data, "run_id string, text string")


def test_structured_report(reports):
    found = extraction.extract_findings(reports).filter("run_id = 'structured'").orderBy("index").collect()
    assert [(f["index"], f.confidence, f.title, f.location, f.root_cause, f.severity) for f in found] == [
        (1, 90, "Reentrancy when Pool.exit pays out", "Pool.exit", "pool::exit::reentrancy", None),
        (2, 70, "Missing Access Control for fees", None, "unknown::missing-access-control-for", None),
    ]
    assert found[0].description == "Funds leave before the balance is written."
    assert found[1].description.startswith("Nobody checks the caller.  Any account may call it.")
    assert "setFee" not in found[1].description


def test_free_form_reports(reports):
    found = extraction.extract_findings(reports).orderBy("run_id", "index").collect()
    for name, (_, want, _) in SAMPLES.items():
        got = [(f.severity, f.title, f.location, f.root_cause, f.description) for f in found if f.run_id == name]
        assert got == want, name
        assert [f["index"] for f in found if f.run_id == name] == list(range(1, len(want) + 1))


def test_results_per_run(reports):
    got = {r.run_id: r for r in extraction.parse_results(reports).collect()}
    assert (got["structured"].format, got["structured"].reported_count, got["structured"].parsed) == ("skill", 2, 2)
    assert (got["empty"].format, got["empty"].parsed, got["empty"].raw_finding_estimate) == ("unknown", 0, 0)
    assert got["prose"].format == "unknown" and got["empty"].parser_coverage is None
    for name, (_, want, stated) in SAMPLES.items():
        assert got[name].format == "bare" and got[name].parsed == len(want), name
        assert got[name].reported_count == stated, name
        assert got[name].raw_finding_estimate >= len(want)


def test_estimate_needs_a_severity_heading_within_twenty_lines(rows):
    near = "## High Severity\n" + "x\n" * 18 + "### 1. Counted\n"
    far = "## High Severity\n" + "x\n" * 21 + "### 1. Not counted\n"
    frame = rows([("near", near), ("far", far)], "run_id string, text string")
    assert {r.run_id: r.estimate for r in extraction.estimate_raw_findings(frame).collect()} == {"near": 1, "far": 0}


def test_long_description_is_cut(rows):
    frame = rows([("a", "### [LOW] T\n" + "word " * 100)], "run_id string, text string")
    text = extraction.extract_findings(frame).first().description
    assert len(text) == 300 and text.endswith("...")


def test_unmatched_blocks(rows):
    text = (
        "## Report\n\n### [HIGH] Known Reentrancy Bug\n\nText.\n\n### Missed Overflow Problem\n\nAn integer overflow.\n"
        "### Known reentrancy bug again\nattack\n## Summary\nattack\n"
    )
    frame = rows([("a", text), ("b", "## Summary\n\nattack\n\n## Methodology\n\nattack")], "run_id string, text string")
    got = extraction.unmatched_blocks(frame, extraction.extract_findings(frame)).collect()
    assert [(r.run_id, r.snippet) for r in got] == [("a", "### Missed Overflow Problem\nAn integer overflow.")]


def test_at_most_ten_unmatched_blocks(rows):
    frame = rows([("a", "\n".join(f"### Unparsed attack {i}" for i in range(15)))], "run_id string, text string")
    got = extraction.unmatched_blocks(frame, extraction.extract_findings(frame)).orderBy("block_no").collect()
    assert [r.snippet for r in got] == [f"### Unparsed attack {i}" for i in range(10)]


def test_context_and_recovered(rows):
    text = "intro\n### [HIGH] `Pool` *drain* by anyone who calls exit\n" + "\n".join(f"l{i}" for i in range(60))
    frame = rows([("a", text)], "run_id string, text string")
    findings = extraction.extract_findings(frame)
    context = extraction.finding_context(frame, findings).first().context.split("\n")
    assert context[0].startswith("### [HIGH]") and len(context) == 40 and context[-1] == "l38"
    other = findings.withColumn("title", findings.title.substr(1, 0))
    assert extraction.finding_context(frame, other).first().context.split("\n")[0] == "intro"
    answers = rows(
        [("a", 0, "New", "HIGH", None, "Bad  Math", None), ("b", 0, "Only", None, "X.y", "", "d")],
        "run_id string, position int, title string, severity string, location string, vulnerability_type string, description string",
    )
    got = {(r.run_id, r["index"]): r for r in extraction.recovered_findings(findings, answers).collect()}
    assert (got[("a", 2)].root_cause, got[("a", 2)].recovered) == ("Unknown::bad-math", True)
    assert (got[("b", 1)].root_cause, got[("b", 1)].vuln_type) == ("X.y::unknown", "unknown")
    assert got[("a", 1)].recovered is False


def test_two_findings_under_one_number_keep_their_own_context(rows):
    text = "🔐 Security Review\n[90] **1. First bug here**\nfirst body\n[80] **1. Second bug there**\nsecond body"
    frame = rows([("a", text)], "run_id string, text string")
    findings = extraction.extract_findings(frame)
    assert [f["index"] for f in findings.collect()] == [1, 1]
    contexts = {r.position: r.context.split("\n")[1] for r in extraction.finding_context(frame, findings).collect()}
    assert contexts == {1: "first body", 3: "second body"}
    gt = rows([("cb",)], "codebase_id string")
    asked = judging.classify_requests(
        findings.selectExpr("*", "'cb' as codebase_id"), extraction.finding_context(frame, findings), gt
    )
    assert sorted((r.position, r.finding_index, r.context.split("\n")[1]) for r in asked.collect()) == [
        (1, 1, "first body"), (3, 1, "second body")
    ]


def test_narrative_and_assistant_text(rows):
    narratives = rows([("n", "130% of $12.5 and $250 at 40%")], "narrative_id string, text string")
    got = {(r.kind, r.value) for r in extraction.narrative_number_check(narratives).collect()}
    assert got == {("percentage", 130.0), ("cost", 250.0)}
    blocks = rows([("a", 2, 0, "c"), ("a", 1, 1, "b"), ("a", 1, 0, "a"), ("a", 3, 0, "")], "run_id string, seq long, pos int, text string")
    assert extraction.assistant_text(blocks).first().text == "a\nb\nc"
    pages = extraction.assistant_text(blocks, page=2).orderBy("page").collect()
    assert "\n".join(p.text for p in pages) == "a\nb\nc"
