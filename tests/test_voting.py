import itertools

import pytest

from gaugeline.operators import voting

VOTES = "f int, vote_no int, category string, matched_gt_id string, reasoning string"


def vote(category, gt_id=None):
    return (category, gt_id, f"why {category} {gt_id or ''}".strip())


CASES = [
    ([vote("novel")], "novel", None, "1/1", 1),
    ([vote("matched", "H-01")] * 3, "matched", "H-01", "3/3", 3),
    ([vote("matched", "H-01"), vote("matched", "H-01"), vote("fp")], "matched", "H-01", "2/3", 2),
    ([vote("matched", "H-01"), vote("novel"), vote("fp")], "uncertain", None, "no-majority", 0),
    ([vote("matched", "H-01"), vote("matched", "H-02"), vote("novel")], "uncertain", None, "no-majority", 0),
    ([None, None, None], "uncertain", None, "no-majority", 0),
    ([vote("novel"), None, None], "novel", None, "1/3", 1),
    ([vote("fp"), None, vote("fp")], "fp", None, "2/3", 2),
    ([vote("novel"), None, vote("fp")], "uncertain", None, "no-majority", 0),
    ([vote("novel"), vote("fp"), vote("novel"), vote("fp"), vote("novel")], "novel", None, "3/5", 3),
    ([vote("fp"), vote("novel"), vote("novel"), vote("fp")], "fp", None, "2/4", 2),
    ([vote("matched"), vote("matched"), vote("novel")], "matched", None, "2/3", 2),
]


@pytest.fixture
def votes(rows):
    data = [
        (f, n, *(cast or (None, None, None))) for f, (casts, *_) in enumerate(CASES) for n, cast in enumerate(casts)
    ]
    return rows(data, VOTES)


def test_majority_vote(votes):
    got = {r.f: r for r in voting.majority_vote(votes, ["f"]).collect()}
    for f, (_, category, gt_id, agreement, count) in enumerate(CASES):
        r = got[f]
        assert (r.category, r.matched_gt_id, r.agreement, r.agreement_count) == (category, gt_id, agreement, count), f


def test_representative_is_the_earliest_vote_of_the_winning_key(rows):
    frame = rows([(0, 0, "fp", None, "a"), (0, 1, "novel", None, "b"), (0, 2, "novel", None, "c")], VOTES)
    assert voting.majority_vote(frame, ["f"]).first().reasoning == "b"


def test_no_majority_reason(votes):
    got = {r.f: r.reasoning for r in voting.no_majority_reason(votes, ["f"]).collect()}
    assert got[3] == "No majority (matched:H-01, novel:, fp:). why novel"
    assert got[5] == "All 3 vote(s) failed — cannot classify."
    assert got[8] == "No majority (novel:, fp:, 1 failed). why novel"
    assert set(got) == {3, 4, 5, 8}


def test_no_majority_reason_pages_join_to_the_whole_text(rows):
    data = [(0, n, "matched", f"G{n}", "r") for n in range(25)] + [(0, 25, None, None, None)]
    frame = rows(data, VOTES)
    whole = voting.no_majority_reason(frame, ["f"]).first().reasoning
    pages = sorted((r.page, r.reasoning) for r in voting.no_majority_reason(frame, ["f"], page=10).collect())
    assert len(pages) == 3 and "".join(text for _, text in pages) == whole


def test_unknown_gt_id_turns_into_fp(rows):
    gt = rows([("a", "H-01")], "codebase_id string, gt_id string")
    data = [
        ("a", 1, "matched", "H-09", "high", "x"),
        ("a", 2, "novel", "H-01", "high", "y"),
        ("a", 3, "matched", None, "high", "z"),
        ("a", 4, None, None, None, None),
    ]
    frame = rows(data, "codebase_id string, vote_no int, category string, matched_gt_id string, confidence string, reasoning string")
    got = {r.vote_no: r for r in voting.validate_vote_gt(frame, gt).collect()}
    assert (got[1].category, got[1].matched_gt_id, got[1].confidence) == ("fp", None, "low")
    assert got[1].reasoning == 'Invalid GT ID "H-09". x'
    assert (got[2].category, got[2].matched_gt_id) == ("matched", "H-01")
    assert (got[3].category, got[3].matched_gt_id) == ("matched", None)
    assert got[4].category is None


def sequential_dedup(findings):
    """Findings in order; a strictly higher agreement takes over and demotes the earlier leader with its agreement."""
    winners, out = {}, {}
    for index, gt_id, count in findings:
        if gt_id is None:
            out[index] = ("novel", None, "r")
        elif gt_id not in winners:
            winners[gt_id] = (index, count)
            out[index] = ("matched", gt_id, "r")
        elif count > winners[gt_id][1]:
            old, old_count = winners[gt_id]
            out[old] = ("uncertain", None, f"Duplicate GT match for {gt_id} — demoted ({old_count}/3). r")
            winners[gt_id] = (index, count)
            out[index] = ("matched", gt_id, "r")
        else:
            out[index] = ("uncertain", None, f"Duplicate GT match for {gt_id} — demoted. r")
    return out


def test_dedup_equals_the_sequential_rule(rows):
    data, want = [], {}
    for run, counts in enumerate(itertools.product([1, 2, 3], repeat=4)):
        found = [(i, "H-01" if i != 2 else "H-02", c) for i, c in enumerate(counts)] + [(9, None, 1)]
        want[run] = sequential_dedup(found)
        data += [(run, i, 1, "matched" if g else "novel", g, c, f"{c}/3", "r") for i, g, c in found]
    frame = rows(data, "run_id int, position int, finding_index int, category string, matched_gt_id string, agreement_count int, agreement string, reasoning string")
    got = voting.dedup_gt_match(frame).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.category, r.matched_gt_id, r.reasoning) == want[r.run_id][r.position]


def test_three_matches_under_one_printed_number_keep_one(rows):
    data = [("r", p, 1, "matched", "H-01", n, f"{n}/3", "why") for p, n in ((0, 2), (1, 3), (2, 3))]
    frame = rows(data, "run_id string, position int, finding_index int, category string, matched_gt_id string, agreement_count int, agreement string, reasoning string")
    got = {r.position: r.category for r in voting.dedup_gt_match(frame).collect()}
    assert got == {0: "uncertain", 1: "matched", 2: "uncertain"}


def test_dedup_does_not_move_labels_that_lie_by_run(rows):
    data = [(i // 6, i, "matched" if i % 2 else "novel", "H-01" if i % 2 else None, 1 + i % 3, f"{1 + i % 3}/3", "r") for i in range(60)]
    frame = rows(data, "run_id int, position int, category string, matched_gt_id string, agreement_count int, agreement string, reasoning string")
    plan = voting.dedup_gt_match(frame.repartition(4, "run_id"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_dedup_of_missing_keys_and_levels(rows):
    data = [
        (None, 0, "matched", "H-01", 3, "3/3", "r"), (1, 0, "matched", "H-01", None, None, "r"), (1, 1, "matched", "H-01", 1, "1/3", "r"),
        (1, None, "matched", "H-01", 3, "3/3", "r"), (1, 3, None, "H-01", 3, "3/3", "r"), (2, 5, "matched", "H-01", None, None, "r"),
        (2, 4, "matched", "H-01", None, None, "r"),
    ]
    frame = rows(data, "run_id int, position int, category string, matched_gt_id string, agreement_count int, agreement string, reasoning string")
    got = {(r.run_id, r.position): (r.category, r.matched_gt_id) for r in voting.dedup_gt_match(frame).collect()}
    lost = ("uncertain", None)
    assert got == {
        (None, 0): lost, (1, 0): lost, (1, 1): ("matched", "H-01"), (1, None): lost, (1, 3): (None, None), (2, 5): lost, (2, 4): ("matched", "H-01"),
    }


def test_vote_stability(votes):
    r = voting.vote_stability(votes, ["f"]).first()
    assert (r.findings, r.unstable) == (11, 7)
