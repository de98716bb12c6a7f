import itertools
import random

import pytest

from gaugeline.operators import consistency
from gaugeline.operators.consistency import consistency_jaccard

RUNS = "codebase_id string, condition_id string, run_id string, is_valid boolean, is_classified boolean"
LABELS = "run_id string, matched_gt_id string"


def brute_force(sets):
    if len(sets) < 2:
        return None
    scores = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in itertools.combinations(sets, 2)]
    return sum(scores) / len(scores)


def evaluate(rows, groups, limit):
    runs, labels = [], []
    for condition, sets in groups.items():
        for i, ids in enumerate(sets):
            run = f"{condition}-{i}"
            runs.append(("cb", condition, run, True, True))
            labels += [(run, x) for x in ids] + [(run, None)] + [(run, x) for x in list(ids)[:1]]
    gt = rows([("cb", "x")], "codebase_id string, gt_id string")
    out = consistency_jaccard(rows(runs, RUNS), rows(labels, LABELS), gt, tile=limit)
    return {r.condition_id: r.consistency for r in out.collect()}


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_equals_all_pairs(rows, limit):
    rng = random.Random(11)
    universe = [f"G{i}" for i in range(9)]
    groups = {
        "mixed": [set(rng.sample(universe, rng.randint(0, 7))) for _ in range(40)],
        "copies": [{"G1", "G2", "G3", "G4", "G5"}] * 20 + [{"G1"}] * 5 + [set()] * 3,
        "empty": [set(), set(), set()],
        "apart": [{"G1"}, {"G2"}, {"G3", "G4"}],
        "pair": [{"G1", "G2"}, {"G2", "G3"}],
        "single": [{"G1"}],
    }
    got = evaluate(rows, groups, limit)
    for name, sets in groups.items():
        want = brute_force(sets)
        assert got[name] == (None if want is None else pytest.approx(want, abs=1e-12)), name


def test_only_valid_classified_runs_with_ground_truth_count(rows):
    runs = rows(
        [
            ("cb", "c", "1", True, True),
            ("cb", "c", "2", True, True),
            ("cb", "c", "3", False, True),
            ("cb", "c", "4", True, False),
            ("other", "c", "5", True, True),
        ],
        RUNS,
    )
    labels = rows([("1", "G1"), ("2", "G1"), ("3", "G9"), ("5", "G1")], LABELS)
    gt = rows([("cb", "G1")], "codebase_id string, gt_id string")
    out = consistency_jaccard(runs, labels, gt).collect()
    assert [(r.codebase_id, r.consistency) for r in out] == [("cb", 1.0)]


def test_a_set_is_sent_once_per_tile(rows):
    sets = rows([("cb", "c", [str(i)], 1) for i in range(100)] + [("cb", "d", [], 4)], "codebase_id string, condition_id string, ids array<string>, m long")
    for tile, copies in ((consistency.TILE, 1), (100, 1), (40, 3)):
        sizes = consistency.tile_sizes(sets, tile)
        dealt = consistency.in_tiles(sets, sizes)
        assert dealt.filter("condition_id = 'c'").count() == 100 * copies and dealt.filter("condition_id = 'd'").count() == 1


def test_wide_tiles_shrink(rows, monkeypatch):
    monkeypatch.setattr(consistency, "TILE_BITS", 640)
    sets = rows([("cb", "c", [str(i)], 1) for i in range(64)], "codebase_id string, condition_id string, ids array<string>, m long")
    assert consistency.tile_sizes(sets).first().tiles == 7


@pytest.mark.parametrize("small", [1, 2, 4, 6])
def test_small_and_large_sets_meet(rows, monkeypatch, small):
    monkeypatch.setattr(consistency, "SMALL", small)
    rng = random.Random(small)
    universe = [f"G{i}" for i in range(12)]
    sets = [set(rng.sample(universe, rng.choice([0, 1, 1, 2, 3, 5, 6, 7, 9]))) for _ in range(60)] + [{"G1", "G2"}] * 9
    groups = {"mixed": sets, "low": [s for s in sets if len(s) <= small], "high": [s for s in sets if len(s) > small]}
    for limit in (7, 1024):
        got = evaluate(rows, groups, limit)
        assert got == {name: pytest.approx(brute_force(own), abs=1e-12) for name, own in groups.items()}


def test_many_small_sets_are_not_compared(rows, monkeypatch):
    def compared(batches):
        raise AssertionError("sets of two ids need no tiles")

    monkeypatch.setattr(consistency, "tile_totals", compared)
    sets = [{f"G{i}", f"G{i // 2}"} for i in range(200)]
    assert evaluate(rows, {"c": sets}, consistency.TILE) == {"c": pytest.approx(brute_force(sets), abs=1e-12)}


def test_a_few_larger_sets_are_not_compared(rows, monkeypatch):
    def compared(batches):
        raise AssertionError("a few sets of up to 12 ids need no tiles")

    monkeypatch.setattr(consistency, "tile_totals", compared)
    sets = [{f"G{i}", f"G{i // 2}"} for i in range(200)] + [{f"G{i}" for i in range(at, at + 7 + at % 6)} for at in (0, 1, 5)]
    assert evaluate(rows, {"c": sets}, consistency.TILE) == {"c": pytest.approx(brute_force(sets), abs=1e-12)}
