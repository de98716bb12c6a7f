import random

from pyspark.sql import functions as F

from gaugeline.functions.joins import broadcast_if_small
from gaugeline.functions.numbers import cut_text, half_up, percent
from gaugeline.functions.ordering import last_seen, numbered


def test_numbered_equals_sorted_position_with_a_hot_group(rows):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"g{i % 40}", rng.randint(0, 50), i) for i in range(3000)]
    frame = rows(data, "g string, ts int, id int")
    got = {(r.g, r.id): r.n for r in numbered(frame, ["g"], ["ts", "id"], "n").collect()}
    want = {}
    for g in {d[0] for d in data}:
        for place, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2])), 1):
            want[(g, d[2])] = place
    assert got == want


def test_last_seen_crosses_stretches(rows):
    rng = random.Random(7)
    data = [(k, seq, rng.choice([None, None, None, seq])) for k in ("a", "b") for seq in range(500)]
    frame = rows(data, "k string, seq long, v long")
    got = {(r.k, r.seq): r.seen for r in last_seen(frame, ["k"], ["seq"], F.col("v"), "seen", width=37).collect()}
    seen = {}
    for k, seq, v in data:
        seen[k] = v if v is not None else seen.get(k)
        assert got[(k, seq)] == seen[k]


def test_last_seen_of_sparse_stretches(rows):
    frame = rows([("a", 1, 1), ("a", 1000, None), ("a", 5000, None)], "k string, seq long, v long")
    got = last_seen(frame, ["k"], ["seq"], F.col("v"), "seen", width=10).collect()
    assert {r.seq: r.seen for r in got} == {1: 1, 1000: 1, 5000: 1}


def test_rounding_and_cutting(rows):
    row = rows([(2.5, "abcdefgh")], "x double, t string").select(
        half_up(F.col("x")).alias("r"),
        percent(F.lit(1), F.lit(3)).alias("p"),
        percent(F.lit(1), F.lit(0)).alias("none"),
        cut_text(F.col("t"), 5).alias("cut"),
        cut_text(F.col("t"), 8).alias("whole"),
    ).first()
    assert (row.r, row.p, row.none, row.cut, row.whole) == (3.0, 33, 0, "ab...", "abcdefgh")


def test_broadcast_only_below_the_limit(spark):
    small, large = broadcast_if_small(spark.range(5), 1000), broadcast_if_small(spark.range(500), 1000)
    assert "broadcast" in small._jdf.queryExecution().toString() and small.count() == 5
    assert "broadcast" not in large._jdf.queryExecution().toString() and large.count() == 500
