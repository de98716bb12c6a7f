"""Exact dedup: groups against a plain grouping, across partition borders, and edge cases."""

import random
from collections import defaultdict
from hashlib import sha256

from gaugeline.llm import exact_dedup


def plain(data):
    groups = defaultdict(list)
    for doc_id, text in data:
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups[norm].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, doc_id in members:
            out.append((doc_id, keep, len(members), doc_id == keep, sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(frame):
    rows = exact_dedup.exact_dedup(frame)
    return sorted(map(tuple, rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups_equal_plain_grouping(spark):
    rng = random.Random(6)
    pool = ["alpha beta", "alpha  beta", "alphabeta", "Alpha beta", "x", "", " \n", None, "é é", "éé", " x", "long " * 30_000]
    data = [(i, rng.choice(pool)) for i in rng.sample(range(10**6), 300)]
    data += [(None, "x"), (None, None), (5, "same"), (5, "same"), (6, "same"), (7, "sa me")]
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as norm", "2 as head", "3 as part")
    assert answers(frame) == plain(data)
    assert answers(frame.limit(0)) == []


def test_a_group_spread_over_many_partitions(spark):
    data = [(i, "copy of one text" + " " * (i % 3)) for i in range(2000)] + [(10_000 + i, f"other {i}") for i in range(50)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert answers(frame) == plain(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
