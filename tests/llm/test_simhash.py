"""SimHash: fingerprints and components against brute force."""

import random

import pytest
import xxhash

from gaugeline.llm import simhash
from gaugeline.llm.components import components


def plain_print(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(b" ".join(s), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def plain_components(prints, radius=4):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    kept = simhash.masks(2)
    for a in range(64):
        for b in range(a):
            flipped = 1 << a | 1 << b
            assert any(not m & flipped for m in kept)
    rng = random.Random(1)
    for _ in range(2000):
        flipped = sum(1 << x for x in rng.sample(range(64), 4))
        assert any(not m & flipped for m in simhash.masks(4))


@pytest.mark.parametrize("dense", [4096, 2])
def test_components_equal_brute_force(spark, dense):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    data = []
    for i in range(90):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        data.append((i * 3 + 1, " ".join(t).upper() if i % 5 == 0 else " ".join(t)))
    data += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "One  TWO"), (1005, "x " * 3000), (1006, "é É")]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", simhash.F.lit(1))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame, dense=dense).collect()}
    want = {i: plain_print(t) for i, t in data}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in want.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(want)


def test_repeated_rows_null_ids_and_empty_table(spark):
    data = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx ww vv")]
    rows = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.copies) for r in rows) == [(0, 0, 1), (0, 5, 3), (5, 5, 3), (5, 5, 3)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_hubs_and_random_edges(spark):
    rng = random.Random(3)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges += [(5, 5), (-3, 7)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
