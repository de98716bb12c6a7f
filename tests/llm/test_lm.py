"""Language model: Elias-Fano parts, and scores against a plain bigram model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeline.llm import lm
from gaugeline.llm.elias_fano import EliasFano, Trie


@pytest.mark.parametrize("universe", [50, 10_000, 1 << 40, 1 << 62])
def test_elias_fano_reads_and_searches(universe):
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, universe, 700).astype(np.uint64))
    sequence = EliasFano(*EliasFano.parts(values, universe))
    assert (sequence.get(np.arange(700)) == values).all()
    asked = np.concatenate((values[::7], rng.integers(0, universe, 300).astype(np.uint64)))
    zero, full = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), 700)
    assert (sequence.successor(asked, zero, full) == np.searchsorted(values, asked)).all()
    first, last = zero + 100, zero + 400
    assert (sequence.successor(asked, first, last) == np.clip(np.searchsorted(values, asked), 100, 400)).all()


def held_out(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain(data, mu=lm.MU):
    lists = [(i, (t or "").encode().lower().split() + [None]) for i, t in data]
    train = [x for i, x in lists if not held_out(i)]
    counts = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip([0, *x], x))
    n, v = sum(counts.values()), len(counts)
    context = counts | Counter({0: len(train)})
    out = []
    for i, x in lists:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)
        score = sum(
            math.log10((pairs[c, w] + mu * max(counts[w], 1) / (n + 1)) / (context[c] + mu)) for c, w in zip([0, *x], x)
        )
        out.append((i, held_out(i), len(x), sum(counts[w] > 0 for w in x), n, round(base, 6), score))
    return sorted(out, key=str)


def check(got, want):
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got], key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], abs=2e-6) and a[6] == pytest.approx(b[6], rel=1e-4, abs=1e-3)


def test_scores_equal_plain_model(spark):
    rng = random.Random(9)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(80)] + ["É", "Straße", "X,"]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(80)))) for i in range(160)]
    data += [(None, "the of w1"), (500, None), (501, ""), (502, " \n"), (503, "the " * 30_000), (7, "same row"), (7, "same row")]
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as row", "2 as shard", "3 as content")
    check(lm.score(frame).collect(), plain(data))
    check(lm.score(frame, mu=3.0).collect(), plain(data, 3.0))
    assert lm.score(frame.limit(0)).collect() == []
    alone = [(i, "nothing learned") for i in range(40) if held_out(i)]
    check(lm.score(spark.createDataFrame(alone, "doc_id long, text string")).collect(), plain(alone))


def test_model_is_kept_and_used_again(spark, tmp_path):
    data = [(i, f"one two three w{i % 5}") for i in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    table, hot = lm.fit(frame)
    kept = spark.createDataFrame(table.collect(), table.schema)
    got = {r.doc_id: r for r in lm.score(frame.filter("doc_id < 5"), model=(kept, hot)).collect()}
    want = {r[0]: r for r in plain(data)}
    for i in range(5):
        assert got[i].score == pytest.approx(want[i][6], rel=1e-4) and got[i].base_score == pytest.approx(want[i][5], abs=1e-5)
    file = tmp_path / "shard"
    row = table.first()
    file.write_bytes(row.trie)
    opened = Trie.open(str(file))
    everything = opened.words.get(np.arange(opened.words.size))
    assert (opened.find(everything) == np.arange(opened.words.size)).all()
    assert (opened.find(everything + np.uint64(1)) == -1).all()
