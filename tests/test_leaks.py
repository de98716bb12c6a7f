"""Passages of reference texts in other texts, against all word sequences."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gaugeline.functions import wordhash
from gaugeline.operators import leaks

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall(text.translate(LOWER))


def plain(texts, passages, words):
    grams = {}
    for item, text in passages:
        w = words_of(text or "")
        for i in range(len(w) - words + 1):
            grams.setdefault(tuple(w[i : i + words]), set()).add(item)
    hits = {}
    for run, text in texts:
        w = words_of(text or "")
        for i in range(len(w) - words + 1):
            for item in grams.get(tuple(w[i : i + words]), ()):
                hits.setdefault((run, item), set()).add(i)
    out = set()
    for (run, item), starts in hits.items():
        first = last = None
        for i in sorted(starts):
            if first is None or i - last > words:
                if first is not None:
                    out.add((run, item, first, last - first + words))
                first = i
            last = i
        out.add((run, item, first, last - first + words))
    return out


@pytest.mark.parametrize("words, gram, cut", [(13, 7, 1 << 21), (6, 6, 50), (5, 1, 200)])
def test_every_shared_passage_is_found(rows, monkeypatch, words, gram, cut):
    monkeypatch.setattr(leaks, "CUT_BYTES", cut)
    rng = random.Random(words)
    vocabulary = ["a", "b", "Éa", "x1", "the", "OF"] + [f"w{i}" for i in range(60)]
    passages = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(25)]
    passages += [(25, None), (26, ""), (27, "one two"), (28, "a " * 40), (3, "another text of the same item " * 4)]
    texts = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choices(vocabulary, k=rng.randrange(20))
            own = words_of(rng.choice(passages)[1] or "")
            start = rng.randrange(len(own) + 1)
            parts += own[start : start + rng.choice([3, words - 1, words, words + 1, 50])]
        texts.append((f"r{i}", ", ".join(x.upper() if rng.random() < 0.2 else x for x in parts)))
    texts += [("none", None), ("empty", ""), ("long", " ".join(["a"] * 3000)), ("odd", "\x85  é" * 9)]
    frame = rows(texts, "run_id string, text string").repartition(3).selectExpr("text", "run_id", "1 as item_id", "2 as start")
    found = leaks.passage_leak(frame, rows(passages, "item_id long, text string"), words, gram)
    assert found.columns == ["run_id", "item_id", "start", "words"]
    expected = plain(texts, passages, words)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 20


def test_empty_sides(rows):
    texts, passages = rows([("r", "a b c " * 9)], "run_id string, text string"), rows([], "item_id long, text string")
    assert leaks.passage_leak(texts, passages).collect() == []
    assert leaks.passage_leak(texts.limit(0), rows([(1, "a b c " * 9)], "item_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        leaks.passage_leak(texts, passages, 5, 6)


@pytest.mark.parametrize("hashed", [1 << 22, 7])
def test_words_of_a_column(monkeypatch, hashed):
    monkeypatch.setattr(wordhash, "HASHED", hashed)
    texts = ["zz", "", " ", "a", "Ab,ab aB", "é" * 9 + "-a1", "x" * 40, "end", ""]
    column = pa.array(["skipped"] + texts).slice(1)
    found = wordhash.hashed_words(column, leaks.IN_WORD)
    expected = [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    spelled = [wordhash.LOWER[found.data[s : s + n]].tobytes().decode() for s, n in zip(found.starts, found.lengths)]
    assert list(zip(found.owners.tolist(), spelled)) == expected
    assert len(set(found.hashes.tolist())) == len({w for _, w in expected})


def test_winnowing_keeps_a_common_hash():
    rng = np.random.default_rng(3)
    for _ in range(50):
        shared = " ".join(f"s{x}" for x in rng.integers(0, 3, 13))
        kept = []
        for side in range(2):
            text = " ".join(f"{side}x{x}" for x in rng.integers(0, 99, rng.integers(0, 30))) + " " + shared + f" {side}y"
            hashes, _ = leaks.kept_grams(wordhash.hashed_words(pa.array([text]), leaks.IN_WORD), 7, 7)
            kept.append(set(hashes.tolist()))
        assert kept[0] & kept[1]
