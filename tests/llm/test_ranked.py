"""Ranked search: the first documents and their scores against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gaugeline.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(documents, items, best=10):
    bags = [(i, Counter(words(t))) for i, t in documents]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in set(items):
        found = []
        for (i, bag), n in zip(bags, lengths):
            score = 0
            for w in words(text):
                if bag[w]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * ((1000000000 * bag[w]) // (1000 * bag[w] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=repr)


def answers(frame):
    assert frame.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r)[:4] for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [ranked.BLOCK_BYTES, 300])
def test_equals_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked, "READ", 2)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ñandú", "Éa", "x_y", "A1-b2"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(40)))) for i in range(150)]
    docs += [(7, docs[7][1]), (900, docs[3][1]), (901, docs[3][1]), (None, docs[3][1]), (902, None), (903, ""), (904, " \n.")]
    docs += [(905, "w3 " * 30000 + "w39")]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(12)]
    items += [(20, None), (21, "unheard of"), (22, "w0"), (22, "w0"), (23, "w5 W5 w5 ñandú"), (None, "w1 w2"), (24, docs[3][1])]
    frame = rows([(t, i, "c", "d") for i, t in docs], "text string, doc_id long, term string, block string").repartition(3)
    found = ranked.best_documents(frame, rows([(i, t, 1) for i, t in items], "item_id long, text string, rank int"))
    assert answers(found) == plain(docs, items)


def test_reads_stop_early_and_scores_are_final():
    rng = np.random.default_rng(1)
    lists = []
    for _ in range(4):
        impacts = np.sort(rng.integers(1, 10**6, 5000))[::-1].copy()
        impacts[0] = 10**8
        lists.append((np.concatenate(([17], rng.permutation(np.delete(np.arange(5000), 17)))), impacts))

    docs, scores = ranked.first_without_random_access(lists, 5000, 1, 0)
    assert docs.tolist() == [17] and scores.tolist() == [4 * 10**8]
    total = np.zeros(5000, dtype=np.int64)
    for d, x in lists:
        total[d] += x
    docs, scores = ranked.first_without_random_access(lists, 5000, 25, 0)
    best = np.sort(total)[::-1][:25]
    assert np.sort(scores)[::-1][:25].tolist() == best.tolist() and (total[docs] == scores).all()


def test_empty_tables(rows):
    docs, items = rows([(1, "a b")], "doc_id long, text string"), rows([(1, "a")], "item_id long, text string")
    none = rows([], "doc_id long, text string")
    assert answers(ranked.best_documents(none, items)) == []
    assert answers(ranked.best_documents(docs, rows([], "item_id long, text string"))) == []
    assert answers(ranked.best_documents(rows([(1, None), (2, "..")], "doc_id long, text string"), items)) == []
    assert answers(ranked.best_documents(docs, items)) == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]
