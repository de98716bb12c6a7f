"""N-gram Jaccard join: components and links against brute force."""

import random

import numpy as np
import pytest

from gaugeline.llm import jaccard


def plain_set(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain(documents, percent=85, width=4):
    sets = [plain_set(t, width) for _, t in documents]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = {}
    for x, (i, _) in enumerate(documents):
        ids.setdefault(find(x), []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return sorted(((i, len(sets[x]), least[find(x)], links[x]) for x, (i, _) in enumerate(documents)), key=repr)


def answers(frame):
    assert frame.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)


def corpus(rng, families, most):
    """Families of edited texts, some around a common passage, of 1 to ``most`` words."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randrange(1, most))
        if rng.random() < 0.5:
            base = base[: rng.randrange(12)] + passage + base[12:20]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], "X"]])
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("frequent, blocks", [(None, 512), (((2, 0.02), (3, 0.2)), 3)])
def test_equals_brute_force(rows, monkeypatch, frequent, blocks):
    if frequent:
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "PLAIN", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks)
    rng = random.Random(11)
    texts = corpus(rng, 70, 150)
    docs = list(enumerate(texts)) + [(2, texts[9]), (1000, texts[9].upper()), (None, texts[9]), (None, "only here, with a null id")]
    docs += [(1001, None), (1002, ""), (1003, " \n\x0b"), (1004, "one"), (1005, "One"), (1006, "one two three")]
    docs += [(1007, "a b " * 5000 + "end"), (1008, "b a " * 5000 + "end")]
    long = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    docs += [(1009, " ".join(long)), (1010, " ".join(long[:5400])), (1011, " ".join(long[900:]))]
    rng.shuffle(docs)
    frame = rows([(t, i, 0, "k") for i, t in docs], "text string, doc_id long, row int, key string").repartition(3)
    expected = plain(docs)
    assert answers(jaccard.jaccard_join(frame)) == expected
    assert sum(x[3] > 0 for x in expected) > 60


@pytest.mark.parametrize("percent, width", [(70, 2), (100, 1)])
def test_other_thresholds(rows, monkeypatch, percent, width):
    monkeypatch.setattr(jaccard, "FREQUENT", ((2, 0.02), (3, 0.3)))
    docs = list(enumerate(corpus(random.Random(3), 40, 90)))
    frame = rows(docs, "doc_id long, text string")
    assert answers(jaccard.jaccard_join(frame, percent, width, 0.5)) == plain(docs, percent, width)
    with pytest.raises(ValueError):
        jaccard.jaccard_join(frame, 50)


def test_prefixes_of_partners_share_a_signature():
    """All tokens frequent: every pair at the threshold meets in a combination or a plain token."""
    rng = random.Random(8)
    order = {t: ((rng.choice([2, 3]) << 40) if rng.random() < 0.8 else rng.randrange(2, 9)) for t in range(1, 4000)}
    spread = {t: rng.randrange(2**62) for t in order}
    for _ in range(300):
        n = rng.randrange(6, 400)
        a = set(rng.sample(sorted(order), n))
        b = set(a)
        while 100 * len(a & b) >= 85 * len(a | b):
            last = set(b)
            (b.discard if rng.random() < 0.5 else b.add)(rng.choice(sorted(order)))
        b = last
        made = []
        for x in (a, b):
            found = sorted((order[t], spread[t]) for t in x)
            signed = set()
            for band in jaccard.bands(len(x), 85):
                signed |= {(band, m) for m in jaccard.prefix(*zip(*found), 0, [], len(x), band, 85)}
            made.append(signed)
        assert made[0] & made[1]


def test_overlaps_count_common_tokens(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for cells in (1 << 20, 64):
        monkeypatch.setattr(jaccard, "CELLS", cells)
        got = jaccard.overlaps(sets)
        assert all(got[i, j] == expected[i][j] for i in range(20) for j in range(20) if i != j)


def test_empty_table(rows):
    assert answers(jaccard.jaccard_join(rows([], "doc_id long, text string"))) == []
