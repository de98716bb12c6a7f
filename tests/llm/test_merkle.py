"""Merkle fingerprints: successors, edited texts and likeness against brute force."""

import random
from hashlib import sha256

from gaugeline.llm import merkle


def plain(data):
    order = sorted(data, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), (r[1] or "")))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = (merkle.fingerprint(x.encode())[0] for x in (text, edited, following))
        out.append((doc_id, len(text), sha256(edited.encode()).hexdigest(), own, changed, merkle.likeness(own, changed), merkle.likeness(own, other)))
    return sorted(out, key=str)


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gämma", "delta.", "\n", "x", "\n\n", "# head", "日本"]
    data = [(rng.randrange(10**6), " ".join(rng.choices(words, k=rng.randrange(200)))) for _ in range(150)]
    data += [(None, "no id"), (7, None), (8, ""), (9, "same"), (9, "same"), (9, "other"), (-5, "long " * 40000)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", merkle.F.lit(1))
    got = [tuple(r)[:7] for r in merkle.compared_documents(frame).collect()]
    assert sorted(got, key=str) == plain(data)
    assert merkle.compared_documents(frame.limit(0)).collect() == []
    single = merkle.compared_documents(frame.filter("doc_id = 8")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in single] == [(0, 1.0, 1.0)]


def test_equal_roots_and_located_edits():
    lines = [f"paragraph {i} with some words to fill it up, number {i * i}" for i in range(60)]
    a = merkle.fingerprint("\n".join(lines).encode())[0]
    assert a == merkle.fingerprint("\n".join(lines).encode())[0]
    lines[30] = "edited"
    b = merkle.fingerprint("\n".join(lines).encode())[0]
    places = merkle.edits(a, b)
    flat = [(n, m) for n, (_, inner) in enumerate(merkle.parsed(a)) for m in range(len(inner))]
    assert [flat.index(p) for p in places] == [30]
    assert 0.9 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, merkle.fingerprint(b"something else entirely")[0]) == 0


def test_half_edited_text_is_half_alike():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(2000))
    other = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(2000))
    half = len(text) // 2
    a, b, c = (merkle.fingerprint(x.encode())[0] for x in (text, text[: len(text) - half] + other[:half], other))
    assert 0.4 < merkle.likeness(a, b) < 0.6
    assert merkle.likeness(a, c) < 0.02
