"""License scan: words, base places and fuzzy notices against brute force."""

import random
import re

from gaugeline.llm import licenses


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(words):
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def best_distance(pattern, text):
    """The smallest edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            before, row[i] = row[i], min(before + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def mangled(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] + "q"]) + text[i + 1 :]
    return text


def test_rows_equal_brute_force(spark):
    rng = random.Random(11)
    pool = ["under", "the", "MIT", "license", "Licence", "Apache", "version", "2", "cc", "BY-NC", "日本", "é", "x\x7fy", "\n"]
    data = [(1, None), (2, ""), (3, "cc by nc cc by nc by nc"), (3, "cc by nc"), (None, "Under the MIT License."), (4, "w " * 60_000)]
    for i in range(150):
        words = rng.choices(pool, k=rng.randrange(60))
        if i % 2:
            notice = rng.choice(licenses.NOTICES)
            words.insert(rng.randrange(len(words) + 1), mangled(rng, notice.text, rng.randrange(notice.errors + 3)).upper())
        data.append((100 + i, rng.choice([" ", "-", ", "]).join(words)))
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as labels")
    got = licenses.scan_licenses(frame).collect()
    assert len(got) == len(data)
    by_key = sorted(got, key=lambda r: (r.doc_id or 0, r.n_words))
    for r, (doc_id, text) in zip(by_key, sorted(data, key=lambda d: (d[0] or 0, len(plain_words(d[1]))))):
        words = plain_words(text)
        base = plain_base(words)
        assert (r.doc_id, r.n_words, r.n_base) == (doc_id, len(words), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base}))
        if len(words) < 1000:
            flat = f" {' '.join(words)} "
            near = {n.label for n in licenses.NOTICES if best_distance(n.text, flat) <= n.errors}
            assert r.labels == ",".join(sorted(near | {b for _, b in base})), text
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert licenses.scan_licenses(frame.limit(0)).collect() == []


def test_span_covers_the_notice():
    finder = licenses.Finder()
    row = licenses.scan(b"one two Licensed under the Apche License, Versoin 2.0 and more", finder)
    assert row[7] == "apache-2:2:9:3" and row[4] == "" and row[5] == "apache-2"


def test_adjacent_altered_notices_are_all_found():
    finder = licenses.Finder()
    row = licenses.scan(b"relased under the mit license " * 5 + b"released under the mit license", finder)
    assert row[7] == ",".join(f"mit:{5 * i}:{5 * i + 5}:{int(i < 5)}" for i in range(6)) and row[8] == 6
    row = licenses.scan(b"all rights reservd all rights reservd all rights reserved", finder)
    assert row[7] == "proprietary:0:3:1,proprietary:3:6:1,proprietary:6:9:0"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_matches(notice, text):
    """All parts within the errors, taken by edits, then from the left; the ends of equal ones are the text's choice."""
    n, e = len(notice.text), notice.errors
    parts = sorted(
        (d, a, b)
        for a in range(len(text)) for b in range(a + n - e, min(a + n + e, len(text)) + 1)
        if (d := distance(notice.text, text[a:b])) <= e
    )
    taken = []
    for d, a, b in parts:
        if all(b <= x or y <= a for _, x, y in taken):
            taken.append((d, a, b))
    return taken


def test_rows_of_altered_notices_equal_brute_force():
    rng = random.Random(5)
    notices = [n for n in licenses.NOTICES if len(n.text) < 32]
    finder = licenses.Finder(notices)
    for _ in range(25):
        notice = rng.choice(notices)
        copies = [mangled(rng, notice.text, rng.randrange(notice.errors + 2)) for _ in range(rng.randint(2, 4))]
        text = f" {rng.choice([' ', ' and ', ' zz qq zz '] ).join(copies)} "
        got = [m for m in finder.matches(text) if finder.notices[m[0]] is notice]
        spans = sorted((a, b) for _, a, b, _ in got)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(distance(notice.text, text[a:b]) == d for _, a, b, d in got)
        assert sorted(d for *_, d in got) == sorted(d for d, _, _ in plain_matches(notice, text)), text
