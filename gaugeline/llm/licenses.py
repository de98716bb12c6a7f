"""License scan with fuzzy search for short notices.

A text is lower-cased and reduced to its words. Base phrases are found word by word. Notices may differ in a bounded
number of characters: a notice cut into one piece more than the errors allowed keeps at least one piece unharmed in every
match (pigeonhole), so an Aho-Corasick pass over the exact pieces finds every place worth looking at, and the regex
library's bounded-error matching decides there and reports the span and the number of edits.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gaugeline.llm.common import binary, texts

# The base phrases of the contract
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int


NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("apache-2", "licensed under the apache license version 2", 4),
    Notice("gpl-3", "licensed under the gnu general public license version 3", 5),
    Notice("cc-by-nc", "licensed under cc by nc", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    Notice("proprietary", "all rights reserved", 1),
)

# A-Z to lower case; 0-9, a-z and bytes of other characters stay; all else parts words
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> tuple[int, str]:
    """The number of words, and the words between single spaces with a space at both ends."""
    words = text.translate(WORDS).split()
    return len(words), f" {b' '.join(words).decode('utf-8', 'replace')} "


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): the notice cut into errors + 1 parts of about equal length."""
    n, parts = len(notice.text), notice.errors + 1
    at = [n * i // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(at, at[1:])]


class Finder:
    def __init__(self, notices=NOTICES):
        self.notices = notices
        self.patterns = [
            [regex.compile(f"(?:{regex.escape(n.text, literal_spaces=True)}){{e<={k}}}") for k in range(n.errors + 1)]
            for n in notices
        ]
        seeds = {}
        for number, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits), not overlapping per notice: fewest edits first, leftmost among equals."""
        places: dict[int, list[tuple[int, int]]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for number, offset in uses:
                notice = self.notices[number]
                begin = end - length + 1 - offset - notice.errors
                places.setdefault(number, []).append((max(0, begin), begin + len(notice.text) + 2 * notice.errors))
        found = []
        for number, spans in places.items():
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                found += [(number, *m) for m in self.in_region(number, text, a, min(b, len(text)))]
        return found

    def in_region(self, number: int, text: str, begin: int, stop: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) within the region: a pass for each number of edits over what better matches leave free.

        Once the matches with fewer edits are taken, all that a pass can find has as many edits as it allows.
        """
        found, free = [], [(begin, stop)]
        for edits, pattern in enumerate(self.patterns[number]):
            shortest, left = len(self.notices[number].text) - edits, []
            for a, b in free:
                for m in pattern.finditer(text, a, b) if b - a >= shortest else ():
                    found.append((m.start(), m.end(), edits))
                    left.append((a, m.start()))
                    a = m.end()
                left.append((a, b))
            free = left
        return sorted(found)


def scan(text: bytes, finder: Finder) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans, n_fuzzy."""
    n_words, flat = normalised(text)
    hits, labels, spans, best = [], set(), [], 0.0
    for phrase, label in BASE.items():
        wanted, at = f" {phrase} ", flat.find(f" {phrase} ")
        while at >= 0:
            hits.append((at, label))
            at = flat.find(wanted, at + 1)
    base = {label for _, label in hits}
    fuzzy = finder.matches(flat)
    if not hits and not fuzzy:
        return n_words, 0, None, None, "", "", 0.0, "", 0
    gaps = [i for i, c in enumerate(flat) if c == " "]  # the word after gap i is word i
    starts = sorted(bisect_left(gaps, at) for at, _ in hits)
    for number, start, end, edits in fuzzy:
        notice = finder.notices[number]
        labels.add(notice.label)
        best = max(best, 1 - edits / len(notice.text))
        first, last = bisect_left(gaps, start + (flat[start] == " ")) - 1, bisect_left(gaps, end - (flat[end - 1] == " "))
        spans.append((max(0, first), last, notice.label, edits))
    joined = ",".join(f"{label}:{a}:{b}:{edits}" for a, b, label, edits in sorted(spans))
    listed = lambda some: ",".join(sorted(some))
    ends = (starts[0], starts[-1]) if starts else (None, None)
    return n_words, len(hits), *ends, listed(base), listed(base | labels), 1.0 if hits else best, joined, len(fuzzy)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.string()),
        ("n_fuzzy", pa.int64()),
    ]
)
COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string, n_fuzzy long"
)


def scan_licenses(documents: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per document, see ``COLUMNS``; spans are label:first word:word after:edits of the fuzzy matches.

    A null text is empty; an empty text has no words and score 0; score is 1 for a base phrase, else the best share of
    characters that agree. Repeated rows are answered each; an empty table gives an empty result.
    """

    def run(batches):
        finder = Finder(notices)
        for batch in batches:
            found = [scan(t, finder) for t in binary(batch.column("text")).to_pylist()]
            columns = list(zip(*found)) or [[] for _ in SCHEMA.names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:])]], schema=SCHEMA
            )

    return texts(documents).mapInArrow(run, COLUMNS)
