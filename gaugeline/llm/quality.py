"""Quality by ordinal cumulative-link regression.

One weight vector over hashed words is shared by all grades, and ordered thresholds cut its score into grades:
P(grade > j) = sigmoid(w.x - theta_j). That gives an expected grade and a tail probability to select by. Beside the
words, two hashed features tell how long a text is and how much of it is repetition. Ratings are graded from the labels:
one point for good quality, one for not being toxic, so 0, 1 or 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import binary, crc_remainder, fitted_rows

FIT_ROWS = 8_000  # bound of the labelled sample that is fitted on the driver
HELD_OUT, PARTS = 2, 4  # rows whose crc32(doc_id) modulo 4 is 2 are never learned from
GRADES = 3
BITS = 18  # hashed weights
SCALE = 30.0  # of the mean word weight
SHAPE = 5.0  # of the features of the whole text
EPOCHS, BATCH, RATE, RIDGE = 6, 64, 0.3, 1e-6
TAIL_GRADE, TAIL_LEAST = 2, 0.2  # selected: P(grade >= 2) of at least so much, which clean texts pass but for a few
CACHE = 500_000  # words whose weight a task remembers


@dataclass
class Model:
    weights: np.ndarray  # float32, 2^BITS
    thresholds: list[float]  # ascending, GRADES - 1


def slot(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) & ((1 << BITS) - 1)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shape(words: list[bytes]) -> tuple[bytes, bytes]:
    """Features of a text as words that no text holds: its length by powers of two, and tenths of distinct words."""
    distinct = 10 * len(set(words)) // len(words) if words else 0
    return b" length %d" % len(words).bit_length(), b" distinct %d" % distinct


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: of the lower-cased words their share times SCALE, of the shape features SHAPE."""
    words = text.lower().split()
    slots, counts = np.unique(np.array([slot(w) for w in words], dtype=np.int64), return_counts=True)
    extra = [slot(w) for w in shape(words)]
    return np.r_[slots, extra], np.r_[counts * (SCALE / max(1, len(words))), [SHAPE] * len(extra)]


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Adaptive gradient steps on the ordinal likelihood; gaps between thresholds stay positive by construction."""
    rows = sorted(rows)
    counts = np.bincount([g for _, g in rows], minlength=GRADES).astype(float) + 0.5
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    theta = np.sort(-np.log(above / (1 - above)))  # the thresholds that fit the grades without any word
    free = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))  # first threshold, log gaps
    weights = np.zeros(1 << BITS)
    w_seen, free_seen = np.full(1 << BITS, 1e-8), np.full(len(free), 1e-8)
    examples = [(*hashed(t), g) for t, g in rows]
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(examples))
        for start in range(0, len(shuffled), BATCH):
            some = [examples[i] for i in shuffled[start : start + BATCH]]
            sizes = [len(s) for s, _, _ in some]
            slots, values = np.concatenate([s for s, _, _ in some]), np.concatenate([v for _, v, _ in some])
            grades, owner = np.array([g for _, _, g in some]), np.repeat(np.arange(len(some)), sizes)
            score = np.bincount(owner, weights[slots] * values, len(some))
            theta = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
            cuts = np.concatenate(([-np.inf], theta, [np.inf]))
            # P(grade = g) = upper - lower, with the slopes of both ends
            upper, lower = sigmoid(cuts[grades + 1] - score), sigmoid(cuts[grades] - score)
            up, low = upper * (1 - upper), lower * (1 - lower)
            p = np.maximum(upper - lower, 1e-9)
            pull = (up - low) / p / len(some)  # d loss / d score
            touched, place = np.unique(slots, return_inverse=True)
            slope = np.bincount(place, pull[owner] * values, len(touched)) + RIDGE * weights[touched]
            w_seen[touched] += slope**2
            weights[touched] -= RATE * slope / np.sqrt(w_seen[touched])
            by_theta = np.zeros(len(theta))
            for j in range(len(theta)):
                by_theta[j] = (-(up / p)[grades == j].sum() + (low / p)[grades == j + 1].sum()) / len(some)
            by_free = np.concatenate(([by_theta.sum()], [np.exp(free[j]) * by_theta[j:].sum() for j in range(1, len(theta))]))
            free_seen += by_free**2
            free -= RATE * by_free / np.sqrt(free_seen)
    theta = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
    return Model(weights.astype(np.float32), theta.tolist())


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels that hold both marks; of several rows of an id the smallest grade counts."""
    return (
        labels.filter("quality in (0, 1) and toxic in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    )


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most FIT_ROWS graded training rows and FIT_BYTES of text, those with the smallest id hashes; one row per
    id, with the smallest text."""
    known = graded(labels).filter(F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), PARTS) != HELD_OUT))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    return fit(fitted_rows(documents, chosen, "grade"))


def quality_score(model: Model) -> Column:
    """Struct (expected_grade, tail_probability) of the column ``text``; null counts as empty."""
    kinds = "struct<expected_grade: double, tail_probability: double>"

    @F.arrow_udf(kinds)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, theta, known = model.weights.tolist(), np.array(model.thresholds), {}

        def weighed(text: bytes) -> float:
            words = text.lower().split()
            whole = SHAPE * sum(weights[slot(w)] for w in shape(words))
            if len(known) > CACHE:
                known.clear()
            try:
                total = sum([known[w] for w in words])
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = weights[slot(w)]
                total = sum([known[w] for w in words])
            return whole + total * SCALE / max(1, len(words))

        for texts in batches:
            z = np.array([weighed(t or b"") for t in binary(texts).to_pylist()]).reshape(-1, 1)
            tails = sigmoid(z - theta)  # P(grade > j)
            yield pa.StructArray.from_arrays(
                [pa.array(tails.sum(1)), pa.array(tails[:, TAIL_GRADE - 1])], names=["expected_grade", "tail_probability"]
            )

    return score(F.coalesce("text", F.lit("")))


def select_by_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, tail_probability, kept.

    A null text is empty and gets the thresholds' own prediction; texts of any length are read whole. Repeated rows are
    answered each; without labels the grades count as equally frequent. Other columns are left behind, clashing ones too.
    An empty table gives an empty result.
    """
    score = quality_score(train(documents, labels))
    return documents.select(F.col("doc_id").cast("long"), score.alias("s")).select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"),
        "s.expected_grade",
        "s.tail_probability",
        (F.col("s.tail_probability") >= TAIL_LEAST).alias("kept"),
    )
