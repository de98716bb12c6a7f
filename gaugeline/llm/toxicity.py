"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic documents say that ordinary ones do
not (words, or beginnings of words, that are far more frequent in them). A window of a text is compressed twice, with the ordinary dictionary and with the
toxic one in front of it; the bytes that the second saves are the window's gain. Statistics of a document's gains go
through a calibrated logistic threshold. The dictionaries and the calibration use separate parts of a bounded sample of
labelled training rows; labels, language, source and identifier never enter a score.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import binary, crc_remainder, fitted_rows

TOXIC_ROWS, ORDINARY_ROWS = 2_000, 4_000  # bound of the labelled sample that is fitted on the driver
HELD_OUT, PARTS = 2, 4  # rows whose crc32(doc_id) modulo 4 is 2 are never learned from
DICTIONARY, TOXIC_DICTIONARY = 64 << 10, 2 << 10  # bytes
MIN_SHARE, MIN_LIFT = 0.025, 10.0  # of a word of the toxic dictionary: documents that have it; against ordinary ones
STEM = 5  # bytes of a word's beginning
WINDOW = 64  # bytes, up to the next word end
LONG_WORD = 256  # a window without a word end is cut here
THRESHOLD = 0.3
SPACED = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
FEATURES = 9


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]  # of the standardised statistics, then the intercept
    mean: list[float]
    scale: list[float]


def windows(text: bytes) -> list[bytes]:
    """All of the lower-cased text in windows that end at a space."""
    text = text.lower().translate(SPACED)
    out, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + WINDOW, at + LONG_WORD)
        end = min(at + LONG_WORD, len(text)) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


def compressors(model: Model):
    settings = zstandard.ZstdCompressionParameters(
        write_content_size=0, write_dict_id=0, min_match=5, strategy=zstandard.STRATEGY_GREEDY,
        window_log=17, hash_log=16, chain_log=16, search_log=3, target_length=8,
    )
    out = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress)
    return out


def statistics(text: bytes, plain, both) -> list[float]:
    """What the gains of a document's windows look like; all zero for an empty text."""
    gains = np.sort(np.array([len(plain(w)) - len(both(w)) for w in windows(text)] or [0], dtype=float))[::-1]
    n = len(gains)
    return [
        gains[0], gains[:2].sum() / 2, gains[:4].sum() / 4, gains.mean(), np.log1p(n), (gains >= 3).sum() / n,
        np.log1p((gains >= 5).sum()), np.log1p((gains >= 7).sum()), gains.mean() * np.sqrt(n),
    ]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary's bytes; too few samples to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
    return w


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """A model of (text, toxic) rows: two thirds for the dictionaries, one third for the calibration."""
    rows = sorted(rows)
    random.Random(0).shuffle(rows)
    learn, calibrate = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    tokens = {label: [t.lower().split() for t, y in learn if y == label] for label in (0, 1)}
    units = lambda w: {w, w[:STEM]}
    seen = {label: Counter(u for words in tokens[label] for u in set().union(*map(units, words))) for label in (0, 1)}
    toxic, ordinary = max(1, len(tokens[1])), max(1, len(tokens[0]))
    telling = {
        u
        for u, n in seen[1].items()
        if n >= max(2, MIN_SHARE * toxic) and n / toxic >= MIN_LIFT * (seen[0][u] + 0.5) / ordinary
    }
    said = [b" " + b" ".join(w for w in words if telling & units(w)) + b" " for words in tokens[1]]
    plain = [t[i : i + 400] for t in (t.lower() for t, y in learn if not y) for i in range(0, len(t), 400)]
    model = Model(dictionary(plain, DICTIONARY, 64), dictionary([s for s in said if s.strip()], TOXIC_DICTIONARY, 16), [], [], [])
    x = np.array([statistics(t, *compressors(model)) for t, _ in calibrate] or np.zeros((0, FEATURES)))
    y = np.array([label for _, label in calibrate], dtype=float)
    if not 0 < y.sum() < len(y):  # nothing to tell apart: the share of toxic rows is the score
        share = (sum(label for _, label in rows) + 0.1) / (len(rows) + 1)
        return Model(model.ordinary, model.toxic, [0.0] * FEATURES + [float(np.log(share / (1 - share)))], [0.0] * FEATURES, [1.0] * FEATURES)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(model.ordinary, model.toxic, logistic((x - mean) / scale, y).tolist(), mean.tolist(), scale.tolist())


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most TOXIC_ROWS + ORDINARY_ROWS labelled training rows and FIT_BYTES of text, those with the smallest id
    hashes; one row per id, with the smallest text and label."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), PARTS) != HELD_OUT) & F.col("label").isin(0, 1)
    )
    known = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64("doc_id")
    sample = [
        (row["doc_id"], row["label"])
        for label, limit in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))
        for row in known.filter(F.col("label") == label).orderBy(order, "doc_id").limit(limit).collect()
    ]
    return fit(fitted_rows(documents, documents.sparkSession.createDataFrame(sample, "doc_id long, label int"), "label"))


def toxicity_score(model: Model) -> Column:
    """The score of the column ``text``: between 0 and 1, null counting as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plain, both = compressors(model)
        weights, mean, scale = (np.array(x) for x in (model.weights, model.mean, model.scale))
        for texts in batches:
            x = np.array([statistics(t or b"", plain, both) for t in binary(texts).to_pylist()]).reshape(-1, FEATURES)
            z = (x - mean) / scale @ weights[:-1] + weights[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(F.coalesce("text", F.lit("")))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text scores as an empty one; texts of any length are scored whole; repeated rows are answered each; without
    labels of both kinds every score is the share of toxic labels. Other columns are left behind, clashing ones too. An empty
    table gives an empty result.
    """
    score = toxicity_score(train(documents, labels))
    return documents.select(F.col("doc_id").cast("long"), score.alias("score")).select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the documents that are not predicted toxic, with all their columns."""
    return documents.filter(toxicity_score(train(documents, labels)) < THRESHOLD)
