"""Toxicity and quality: held-out accuracy and edge cases."""

import os
import zlib

import pytest

from gaugeline.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.classify(documents, labels).collect() if r.doc_id in toxic and held_out(r.doc_id)]
    assert all(r.held_out for r in rows)
    assert auc([(r.score, toxic[r.doc_id]) for r in rows]) > 0.8
    flagged = [toxic[r.doc_id] for r in rows if r.predicted]
    assert sum(flagged) > 0.75 * len(flagged) and sum(flagged) > 0.5 * sum(toxic[r.doc_id] for r in rows)
    grades = {r.doc_id: r.quality + 1 - r.toxic for r in labels.collect()}
    rows = [r for r in quality.select_by_quality(documents, labels).collect() if r.doc_id in grades and held_out(r.doc_id)]
    assert auc([(r.expected_grade, grades[r.doc_id] == 2) for r in rows]) > 0.75
    good = [r.kept for r in rows if grades[r.doc_id] == 2]
    assert sum(good) > 0.98 * len(good)


def test_edge_cases(spark):
    data = [(1, None), (2, ""), (3, "fine words here " * 30), (4, "you awful zzgrub " * 30), (4, "you awful zzgrub " * 30),
            (None, "no id"), (5, "x" * 100_000), (6, "\n\t ")]
    documents = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label", "3 as toxic")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.classify(documents, some).collect()
        assert len(rows) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        by_id = {}
        for r in rows:
            by_id.setdefault(r.doc_id, set()).add(r.score)
        assert all(len(s) == 1 for s in by_id.values()) and by_id[1] == by_id[2]
        rows = quality.select_by_quality(documents, some).collect()
        assert len(rows) == len(data) and all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in rows)
    assert toxicity.classify(documents.limit(0), labels).collect() == []
    assert quality.select_by_quality(documents.limit(0), labels.limit(0)).collect() == []
    assert toxicity.without_toxic(documents, labels.limit(0)).columns == documents.columns


def test_thresholds_are_ordered_and_words_are_shared():
    rows = [(b"good clean text", 2), (b"plain text", 1), (b"bad ugly", 0)] * 40
    model = quality.fit(rows)
    assert model.thresholds == sorted(model.thresholds)
    assert model.weights[quality.slot(b"good")] > model.weights[quality.slot(b"ugly")]


def test_a_repeated_id_is_fitted_once(spark, monkeypatch):
    """20,000 rows of one labelled id, and ids with both labels: the driver gets a row per id and bounded bytes."""
    from pyspark.sql import functions as F

    from gaugeline.llm import common

    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.lpad("id", 5, "0")).alias("text"))
    docs = docs.union(spark.range(2, 12).select("id", F.concat(F.lit("other "), "id")))
    chosen = spark.range(1, 12).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    found = common.fitted_rows(docs, chosen, "label")
    assert sorted(found) == sorted([(b"text 00000", 1), *[(f"other {i}".encode(), 1) for i in range(2, 12)]])
    monkeypatch.setattr(common, "FIT_BYTES", 40)
    assert 0 < sum(len(t) for t, _ in common.fitted_rows(docs, chosen, "label")) <= 40
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    sizes = []
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "fit", lambda rows: sizes.append(len(rows)))
        module.train(docs, labels)
    assert all(n <= 3 for n in sizes) and len(sizes) == 2
