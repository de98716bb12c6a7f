"""The pipeline's rows against the same stages done plainly."""

import os
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeline.llm import bpe, toxicity
from test_mixing import plain as plain_mix
from test_simhash import plain_components, plain_print

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_rows_equal_plain_stages(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.classify(documents, labels).collect() if r.predicted}
    left = {r.doc_id: r for r in documents.collect() if r.doc_id not in toxic}
    best = {}
    for r in sorted(left.values(), key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault("".join(c for c in r.text if c not in " \t\n\x0b\x0c\r"), r.doc_id)
    left = {i: left[i] for i in best.values()}
    roots = plain_components({i: plain_print(r.text) for i, r in left.items()})
    left = {i: r for i, r in left.items() if roots[i] == i}
    mixed = plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in left.values()], corpus_pipeline.MIX)
    whole = Tokenizer.from_file(bpe.TOKENIZER)
    want = {}
    for row in mixed:
        ids = whole.encode(left[row[0]].text, add_special_tokens=False).ids
        want[row[0]] = (len(ids), np.array(ids, dtype="<u4").tobytes(), sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_awkward_rows_go_through_every_stage(spark, tmp_path):
    data = [(i, f"some text number {i} with words", "en", "src1", 5) for i in range(20)]
    data += [(None, "no id", None, None, None), (30, None, "en", "src0", 0), (31, "", None, "src0", None), (32, "x " * 50_000, "de", None, 1)]
    data += [(33, "same same", "en", "src1", 2), (33, "same same", "en", "src1", 2), (34, "same  same", "en", "src1", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(data, schema).selectExpr(
        "*", "1 as row", "2 as domain", "3 as fp", "4 as copies", "5 as _row", "6 as _order", "7 as _gone", "8 as gone", "9 as doc"
    )
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == frame.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = {r.doc_id for r in stage(spark, frame, str(tmp_path)).collect()}
        assert {None, 0, 19, 32} <= kept


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_dedup_drops_rows_not_ids(spark, tmp_path, stage):
    a, b, c, d = ("one two three four five", "red green blue black white", "null ids only here", "said by two rows")
    data = [(0, b), (1, a), (1, b), (None, b), (None, c), (None, c), (7, d), (7, d), (9, d), (3, "x"), (3, "y z")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    left = sorted(((r.doc_id, r.text) for r in stage(spark, frame, str(tmp_path)).collect()), key=str)
    assert left == sorted([(0, b), (1, a), (None, c), (7, d), (3, "x"), (3, "y z")], key=str)
