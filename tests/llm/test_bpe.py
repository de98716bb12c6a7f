"""BPE: chunked encoding against the tokenizer on whole texts."""

import random
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeline.llm import bpe

WHOLE = Tokenizer.from_file(bpe.TOKENIZER)
CODEC = bpe.Codec()


def plain(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), WHOLE.decode(ids, skip_special_tokens=False).encode()


def same(text):
    ids = CODEC.encode_all([text.encode()])[0]
    assert (ids, CODEC.decode(ids)) == plain(text), text[:200]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    same(text)


def test_awkward_texts():
    rng = random.Random(1)
    parts = ["a", "Thing,", " ", "\n", "\t", "é", "é", "́", "Σ", "ς", "'s", "'", "19", "日本", "<|endoftext|>", "<|startoftext|>",
             "<|", " ", " ", "İ!", "ﬁ", "\x85", "\x1c", "\x0b", "!?", "x" * 40, "%%%", "한하", "🙂", "ß.", "\x00", "‍", "words and words "]
    for i in range(800):
        same("".join(rng.choices(parts, k=rng.randrange(800 if i % 10 == 0 else 60))))
    same("no space" * 0 + "z" * 5000 + " " + "é" * 3000)


def test_parts_put_the_text_together_and_end_at_white_space():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(5000)).encode()
    parts = list(bpe.sure_parts(text))
    assert b"".join(p for _, p in parts) == text
    assert all(p[:1].isspace() for _, p in parts[1:])
    other = list(bpe.sure_parts(b"something before it " + text))
    shared = {p for r, p in parts if r} & {p for r, p in other if r}
    assert len(shared) > 0.9 * sum(r for r, _ in parts)  # cut alike wherever the passage stands


def test_documents(spark):
    passage = " ".join(f"word{i} and" for i in range(600))
    data = [(i, f"Start {i}. {passage} end {i}") for i in range(12)] + [(50, None), (51, ""), (51, "twice"), (51, "twice"), (None, "no id"), (52, "long " * 50_000)]
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as part")
    got = sorted(map(tuple, bpe.encoded_digests(frame).collect()), key=str)
    want = []
    for i, t in data:
        ids, decoded = plain(t or "")
        want.append((i, len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest()))
    assert got == sorted(want, key=str)
    texts = {r.doc_id: r for r in bpe.encode_documents(frame).collect()}
    assert texts[50].ids == b"" and texts[50].decoded == "" and bytes(texts[3].ids) == plain(data[3][1])[0]
    assert len(bpe.shared_chunks(bpe.texts(frame), open(bpe.TOKENIZER).read())) > 0
    assert bpe.encoded_digests(frame.limit(0)).collect() == []
