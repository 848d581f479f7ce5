"""Words that advance together take the same paths as one by one."""

import numpy as np
import pyarrow as pa
import pytest

from skeinlog.llm import unigram

PIECES = {b"\xff": -3.0, b"a": -3.0, b"b": -3.0, b"ab": -4.0, b"\xffa": -4.5, b"ba": -3.5, b"bab": -9.0, "é".encode(): -2.0, b"aab": -5.0}


@pytest.fixture
def model():
    return unigram.Unigram({p: (i, s) for i, (p, s) in enumerate(PIECES.items())}, [100 + b for b in range(256)])


def plain(model, text):
    return [i for w in unigram._WORDS.findall(unigram._marked(text)) for i in model.best_path(w)] if text else []


def test_lanes_equal_single_paths(model, monkeypatch):
    random = np.random.default_rng(5)
    letters = list("aabbé x▁\n\x00😀") + [" "]
    texts = ["".join(random.choice(letters, random.integers(0, 90))) for _ in range(300)] + [None, "", " ", "  a ", "ab" * 500, "é" * 33]
    encoder = unigram.Encoder(model)
    assert encoder.encode(texts).to_pylist() == [plain(model, t) for t in texts]
    for name, value in (("_LANES", 3), ("_WORDS_AT_ONCE", 7), ("_PART_BYTES", 5), ("REMEMBERED", 20), ("LANE_BYTES", 4)):
        monkeypatch.setattr(unigram, name, value)
        encoder = unigram.Encoder(model)
        assert [encoder.encode([t]).to_pylist()[0] for t in texts] == [plain(model, t) for t in texts], name
    assert unigram.Decoder(model).decode(encoder.encode(texts)) == [t or "" for t in texts]


def test_decoding_foreign_ids(model):
    lists = pa.array([[0, 1], None, [], [999, -5, 1], [100 + 0xC3], [0, 0]], pa.list_(pa.int32()))
    assert unigram.Decoder(model).decode(lists) == ["a", None, "", "a", "�", " "]
    assert unigram.Decoder(model).decode(lists.slice(3)) == ["a", "�", " "]


def test_a_long_word_and_no_words(spark, model):
    rows = [(1, "ab" * 1_000_000, "x", 3), (2, " " * 100_000, "x", 3), (3, "b a " * 200_000, None, None)]
    schema = "doc_id long, text string, ids string, decoded int"
    found = unigram.decode(unigram.encode(spark.createDataFrame(rows, schema), model), model)
    assert {r.doc_id: r.decoded for r in found.collect()} == {i: t for i, t, _, _ in rows}
    both = unigram.round_trip(spark.createDataFrame(rows, schema), model).collect()
    assert {r.doc_id: r.decoded for r in both} == {i: t for i, t, _, _ in rows}
    assert sorted((r.doc_id, r.ids) for r in both) == sorted((r.doc_id, r.ids) for r in found.select("doc_id", "ids").collect())
    none = spark.createDataFrame([], schema)
    assert unigram.round_trip(none, model).count() == 0
    assert unigram.decode(unigram.encode(none, model), model).count() == 0
