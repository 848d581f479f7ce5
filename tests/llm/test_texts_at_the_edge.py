"""Long words, empty tables and clashing names in word pieces and language ID."""

import numpy as np

from skeinlog.llm import langid, wordpieces

PIECES = [b" a", b"ab", b"abc", b"bcd", b"b", b"c", b"d", b" ", b"a", b"abcde"]


def greedy(word):
    data, n = b" " + word.encode(), 0
    while data:
        fits = [len(p) for p in PIECES if data.startswith(p)]
        if not fits:
            return -1
        data, n = data[max(fits) :], n + 1
    return n


def test_long_words_walk_alone():
    random = np.random.default_rng(4)
    words = ["".join(random.choice(list("abcd"), n)) for n in (1, 255, 256, 257, 3000, 20_000)] + ["ab" * 500 + "z", ""]
    found = wordpieces.Automaton(PIECES).counts([b" " + w.encode() for w in words]).tolist()
    assert found == [greedy(w) for w in words]


SCHEMA = "doc_id long, text string, lang string, n_words string, score string, lang_pred int"


def test_word_pieces_of_odd_tables(spark):
    rows = [(1, "ab " * 3 + "abcd" * 200_000, "x", "kept?", None, 1), (2, None, None, None, None, None), (2, "", "", "", "", 0)]
    got = wordpieces.count_tokens(spark.createDataFrame(rows, SCHEMA), PIECES).collect()
    assert sorted((r.doc_id, r.n_words, r.n_tokens) for r in got)[:2] == [(2, 0, 0), (2, 0, 0)]
    assert max(r.n_tokens for r in got) == 3 * greedy("ab") + greedy("abcd" * 200_000)
    assert wordpieces.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_language_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, langid.train(none)).count() == 0
    rows = [(i, f"words of {'xyz'[i % 3] * 9} number", "en" if i % 2 else "de", "clash", "clash", 7) for i in range(40)]
    rows += [(90, None, "en", "", "", 0), (91, "12 34", "en", "", "", 0), (1, "words " * 50_000, None, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (90, 91)} == {"und"}
    assert all(r.n_words in ("clash", "") and 0 <= r.score <= 1 for r in got)
