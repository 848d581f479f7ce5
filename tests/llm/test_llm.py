"""The training-data operators against plain versions, and on nulls, ties and empty tables."""

import hashlib
import itertools

import numpy as np

from pyspark.sql import functions as F

from skeinlog.llm import fingerprints, knn, langid, linededup, mixing, neardup, quality, shards, unigram, wordpieces

DOCS = "doc_id long, text string"


def test_winnowing_keeps_the_rightmost_minimum():
    text = "ab" * 60 + "the quick brown fox" * 3
    hashes, places = fingerprints.winnow(text, 4, 5)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    runs = [int(h) & 0xFFFFFFFF for h in fingerprints.run_hashes(codes, 4)]
    wanted = {min(range(i, i + 5), key=lambda j: (runs[j], -j)) for i in range(len(runs) - 4)}
    assert places.tolist() == sorted(wanted) and hashes.tolist() == [runs[p] for p in sorted(wanted)]


def test_half_edited_short_texts_share_a_mark():
    random = np.random.default_rng(3)
    for n in range(29, 126):
        own, other = ("".join(map(chr, random.integers(97, 123, n))) for _ in range(2))
        edited = own[: n - n // 2] + other[: n // 2]
        assert fingerprints.likeness(fingerprints.winnow(own)[0], fingerprints.winnow(edited)[0]) > 0


def test_edited_likeness_with_nulls(spark):
    rows = [(1, "a" * 30 + "b" * 31), (3, None), (9, "wxyz" * 20)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, DOCS)).collect()}
    edited = "wxyz" * 10 + ("a" * 30 + "b" * 31)[:40]
    assert got[9].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[3].n_chars == 0 and got[3].near_edited == 1.0
    assert fingerprints.edited_likeness(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_lines(spark):
    line = "A line of more than twenty letters"
    rows = [(1, f"{line}\nown"), (2, f" {line.upper()}"), (5, f"{line}\n{line}"), (6, None)]
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].text, got[2].text, got[5].n_dropped, got[6].n_lines) == ("own", "", 0, 1)


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(4, " ".join(words)), (2, " ".join([*words[:98], "x", "y"])), (7, None), (8, "W1  w2"), (3, "w1 w2")]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.component_id for i, r in got.items()} == {4: 2, 2: 2, 7: 7, 8: 3, 3: 3}


def test_phrases_by_brute_force():
    learned, text = np.array([2, 3, 2, 4, 3, 2]), np.array([3, 2, 4, 4, 3, 2, 2, 3], np.uint8)
    parts = {tuple(learned[a:b].tolist()) for a, b in itertools.combinations(range(len(learned) + 1), 2)}
    phrases, current = 0, ()
    for c in text.tolist():
        if current + (c,) not in parts:
            phrases, current = phrases + 1, ()
        current += (c,)
    found = langid.phrase_counts([text], [langid.automaton(learned, 6)], 6)
    assert found[0, 0] == phrases + 1


def test_every_letter_of_every_script_counts(spark):
    random = np.random.default_rng(7)
    scripts = {"am": 0x1200, "de": 0x61, "ko": 0xAC00, "zh-a": 0x4E00, "zh-b": 0x5E00}

    def text(lang):  # words of three letters, drawn from a vocabulary of each language's own
        places = random.integers(0, 8 if lang == "de" else 60, 40)
        return " ".join("".join(chr(scripts[lang] + 3 * int(p) + i) for i in range(3)) for p in places)

    rows = [(i, lang, text(lang)) for i, lang in enumerate([*scripts] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert all(model.symbols[ord(c)] > langid._UNKNOWN for _, _, t in rows[:5] for c in t if c.isalpha())
    assert max(len(edges) for _, edges, _ in model.tables) < 5 * langid.SNIPPETS * langid.SNIPPET_CHARS
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, model).collect())


def test_an_unknown_letter_is_a_phrase(spark):
    table = langid.automaton(np.array([2, 5000, 2, 2]), 5003)
    found = langid.phrase_counts([np.array([2, 5000, 4000, 4000, 2, 2, 5000, 2, 5000])], [table], 5003)
    assert found[0, 0] == 6  # 2 5000 | 4000 | 4000 | 2 2 | 5000 2 | 5000


VECTORS = "vec_id long, embedding array<float>, cell int"


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(120, 6)).round(1)
    vectors[40:80] = vectors[40]  # a group of copies
    rows = [(i, [float(np.float32(x)) for x in v], 7) for i, v in enumerate(vectors)]
    rows += [(200, None, 7), (201, [1.0, None], 7), (250, [float("nan")], 7), (None, [1.0], 7)]
    got = knn.top_k(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("vec_id") % 10 == 0).collect()
    whole = np.floor(np.float32(vectors).astype(float) * 256).astype(int)
    for query in range(0, 120, 10):
        scores = whole @ whole[query]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != query)[:5]
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == query)
        assert [(s, i) for _, s, i in mine] == best
    assert len(got) == 60


def test_top_k_of_few_and_of_none(spark):
    few = spark.createDataFrame([(0, [1.0], 1), (10, [2.0, 3.0], 1), (3, [], 1)], VECTORS)
    got = knn.top_k(few, "vec_id", "embedding", F.col("vec_id") % 10 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 10), (0, 2, 3), (10, 1, 0), (10, 2, 3)]
    none = spark.createDataFrame([], VECTORS)
    assert knn.top_k(none, "vec_id", "embedding", F.col("vec_id") % 10 == 0).count() == 0


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(900)]
    rows += [(5, "twice"), (5, "twice"), (None, None), (7, "")]
    got = shards.shard(spark.createDataFrame(rows, DOCS), 4).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} == {0, 1, 2, 3}
    sizes = [sum(r.size for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for s in range(4):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_learns_and_scores_empty_texts(spark):
    rows = [(i, f"WIN!!! CASH {i}!!!" if i % 4 == 0 else f"A calm sentence about item {i}, nothing more.") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(quality.labelled(docs, labels))
    found = quality.rate(docs.union(spark.createDataFrame([(900, None), (901, "")], DOCS)), model).collect()
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in found if r.doc_id < 900)
    assert len({r.score for r in found if r.doc_id >= 900}) == 1
    nothing = quality.train(quality.labelled(docs, labels.limit(0)))
    assert {r.score for r in quality.rate(docs, nothing).collect()} == {0.5}


def test_token_counts_equal_greedy_pieces(spark):
    vocabulary = [b" a", b"ab", b"abc", b"bcd", b"b", b"c", b"d", b" ", b"a", b"abcde"]
    random = np.random.default_rng(2)
    words = ["".join(random.choice(list("abcde"), random.integers(1, 12))) for _ in range(300)]

    def greedy(word):
        data, n = b" " + word.encode(), 0
        while data:
            fits = [p for p in vocabulary if data.startswith(p)]
            if not fits:
                return -1
            data, n = data[max(map(len, fits)) :], n + 1
        return n

    found = wordpieces.Automaton(vocabulary).counts([b" " + w.encode() for w in words]).tolist()
    assert found == [greedy(w) for w in words]
    rows = [(1, "ab  e\tab"), (2, None), (3, " \n ")]
    got = {r.doc_id: r for r in wordpieces.count_tokens(spark.createDataFrame(rows, DOCS), vocabulary).collect()}
    assert (got[1].n_words, got[1].n_tokens, got[1].n_unknown) == (3, 2 * greedy("ab") + 1, 1)
    assert got[2].n_tokens == got[3].n_tokens == 0


MIXED = "doc_id long, text string, source string, rows int"


def test_mixing_keeps_all_and_repeats_small_sources(spark):
    rows = [(i, f"word {i}", "big", 1) for i in range(300)] + [(900 + i, f"word {i}", None, 1) for i in range(30)]
    rows += [(1000, None, "tiny", 1), (1000, None, "tiny", 1)]
    docs = spark.createDataFrame(rows, MIXED)
    taken = mixing.plan(docs).collect()
    held = {s: sum(len((t or "").split()) + 1 for _, t, x, _ in rows if x == s) for s in ("big", None, "tiny")}
    for source, tokens in held.items():
        mine = [r for r in taken if r.source == source]
        assert tokens <= sum(r.n_tokens for r in mine) <= 2 * tokens + 1
        assert {r.doc_id for r in mine} == {i for i, _, x, _ in rows if x == source}
        assert all(0 <= r.position < 1 for r in mine)
    assert sorted(mixing.mix(docs).columns) == sorted(docs.columns)
    assert mixing.mix(docs).count() == sum(r.rows for r in taken)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, "one two three", f"s{min(i // 100, 3)}", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, MIXED)
    taken = mixing.plan(docs, budget=2000, repeats=None, entropy=1.3).toPandas()
    share = taken.groupby("source").n_tokens.sum() / taken.n_tokens.sum()
    assert abs(-(share * np.log(share)).sum() - 1.3) < 0.02 and 1950 <= taken.n_tokens.sum() <= 2000


def test_best_path_and_round_trip(spark):
    pieces = {p: (i, s) for i, (p, s) in enumerate({b"\xff": -3.0, b"a": -3.0, b"b": -3.0, b"ab": -4.0, b"\xffa": -4.5, b"ba": -3.5, b"bab": -9.0}.items())}
    model = unigram.Unigram(pieces, [100 + b for b in range(256)])

    def best(data):
        paths = {0: (0.0, [])}
        for end in range(1, len(data) + 1):
            ways = [(paths[i][0] + pieces[data[i:end]][1], paths[i][1] + [pieces[data[i:end]][0]]) for i in range(end) if data[i:end] in pieces]
            paths[end] = max(ways, key=lambda w: w[0])
        return paths[len(data)][0]

    for letters in itertools.product(b"ab", repeat=7):
        data = b"\xff" + bytes(letters)
        assert abs(sum(model.scores[i] for i in model.best_path(data)) - best(data)) < 1e-9
    texts = ["a b", " ", "", None, "x▁é😀\n\x00 ab", "ab" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.decoded for r in unigram.decode(unigram.encode(docs, model), model).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
