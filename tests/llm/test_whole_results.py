"""No row is lost or overwritten: repeated ids, large ids beside nulls, clashing column names."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skeinlog.llm import fingerprints, knn, langid, linededup, quality

VECTORS = "vec_id long, embedding array<float>, dist string"


def best_scores(rows, query):
    own = [r for r in rows if r[0] == query]
    vector = min(np.floor(np.float32(v).astype(float) * 256).astype(int).tolist() for _, v, _ in own)
    scored = sorted((-int(np.dot(vector, np.floor(np.float32(v).astype(float) * 256).astype(int))), i) for i, v, _ in rows if i != query)
    return [(-s, i) for s, i in scored[:5]]


def test_a_query_id_on_many_rows_finds_others(spark):
    random = np.random.default_rng(6)
    rows = [(0, [float(x) for x in np.float32([9, 9, 9] + random.normal(size=3) / 99)], "x") for _ in range(40)]
    rows += [(i, [float(x) for x in np.float32(random.normal(size=3))], "x") for i in range(1, 401)]
    rows += [(7, [5.0, 5.0, 5.0], "x")] * 30
    got = knn.top_k(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    for query in range(0, 401, 50):
        mine = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == query)
        assert [(s, i) for _, s, i in mine] == best_scores(rows, query)


def test_large_ids_beside_nulls_over_many_ranges(spark):
    ids = [(1 << 53) + 3 * i + 1 for i in range(200)]
    rows = [(i, f"text {i} " * (i % 7)) for i in ids] + [(None, "no id"), (None, None), (ids[9], "twice"), (ids[0], "head twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.edited_likeness(docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (i for i, _ in rows)))
    single = {i: t for i, t in rows if i is not None}
    following = dict(zip(ids, ids[1:]))
    for r in got:
        if r.doc_id in (None, ids[0], ids[8], ids[9], ids[-1]):
            continue
        own, other = single[r.doc_id], single[following[r.doc_id]]
        edited = own[: len(own) - len(own) // 2] + other[: len(own) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_no_documents_and_few(spark):
    for rows in ([], [(5, None)], [(None, "x")], [(1 << 60, "a"), (None, "b")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert fingerprints.edited_likeness(docs).count() == len(rows)


def test_lines_are_counted_by_documents(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.drop_repeated_lines(docs).collect()} == {0}
    more = docs.union(spark.createDataFrame([(3, line), (None, line)], docs.schema))
    assert sorted((str(r.doc_id), r.n_dropped) for r in linededup.drop_repeated_lines(more).collect()) == [
        ("1", 1), ("1", 1), ("2", 1), ("3", 0), ("None", 0),
    ]


CLASHES = ["score", "digest", "_id", "n_lines", "rows", "times", "_gone", "lettered", "node", "_mix_times"]


def test_stages_keep_columns_of_any_name(spark):
    line = "One line that stands in three documents."
    texts = [f"Some words of document {i}, all its own as number {i * i}.\n{line}" for i in range(6)] + [None, "", "12 34"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` double" for c in CLASHES)
    rows = [(i, t, "en", "web", len(t or ""), *[i + k / 100 for k in range(len(CLASHES))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.schema.names == docs.schema.names and got.dtypes == docs.dtypes, name
        found = got.collect()
        assert found and all(r[5:] == tuple(r.doc_id + k / 100 for k in range(len(CLASHES))) for r in found), name
        kept = {r.doc_id for r in found}
        assert kept == set(range(6) if name == "language" else range(9)) - ({7} if name == "near_copies" and 7 not in kept else set())
    assert corpus_pipeline.pieces(spark, docs, "").where("round_trip").count() == 9


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(600)]
    rows = [(10 * i + j, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of {n}", n) for i, n in enumerate(names) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.sample(docs, 600)) <= 600
    few = langid.sample(docs.union(spark.createDataFrame([(9_000 + i, "often", "zz") for i in range(9)], docs.schema)), 5)
    assert len(few) == 5 and "zz" in dict(few)


def test_quality_fit_equals_numpy(spark):
    random = np.random.default_rng(3)
    words = np.array(["Ab", "cd", "!!", "42", "é", "\U00031234", "end.\n"])
    rows = [(i, " ".join(random.choice(words, random.integers(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "long word " * 50_000), (503, rows[0][1]), (503, rows[0][1])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    marks = [(i, i % 2) for i in range(0, 120)] + [(500, 1), (503, 0), (3, None), (4, 7)]
    model = quality.train(quality.labelled(docs, spark.createDataFrame(marks, "doc_id long, quality int")))
    kinds = quality.kind_table()
    values = [(i, np.array(quality.statistics(t, kinds))) for i, t in rows]
    import zlib

    moments = {}
    for c in (0, 1):
        x = np.array([v for i, v in values for j, q in marks if i == j and q == c and zlib.crc32(str(i).encode()) % 5])
        moments[c] = (len(x), x.sum(axis=0), x.T @ x)
    plain = quality.Discriminant(moments)
    got = quality.rate(docs, model).collect()
    assert len(got) == len(rows)
    wanted = dict(zip((i for i, _ in values), plain.scores(np.array([v for _, v in values]))))
    assert all(abs(r.score - wanted[r.doc_id]) < 1e-6 for r in got)
    assert quality.rate(docs.limit(0), model).count() == 0


def plain_shards(rows, shards):
    """The law on Python rows: (size, crc, shard, slot), sorted."""
    import zlib

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    keyed = sorted(
        (signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest()), -(1 << 63) if i is None else i, k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        for k, (i, t) in enumerate(rows)
    )
    total, before, groups = sum(r[3] for r in keyed), 0, {}
    for h, _, _, size, _ in keyed:
        begin, held = groups.get(h, (before, 0))
        groups[h] = (begin, held + size)
        before += size
    out, before, taken = [], 0, {}
    for h, i, _, size, crc in keyed:
        begin, held = groups[h]
        middle = begin + held / 2 if held * shards <= total else before + size / 2
        shard = min(shards - 1, int(middle * shards / total))
        slot = taken[shard] = taken.get(shard, -1) + 1
        out.append((None if i == -(1 << 63) else i, size, crc, shard, slot))
        before += size
    return sorted(map(str, out))


def test_shards_equal_a_plain_cut_and_keep_groups(spark):
    from skeinlog.llm import shards

    random = np.random.default_rng(9)
    rows = [(i, f"text {i} " * int(random.integers(0, 20))) for i in range(700)]
    rows += [(1000 + i, f"copy {i % 9} " * 5) for i in range(300)] + [(2000 + i, "one large group") for i in range(600)]
    rows += [(5, "twice"), (5, "twice"), (None, None), (None, ""), (7, None)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, shard int, range int")
    for n in (1, 4, 24):
        got = shards.shard(docs, n).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_shards(rows, n)
    of = {}
    for r in got:
        of.setdefault(r.text_crc32, set()).add(r["shard"])
    assert max(len(s) for c, s in of.items() if sum(r.size for r in got if r.text_crc32 == c) * 24 <= sum(r.size for r in got)) == 1
