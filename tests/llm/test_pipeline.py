"""The stages of the corpus pipeline on tables that are not as they should be."""

import corpus_pipeline
from skeinlog.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def test_near_copies_goes_by_row(spark):
    words = [f"w{i}" for i in range(100)]
    one, near, other = " ".join(words), " ".join([*words[:98], "x", "y"]), "a text that nobody else has in here"
    rows = [(5, one), (5, other), (3, near), (9, other), (7, "tw o"), (7, "tw o"), (7, "tw o"), (None, one), (None, one)]
    rows += [(8, None), (8, ""), (8, ""), (3, near), (5, one)]
    docs = table_of(spark, [(i, t, "en") for i, t in rows])
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    wanted = [(3, near), (5, other), (7, "tw o"), (8, None), (8, ""), (None, one), (None, one)]
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.text)) for r in got)
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(wanted)
    assert sorted(r.component_id for r in found if r.doc_id == 5) == [3, 3, 5]
    assert {r.component_id for r in found if r.doc_id == 9} == {5}


def test_language_keeps_lettered_texts_without_labels(spark):
    rows = [(1, "a text", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "\u4e2d", None)]
    got = corpus_pipeline.language(spark, table_of(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 5]
    rows = [(i, f"a text {i}", "und") for i in range(20)] + [(30, "7", "und")]
    got = corpus_pipeline.language(spark, table_of(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(20))
