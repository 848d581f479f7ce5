"""Passages of benchmark items in documents, found by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Every run of
``gram`` words has a hash; of each window of neighbouring runs that spans ``window`` words the
smallest is kept, the rightmost of equal ones. Both sides keep the same run of a passage they share,
so that each shared passage of ``window`` words or more holds a run that was kept on both sides at
the same place. Such a mark carries the words around it, as many as a window through the run can
reach; where the marks of a document and an item meet, the match is extended over these words to the
left and to the right, and counts if it has ``window`` words. So no text is moved or read again.

An item of fewer words is one window; its mark is the hash of all its words, and of a document the
marks of that length are all its runs. There are at most ``window - 1`` such lengths.

The marks of the items meet those of the documents in a join that Spark plans by size. Before it, a
bit filter of a fixed size (``FILTER_BITS``) lets documents' marks go that no item has; it is the
only thing that is broadcast by hand. Equal marks with equal surroundings of many items are one row
of the join, and one passage of a document is looked up once for all of them.

Defined results: a null text has no words. Rows without item_id are no items; rows of one item_id are
one item with the windows of all its texts. A document is a row: rows that share a doc_id, or have
none, are judged each for itself. Words are compared by 64-bit hashes. Other columns are not used, and
the result has its own columns only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm.common import arrow_step, save, scratch
from skeinlog.llm.fingerprints import window_minima
from skeinlog.llm.hashing import mix, word_hashes

WINDOW, GRAM = 10, 5
FILTER_BITS = 1 << 24  # 2 MB
_STEP = np.uint64(0x5851F42D4C957F2D)
_MARKED = "row long, doc_id long, n_words long, place int, run int, hash long, around array<long>"


def _breaks() -> np.ndarray:
    """Which bytes are in no word; all bytes of other letters than ASCII are."""
    inside = np.zeros(256, bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):  # A-Z count as a-z
        inside[first : last + 1] = True
    return ~inside


BREAKS = _breaks()


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of each run of ``run`` words."""
    n = len(words) - run + 1
    total = np.full(max(n, 0), run, np.uint64)
    for i in range(run if n > 0 else 0):
        total = total * _STEP + words[i : n + i]
    return mix(total)


def winnowed(words: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of ``gram`` words that are the smallest of a window of ``window``
    words; nothing for fewer words than a window."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = run_hashes(words, gram)
    width = window - gram + 1
    least = window_minima(hashes, width)
    # The rightmost place of each window's minimum: the last place so far that equals it.
    places = np.full(len(least), -1, np.int64)
    for i in range(width):
        here = hashes[i : i + len(least)]
        places = np.where(here == least, np.arange(i, i + len(least)), places)
    places = np.unique(places)
    return places, hashes[places]


def surroundings(words: np.ndarray, places: np.ndarray, gram: int, window: int) -> np.ndarray:
    """For each place the words from ``window - gram`` before the run to as many after it; 0 where
    the text has none."""
    reach = window - gram
    padded = np.concatenate((np.zeros(reach, np.uint64), words, np.zeros(reach, np.uint64)))
    return padded[places[:, None] + np.arange(gram + 2 * reach)]


def bit_filter(hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    filter_ = np.zeros(bits, bool)
    filter_[(hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(filter_)


def _passes(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(filter_) * 8 - 1)).astype(np.int64)
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def item_marks(items: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(item_id, run, hash, around): run is the number of words that the hash covers."""

    def step(batches):
        for batch in batches:
            out = {"item_id": [], "run": [], "hash": [], "around": []}
            for item, text in zip(batch.column(0), batch.column(1).to_pylist()):
                words = word_hashes(text or "", BREAKS)
                if 0 < len(words) < window:
                    places, run = np.zeros(1, np.int64), len(words)
                    hashes, around = run_hashes(words, run), words[None]
                else:
                    (places, hashes), run = winnowed(words, gram, window), gram
                    around = surroundings(words, places, gram, window)
                out["item_id"] += [item] * len(places)
                out["run"] += [0 if run == gram and len(words) >= window else run] * len(places)
                out["hash"] += hashes.view(np.int64).tolist()
                out["around"] += around.view(np.int64).tolist()
            out["item_id"] = pa.array([i.as_py() for i in out["item_id"]], batch.column(0).type)
            yield out

    rows = items.where("item_id is not null").select("item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    return arrow_step(rows, step, f"item_id {kind}, run int, hash long, around array<long>")


def document_marks(docs: DataFrame, filter_: np.ndarray, short: list[int], gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """For each document a row with its number of words, and a row for each mark that an item may
    have. ``run`` is 0 for a winnowed mark and the number of words for one of a short item."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)  # FILTER_BITS

    def step(batches):
        bits = shared.value
        for batch in batches:
            columns = {c: [] for c in ("row", "doc_id", "n_words", "place", "run", "hash", "around")}

            def add(row, doc_id, n, places, run, hashes, around):
                count = len(places)
                columns["row"] += [row] * count
                columns["doc_id"] += [doc_id] * count
                columns["n_words"] += [n] * count
                columns["place"] += places
                columns["run"] += [run] * count
                columns["hash"] += hashes
                columns["around"] += around

            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = word_hashes(text or "", BREAKS)
                add(row, doc_id, len(words), [None], None, [None], [None])
                places, hashes = winnowed(words, gram, window)
                keep = _passes(hashes, bits)
                if keep.any():
                    around = surroundings(words, places[keep], gram, window).view(np.int64)
                    add(row, None, None, places[keep].tolist(), 0, hashes[keep].view(np.int64).tolist(), around.tolist())
                for run in short:
                    hashes = run_hashes(words, run)
                    places = np.flatnonzero(_passes(hashes, bits))
                    around = words[places[:, None] + np.arange(run)].view(np.int64)
                    add(row, None, None, places.tolist(), run, hashes[places].view(np.int64).tolist(), around.tolist())
            yield columns

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return arrow_step(rows, step, _MARKED)


def _same(a: Column, b: Column, places: range) -> Column:
    """How many words are the same from the first of ``places`` on."""
    count = F.lit(0)
    for i in reversed(places):
        count = F.when((F.get(a, F.lit(i)) == F.get(b, F.lit(i))) & (F.get(a, F.lit(i)) != 0), count + 1).otherwise(F.lit(0))
    return count


def contamination(docs: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs."""
    folder = scratch(docs.sparkSession)
    marks = save(item_marks(items, gram, window).distinct(), folder, "items")
    short = sorted(r.run for r in marks.where("run > 0").select("run").distinct().collect())  # below window
    # Set bits by word of the filter, so that as many rows as the filter has words reach the driver.
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = marks.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {FILTER_BITS - 1}) & 63 as int))")).alias("bits")
    )
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    filter_ = np.packbits(np.unpackbits(table.view(np.uint8), bitorder="little"))

    found = save(document_marks(docs, filter_, short, gram, window), folder, "documents")
    # One row for a mark and its surroundings; ``passage`` stands for all items that have them.
    passages = marks.groupBy("run", "hash", "around").agg(F.count("*").alias("n"))
    passages = save(passages.withColumn("passage", F.monotonically_increasing_id()), folder, "passages")
    own = passages.select(F.col("run").alias("r"), F.col("hash").alias("h"), F.col("around").alias("words"), "passage")
    met = found.where("hash is not null").join(own, (F.col("run") == F.col("r")) & (F.col("hash") == F.col("h")))
    reach = window - gram
    left = _same(F.reverse("around"), F.reverse("words"), range(gram + reach, gram + 2 * reach))
    right = _same(F.col("around"), F.col("words"), range(gram + reach, gram + 2 * reach))
    inner = F.slice("around", reach + 1, gram) == F.slice("words", reach + 1, gram)
    met = met.withColumns({"left": F.when(F.col("run") == 0, left).otherwise(F.lit(0)), "right": F.when(F.col("run") == 0, right).otherwise(F.lit(0))})
    whole = F.when(F.col("run") > 0, F.col("around") == F.col("words")).otherwise(
        inner & (F.col("left") + F.col("right") + gram >= window)
    )
    covered = F.when(F.col("run") > 0, F.col("run")).otherwise(F.col("right") + gram)
    hits = save(
        met.where(whole).select(
            "row", "passage", (F.col("place") - F.col("left")).alias("begin"), (F.col("place") + covered).alias("end")
        ),
        folder, "hits",
    )
    # Words in the union of the matches: what each adds to the right of those that begin before it.
    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "begin", "end").distinct().withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "upto"))).cast("long").alias("n_hit")
    )
    of_passage = marks.join(
        passages, ["run", "hash", "around"]
    ).select("passage", F.col("item_id").cast("string").alias("item"))
    held = hits.select("row", "passage").distinct().join(of_passage, "passage").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )
    of_row = n_hit.join(held, "row")
    named = found.where("n_words is not null").select("row", "doc_id", "n_words").join(of_row, "row", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    items_ = F.coalesce("items", none)
    return named.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
