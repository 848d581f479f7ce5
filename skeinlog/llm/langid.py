"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of its labelled texts. A
document is parsed greedily into the longest phrases that occur in a language's sample; the fewer
phrases, the closer the languages. Phrase counts times the bits that name a place in the sample,
per symbol of the text, are comparable between languages; the smallest wins.

Texts are read as lower-case letters, with one space for each run of other characters. The whole
text is parsed, in blocks of ``BLOCK`` symbols whose phrases do not cross. Blocks of many documents
advance together, one table lookup each per symbol.

The sample is bounded: ``SNIPPETS`` pieces of ``SNIPPET_CHARS`` characters per language, from the
documents whose id has the smallest hashes. Every language has all letters of its sample as its
alphabet, whatever the script; a letter that is not among them is a phrase of its own there. Its
edges, at most three for each symbol of the sample, are kept in one sparse array. Learned are all
languages, or the ``languages`` (``MAX_LANGUAGES`` by default) of the most labelled texts, by name among equals,
so that the model and what reaches the driver are bounded.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no rate; with no
labelled text at all every text is ``und``; equal counts go to the language first by name. The
score is second / (best + second) of the rates, and 1 if there is one language only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.llm.common import arrow_step, crc32_fold

SNIPPETS, SNIPPET_CHARS = 96, 160
MAX_LANGUAGES = 500
BLOCK = 512
_LANES = 1 << 22  # symbols parsed at once
_SPACE, _UNKNOWN = 0, 1


def sample(docs: DataFrame, languages: int = MAX_LANGUAGES) -> list[tuple[str, list[str]]]:
    """(language, snippets), by language, from labelled documents that are not held out."""
    place = F.xxhash64("doc_id")
    start = F.lit(1) + F.pmod(place, F.greatest(F.lit(1), F.length("text") - SNIPPET_CHARS)).cast("int")
    pieces = docs.where("lang is not null and text is not null").where(crc32_fold(F.col("doc_id")) != 0).select(
        "lang", place.alias("place"), F.substring(F.col("text"), start, F.lit(SNIPPET_CHARS)).alias("piece")
    )
    # The languages of the most labelled texts; so few rows reach the driver however many there are.
    learned = pieces.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    pieces = pieces.join(learned, "lang", "left_semi")
    by = Window.partitionBy("lang").orderBy("place", "piece")
    chosen = pieces.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= SNIPPETS)
    found: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "rank").collect():
        found.setdefault(row.lang, []).append(row.piece)
    return sorted(found.items())


def fold(c: str) -> str:
    """The lower-case letter of a letter; of a letter that becomes several characters the first."""
    return c.lower()[0]


def symbol_table(letters: str) -> np.ndarray:
    """Code point -> symbol: a letter's place in ``letters``, unknown letter, or space."""
    code = {c: i + 2 for i, c in enumerate(letters)}
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = code.get(fold(c), _UNKNOWN)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    found = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = found == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]  # one space for a run of others
    return found[keep]


def automaton(sequence: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a sequence of symbols below ``width``, as (alphabet, edges, root). A
    symbol is read as its place in the sorted ``alphabet`` plus one, and as 0 if it is not there.
    ``edges`` holds the edges of all states but the root in one array, see ``packed``; ``root`` has
    the root's, by symbol, and 0, the root itself, where there is none."""
    alphabet, read = np.unique(sequence, return_inverse=True)
    following, link, length = [{}], [-1], [0]
    last = 0
    for c in (read + 1).tolist():
        current = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = current
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[current] = copy
        last = current
    return alphabet, *packed(following, len(alphabet) + 1)


def packed(following: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, root): states are renamed to places in ``edges`` such that the edge of state s with
    symbol c is at s + c, as s << 32 | next state; any other value there means that s has no such
    edge. Each state takes the first place found at which its edges fit between those set before; the
    search starts further on where the places before are nearly full."""
    place = [0] * len(following)
    size = 2 * (len(following) + width)
    taken, named = bytearray(size), bytearray(size)
    named[0] = 1
    # A place that does not fit a set of symbols never fits it later.
    tried: dict[tuple[int, ...], int] = {}
    start = [1] * (width + 1)
    for state in sorted(range(1, len(following)), key=lambda s: -len(following[s])):
        key = tuple(sorted(following[state]))
        first, others = (key[0], key[1:]) if key else (0, ())
        at, tries = tried.get(key, max(first + 1, start[len(key)])), 0
        while True:
            free = taken.find(0, at) if key else at
            if not 0 <= free < size - width:
                taken.extend(bytes(size))
                named.extend(bytes(size))
                size *= 2
                continue
            at = free
            begin = at - first
            if not named[begin] and not any(taken[begin + c] for c in others):
                break
            at, tries = at + 1, tries + 1
        if tries > 16:
            start[len(key)] = at
        tried[key] = at + 1
        named[begin] = 1
        for c in key:
            taken[begin + c] = 1
        place[state] = begin
    edges = np.full(max(place) + width, -1, np.int64)
    for state in range(1, len(following)):
        for c, to in following[state].items():
            edges[place[state] + c] = place[state] << 32 | place[to]
    root = np.zeros(width, np.int64)
    for c, to in following[0].items():
        root[c] = place[to]
    return edges, root


def phrase_counts(
    sequences: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, block: int = BLOCK
) -> np.ndarray:
    """[sequence, table]: how many phrases each sequence takes."""
    counts = np.zeros((len(sequences), len(tables)), np.int64)
    lanes = [(i, s[b : b + block]) for i, s in enumerate(sequences) for b in range(0, len(s), block)]
    lanes.sort(key=lambda lane: -len(lane[1]))
    if not lanes:
        return counts
    owner = np.array([i for i, _ in lanes])
    lengths = np.array([len(s) for _, s in lanes])
    grid = np.zeros((len(lanes), lengths[0]), np.int32)
    grid[np.arange(lengths[0]) < lengths[:, None]] = np.concatenate([s for _, s in lanes])
    grid = np.ascontiguousarray(grid.T)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for k, (alphabet, edges, root) in enumerate(tables):
        own = np.zeros(width, np.int32)
        own[alphabet] = np.arange(1, len(alphabet) + 1)
        state = np.zeros(len(lanes), np.int64)
        phrases = np.zeros(len(lanes), np.int32)
        for j, n in enumerate(active):
            # The root has no edge in ``edges``, so each miss begins a phrase, an unknown letter its own.
            at, read = state[:n], own[grid[j, :n]]
            found = edges[at + read]
            miss = found >> 32 != at
            phrases[:n] += miss
            state[:n] = np.where(miss, root[read], found & 0xFFFFFFFF)
        np.add.at(counts[:, k], owner, phrases)
    return counts


class Model:
    """Languages with their tables; small, as it holds the bounded sample only."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        joined = {lang: " ".join(texts) for lang, texts in samples}
        letters = "".join(sorted({fold(c) for c in set().union(*joined.values()) if c.isalpha()}))
        self.width = len(letters) + 2
        self.symbols = symbol_table(letters)
        self.languages, self.tables, self.bits = [], [], []
        for lang, text in joined.items():
            read = symbols(text, self.symbols)
            if (read > _SPACE).any():
                self.languages.append(lang)
                self.tables.append(automaton(read, self.width))
                self.bits.append(np.log2(len(read) + 1))

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol for each language, whether the text has a letter)."""
        read = [symbols(t or "", self.symbols) for t in texts]
        length = np.array([len(s) for s in read], float)
        lettered = np.array([bool((s > _SPACE).any()) for s in read], bool)
        counts, first, held = [], 0, 0
        for i, s in enumerate(read):
            held += len(s)
            if held >= _LANES or i == len(read) - 1:
                counts.append(phrase_counts(read[first : i + 1], self.tables, self.width))
                first, held = i + 1, 0
        total = np.concatenate(counts) if counts else np.zeros((0, len(self.tables)))
        return total * np.array(self.bits) / np.maximum(length, 1)[:, None], lettered


def train(docs: DataFrame, languages: int = MAX_LANGUAGES) -> Model:
    return Model(sample(docs, languages))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, rate (bits per symbol of the best language; null for und) and
    lettered (whether the text has a letter). Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rate", "lettered")
    names = docs.columns
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("lang_pred string, score double, rate double, lettered boolean").fields)
    # Plain arrays, bounded by MAX_LANGUAGES tables; a worker reads them once.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def step(batches):
        model = Model.__new__(Model)
        model.__dict__.update(shared.value)
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            rates, lettered = model.rates(texts)
            found = {"lang_pred": [], "score": [], "rate": []}
            for row, ok in zip(rates, lettered):
                if not ok or not len(row):
                    best = ("und", 0.0, None)
                else:
                    k = int(np.argmin(row))
                    second = float(np.min(np.delete(row, k))) if len(row) > 1 else float("inf")
                    total = row[k] + second
                    best = (model.languages[k], 1.0 if total == float("inf") else second / total if total else 0.5, float(row[k]))
                for column, value in zip(found.values(), best):
                    column.append(value)
            yield {**{n: batch.column(i) for i, n in enumerate(names)}, **found, "lettered": lettered}

    return arrow_step(docs, step, schema)
