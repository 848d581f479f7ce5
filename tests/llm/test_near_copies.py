"""Components of near copies against a plain version: families at the threshold, long lists, jobs of blocks."""

import itertools
import re

import numpy as np
import pytest

from skeinlog.llm import neardup

DOCS = "doc_id long, text string, list int, node int, digest string"


def plain_rows(rows, similarity=75):
    """(doc_id, number of shingles, component) of each row, in the rows' order."""

    def shingles(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    for a, b in itertools.combinations(named, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similarity * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    least = {}
    for k in named:
        least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    return [(i, len(s), None if i is None else least[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def plain(rows):
    return sorted(map(str, plain_rows(rows)))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS).repartition(3)
    got = neardup.near_duplicates(docs).collect()
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got), got


def families(random):
    """Chains and clouds of copies with more and more edits, so that some pairs lie at the threshold."""
    rows, at = [], 0
    for size, edits in ((40, 1), (60, 2), (60, 3), (30, 5), (25, 12)):
        base = [f"f{at}w{i}" for i in range(int(random.integers(60, 120)))]
        for _ in range(size):
            words = list(base)
            for place in random.integers(0, len(base), edits):
                words[place] = f"x{random.integers(1 << 40)}"
            rows.append((at, " ".join(words)))
            at += 1
    words = [f"c{i}" for i in range(200)]
    for i in range(40):  # a chain: each copy like its neighbours only
        rows.append((1000 - i, " ".join(words[4 * i : 4 * i + 40])))
    return rows


@pytest.mark.parametrize(("short", "items"), [(8, 1 << 20), (2, 300), (2, 1)])
def test_components_equal_a_plain_version(spark, monkeypatch, short, items):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "JOB_ITEMS", items)
    random = np.random.default_rng(short + items)
    rows = families(random)
    rows += [(5000, None), (5001, ""), (5002, " \t"), (None, rows[0][1]), (None, None), (3, rows[3][1]), (5003, "one two"), (5004, "ONE  two")]
    rows += [(6000 + i, "the very same text of seven words") for i in range(30)] + [(7000, " ".join(f"l{i}" for i in range(30_000)))]
    got, whole = found(spark, rows)
    assert got == plain(rows)
    of = {}
    for r in whole:
        of.setdefault(r.component_id if r.n_shingles else (r.doc_id, r.digest), []).append(r.kept)
    assert all(sum(kept) == 1 for c, kept in of.items() if c is not None and not (isinstance(c, tuple) and c[0] is None))


def test_tables_without_copies(spark):
    assert found(spark, [])[0] == []
    rows = [(1, "nothing like the other one at all"), (2, None), (None, "")]
    assert found(spark, rows)[0] == plain(rows)
