"""Benchmark passages, the prefix trie and hard negatives against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import decontaminate, negatives, prefixtrie

DOCS = "doc_id long, text string, n_items string, hash int"  # the last two clash with names used inside
ITEMS = "item_id long, text string, run int"
TURNS = "conv_id long, turn long, role string, text string, path string, depth int"
VECTORS = "vec_id long, embedding array<float>, label int, score string, target int"


def plain_contamination(docs, items, window=10):
    def words(text):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    wanted = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if item is not None and n else 0):
            wanted[tuple(w[i : i + n])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    held |= wanted[tuple(w[i : i + n])]
        ids = hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(held), ids, bool(hit)))
    return out


def contaminated(spark, docs, items):
    got = decontaminate.contamination(
        spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    )
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(str, (tuple(r) for r in got.collect())))


def test_contamination_equals_a_plain_search(spark):
    random = np.random.default_rng(4)
    few = [f"w{i}" for i in range(6)]  # few words: many windows that nearly match, ties and repeats

    def text(n, words=few):
        return " ".join(random.choice(words, n))

    passage = "Größe, über ALLES; und 12 more words that make one passage here"
    items = [(1, text(30)), (2, text(12)), (3, passage), (4, "short item"), (5, ""), (6, None), (None, text(20)), (7, passage), (3, "w1 w1 w1")]
    docs = [(i, text(60)) for i in range(30)]
    docs += [(40, f"{text(5)} x {passage.upper().replace('SS', 'ss')} y {text(5)}"), (41, f"a {passage} b {passage} c")]
    docs += [(41, passage), (None, passage), (42, None), (43, ""), (44, "!!! ..."), (45, "a short item, shorter"), (46, items[1][1])]
    docs += [(47, " ".join([text(3000), passage, text(40_000)]))]
    assert contaminated(spark, docs, items) == sorted(map(str, plain_contamination(docs, items)))


def test_contamination_of_empty_tables(spark):
    docs = [(1, "some words"), (2, None)]
    assert contaminated(spark, docs, []) == sorted(map(str, plain_contamination(docs, [])))
    assert contaminated(spark, [], [(1, "some words")]) == []


def test_every_span_of_a_window_shares_a_mark():
    random = np.random.default_rng(8)
    for _ in range(200):
        span = random.integers(0, 4, 10).astype(np.uint64)
        sides = [np.concatenate((random.integers(0, 4, 7), span, random.integers(0, 4, 9))).astype(np.uint64) for _ in range(2)]
        kept = [set(decontaminate.winnowed(s, 5, 10)[0].tolist()) for s in sides]
        assert kept[0] & kept[1] & set(range(7, 13))


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, mark), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    members = collections.defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - c % 5, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for path, convs in members.items():
        below = [(q, m) for q, m in members.items() if q[: len(path)] == path]
        ends = ",".join(str(c) for c, whole in convs if whole)
        out.append((
            convs[0][0], len(path), members[path[:-1]][0][0] if path else None, len(convs), children[path],
            sum(not children[q] for q, _ in below), sum((len(m) - 1) * len(q[-1][1].encode()) for q, m in below if q),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def grown(spark, rows):
    turns = prefixtrie.turn_sequences(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS))
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 9
    found = prefixtrie.trie(prefixtrie.rebuilt(turns, conv_id - conv_id % 5, head, 8))
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("cells", [7, 40, 1 << 19])
def test_trie_equals_a_plain_one(spark, monkeypatch, cells):
    monkeypatch.setattr(prefixtrie, "CELLS", cells)  # small slabs: most nodes lie in several
    random = np.random.default_rng(cells)
    rows = []
    for conv in range(0, 240):
        if conv % 15 == 0:
            continue  # the conversation that others begin with is absent
        kind = conv % 3  # a third are copies of one conversation
        for turn in range(6 if kind == 0 else int(random.integers(1, 9))):
            text = f"said {turn}" if kind == 0 else "".join(random.choice(list("abé"), 2))
            rows.append((conv, turn, "user" if turn % 2 else None, text if random.random() < 0.95 or kind == 0 else None))
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 3, None, ""), (400, 3, None, ""), (400, 3, "", None)]
    rows += [(None, 0, "user", "a"), (None, None, None, None)]
    rows += [(700, t, "user", f"t{t % 3}") for t in range(300)] + [(701, t, "user", f"t{t % 3}") for t in range(290)]
    assert grown(spark, rows) == plain_trie(rows)


def test_trie_of_few_conversations(spark):
    assert grown(spark, []) == []
    assert grown(spark, [(None, 1, "a", "b")]) == []
    assert grown(spark, [(7, 0, "a", "b"), (7, 0, "a", "b")]) == plain_trie([(7, 0, "a", "b"), (7, 0, "a", "b")])
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(turnless, 0, "user", "only"), (-3, 1, "user", "x")]
    assert grown(spark, rows[:1]) == plain_trie(rows[:1])


def plain_negatives(rows):
    good = [
        (i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a in sorted({i for i, _, _ in good if i % 100 == 0}):
        _, own, vector = min((r for r in good if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = [(sum(x * y for x, y in zip(vector, v)), i, lab) for i, lab, v in good if i != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for k, (p, pid, _) in enumerate([s for s in scored if s[2] == own][:5]):
            fitting = [s for s in scored if s[2] != own and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(a, pid, k + 1, r + 1, nid, p, n) for r, (n, nid, _) in enumerate(fitting)]
    return sorted(map(str, out))


def mined(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    found = negatives.hard_negatives(negatives.usable(table, F.col("label")), F.col("vec_id") % 100 == 0)
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_negatives_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(negatives, "CELLS", cells)  # 64: eight rows in a slice, two anchors in a block
    random = np.random.default_rng(2)
    centres = random.normal(size=(4, 8))
    rows = []
    for i in range(0, 400, 3 if cells > 64 else 5):
        label = int(random.integers(4)) if i % 2 else 1
        vector = [float(np.float32(x)) for x in (centres[label] + random.normal(size=8)).round(1)]
        rows.append((i, vector, label))
    copy = rows[4][1]
    rows += [(1000 + i, copy, i % 3) for i in range(30)]  # copies: ties
    rows += [(100, copy, 1), (100, copy, 1), (100, [-x for x in copy], 2), (200, copy[:5], 1), (7, copy[:3], 1)]
    rows += [(None, copy, 1), (300, copy, None), (300, None, 1), (301, [None] * 8, 1), (302, [float("inf")] * 8, 1), (500, [], 1)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, 1), (100, [], 2), (101, [], 1)]) == []


def test_bounds_hold_the_score():
    random = np.random.default_rng(1)
    for width in (1, 3, 16, 37):
        left, right = (random.integers(-300, 300, (20, width)) for _ in range(2))
        scores = left @ right.T
        for level in range(len(negatives.LEVELS)):
            lower, upper = negatives.Bounds(left).between(negatives.Bounds(right), level, np.arange(20), np.arange(20))
            assert (lower <= scores).all() and (scores <= upper).all()
