"""Mixing against a plain computation, and the whole pipeline on an odd table."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinlog.llm import mixing
from tests.llm.test_near_copies import plain_rows

DOCS = "doc_id long, text string, source string, rows int, block string"


def plain_plan(units, draws, repeats, block_rows):
    """Rows (id_key, source_key, epoch, block, position) of a mix without a budget. units: (source, id,
    text key, tokens); draws: hashes of a unit in a pass, for its block and for its order there."""
    held, count = {}, {}
    for source, _, _, tokens in units:
        held[source], count[source] = held.get(source, 0) + tokens, count.get(source, 0) + 1
    total = sum(held.values())
    share = {s: h / total for s, h in held.items()}
    wide = max(share.values()) / min(share.values())
    # Repeats fall from wide at a = 0 to 1 at a = 1.
    a = 0.0 if wide <= repeats else 1 - math.log(repeats) / math.log(wide)
    scale = total * max(p ** (1 - a) for p in share.values())
    out = []
    for source in held:
        target = round(share[source] ** a * scale)
        whole, blocks, epoch = target // held[source], math.ceil(count[source] / block_rows), 0
        while epoch < whole or (epoch == whole and whole * held[source] < target):
            rows = []
            for s, i, t, tokens in units:
                if s == source:
                    draw, order = draws[epoch, s, i, t]
                    rows.append((draw % blocks, order, i, t, tokens))
            before = epoch * held[source]
            for block, _, i, t, tokens in sorted(rows):
                if epoch < whole or before + tokens <= target:
                    out.append((i, source, epoch, block, round(before / target, 9)))
                before += tokens
            epoch += 1
    return sorted(out)


@pytest.mark.parametrize(("repeats", "block_rows"), [(2.0, 4096), (2.0, 7), (5.0, 3), (1.0, 10)])
def test_a_plan_equals_a_plain_one(spark, monkeypatch, repeats, block_rows):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    rows = [(i, "w " * (i % 11), "big") for i in range(120)] + [(500 + i, f"a{i} b c", "mid") for i in range(30)]
    rows += [(800 + i, "x y", None) for i in range(9)] + [(900, None, "tiny"), (901, "", "tiny"), (None, "no id", "tiny"), (902, "t", "")]
    rows += [(3, "w " * 3, "big"), (3, "w " * 3, "big"), (3, "other text", "big")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    got = mixing.plan(docs, repeats=repeats)
    keys = docs.select(*[c.alias(n) for n, c in mixing._unit_columns().items()]).distinct()
    drawn = keys.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(6))))
    draw = [F.lit(mixing.SEED), F.col("epoch"), *map(F.col, mixing.UNIT)]
    drawn = drawn.select("*", F.xxhash64(*draw).alias("draw"), F.xxhash64(F.lit("order"), *draw).alias("order"))
    draws = {(r.epoch, r.source_key, r.id_key, r.text_key): (r.draw, r.order) for r in drawn.collect()}
    of = docs.select(mixing.token_count(F.col("text")).alias("n"), *[c.alias(n) for n, c in mixing._unit_columns().items()])
    tokens = {}
    for r in of.collect():
        key = (r.source_key, r.id_key, r.text_key)
        tokens[key] = tokens.get(key, 0) + r.n
    wanted = plain_plan([(*k, n) for k, n in tokens.items()], draws, repeats, block_rows)
    found = sorted((r.id_key, r.source_key, r.epoch, r.block, round(r.position, 9)) for r in got.collect())
    assert found == wanted
    # Every unit is there, and none more often than the limit.
    times = {}
    for i, s, *_ in found:
        times[i, s] = times.get((i, s), 0) + 1
    assert {i for i, _ in times} == {k[1] for k in tokens}


def plain_lines(rows):
    """The texts that are left when lines in three documents stay in the last one only."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if i is None or len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])]
        out.append((i, t if t is None else "\n".join(kept)))
    return out


def test_the_whole_run_on_an_odd_table(spark, tmp_path):
    common = "This line stands in many of the documents."
    rows = [(i, f"Document {i} says {' '.join(f'word{i}n{j}' for j in range(12 + i % 5))}.\n{common}") for i in range(20)]
    rows += [(100 + i, "A copy " + " ".join(f"w{j}" for j in range(60)) + f" ends {i % 3}") for i in range(9)]
    rows += [(5, rows[5][1]), (5, "another text of the same number"), (None, "no number at all"), (None, rows[0][1]), (200, None), (201, "12 34"), (202, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"
    docs = [(i, t, None if (i or 0) % 4 else "en", None if (i or 0) % 3 else "web", len(t or ""), 0.5, "own") for i, t in rows]
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    lettered = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    left = plain_lines(lettered)
    wanted = {component for _, _, component in plain_rows(left)}  # none for rows without a number, which all stay
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_pieces", "round_trip"]
    found = got.collect()
    assert all(r.round_trip for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    # One document of each group of near copies stays, those without a number all do; small sources come twice at most.
    assert set(by_id) == wanted
    assert all(len(rs) <= 2 * max(1, sum(1 for i, _ in left if i == d)) for d, rs in by_id.items())
    assert all(r.n_chars == len(dict((i, t) for i, t in left if i == d)[d] or "") for d, rs in by_id.items() if d not in (None, 5) for r in rs)

