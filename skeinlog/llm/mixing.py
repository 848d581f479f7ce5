"""Mixing sources by temperature, with built-in functions only.

A source with the share p of all tokens gets the weight p**a / sum(p**a). The exponent a is found by
bisection (several points at a time): the smallest one that keeps the entropy of the weights down
to a target, or that repeats no source more often than a limit. With ``budget`` tokens asked for, a
source's target is its weight of them; without a budget, the budget is the smallest that passes once
over every source, so that nothing is left out and small sources are repeated.

A target is realised as passes over the source. Each pass is a permutation of the source in blocks
of about ``BLOCK_ROWS`` rows: a hash with the pass's number puts a row in a block and orders it there.
Whole passes come first; the last pass goes on while the budget lasts, which the sums of the blocks
decide for all blocks but one. No task sorts more than a block.

Tokens are runs of characters other than ``[\\x20\\x09-\\x0D]``, and one for the end of the text, so
that no source is without tokens. ``position`` tells how much of its source's target lies before a
row: sorted by it, every stretch of the mix has the target weights.

Defined results: a null source is a source of its own. Rows with the same doc_id, source and text
go the same way, each as often as the other. A budget that can't be met within the repetition
limit, and an entropy that no exponent up to ``LARGEST`` reaches, are errors; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm.common import save, scratch

REPEATS, SEED, BLOCK_ROWS = 2.0, 17, 4096
LARGEST, POINTS, ROUNDS = 16.0, 15, 7
UNIT = ["source_key", "id_key", "text_key"]


def _unit_columns() -> dict:
    return {
        "source_key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")),
        "id_key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        "text_key": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256),
    }


def token_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _measures(shares: DataFrame, exponents: list[float], budget_share: float | None) -> list[tuple[float, float]]:
    """(entropy, largest number of repeats) of the weights for each exponent; one pass over the sources."""
    log = F.ln("share")
    columns = []
    for i, a in enumerate(exponents):
        power = F.exp(a * log)
        columns += [
            F.sum(power).alias(f"z{i}"), F.sum(power * log).alias(f"e{i}"),
            F.max((a - 1) * log).alias(f"most{i}"), F.min((a - 1) * log).alias(f"least{i}"),
        ]
    row = shares.agg(*columns).first()
    out = []
    for i, a in enumerate(exponents):
        z, most, least = row[f"z{i}"], row[f"most{i}"], row[f"least{i}"]
        repeats = math.exp(most - least) if budget_share is None else budget_share * math.exp(most) / z
        out.append((math.log(z) - a * row[f"e{i}"] / z, repeats))
    return out


def exponent(shares: DataFrame, repeats: float | None, entropy: float | None, budget_share: float | None = None) -> float:
    """The smallest exponent with at most the given entropy or number of repeats."""

    def fits(measure: tuple[float, float]) -> bool:
        return measure[0] <= entropy + 1e-9 if entropy is not None else measure[1] <= repeats * (1 + 1e-9)

    low, high = 0.0, LARGEST if entropy is not None else 1.0
    ends = _measures(shares, [low, high], budget_share)
    if fits(ends[0]):
        return low
    if not fits(ends[1]):
        raise ValueError("no exponent meets the target")
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        good = [fits(m) for m in _measures(shares, points, budget_share)] + [True]
        first = good.index(True)
        low, high = ([low] + points)[first], (points + [high])[first]
    return high


def plan(
    docs: DataFrame, budget: int | None = None, repeats: float | None = REPEATS, entropy: float | None = None, seed: int = SEED
) -> DataFrame:
    """One row for each unit (rows of one doc_id, source and text) and pass that the mix takes:
    doc_id, source, rows, n_tokens (of all its rows), epoch, block, position, and the unit's keys."""
    folder = scratch(docs.sparkSession)
    keyed = docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), *[c.alias(n) for n, c in _unit_columns().items()])
    units = keyed.groupBy(*UNIT).agg(
        F.first("doc_id").alias("doc_id"), F.first("source").alias("source"),
        F.count("*").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
    )
    units = save(units, folder, "units")
    sources = save(
        units.groupBy("source_key").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("units")), folder, "sources"
    )
    total = sources.agg(F.sum("held")).first()[0]
    if total is None:
        targets = sources.withColumn("target", F.col("held"))
    else:
        shares = sources.withColumn("share", F.col("held") / F.lit(float(total)))
        budget_share = None if budget is None else budget / total
        a = exponent(shares, repeats, entropy, budget_share)
        # Tokens for each unit of p**a: what the budget gives, or one whole pass over every source.
        summed = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.pow("share", F.lit(1 - a))).alias("once")).first()
        scale = float(total) * summed.once if budget is None else budget / summed.z
        targets = shares.withColumn("target", F.round(F.pow("share", F.lit(a)) * scale).cast("long"))
    targets = targets.select(
        "source_key", "held", "target",
        F.floor(F.col("target") / F.col("held")).cast("int").alias("whole"),
        F.ceil(F.col("units") / BLOCK_ROWS).cast("long").alias("blocks"),
    )
    # Spark broadcasts the targets while they are small and splits a hot source's rows otherwise.
    copies = units.join(targets, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    copies = copies.where("epoch < whole or whole * held < target")
    draw = [F.lit(seed), F.col("epoch"), *map(F.col, UNIT)]
    copies = copies.withColumn("block", F.pmod(F.xxhash64(*draw), F.col("blocks")))
    block = ["source_key", "epoch", "block"]
    order = Window.partitionBy(*block).orderBy(F.xxhash64(F.lit("order"), *draw), *UNIT)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    copies = save(copies.withColumn("inside", F.sum("n_tokens").over(upto) - F.col("n_tokens")), folder, "copies")
    sums = copies.groupBy(*block).agg(F.sum("n_tokens").alias("of_block"))
    passed = Window.partitionBy("source_key", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*block, F.coalesce(F.sum("of_block").over(passed), F.lit(0)).alias("outside"))
    before = F.col("epoch") * F.col("held") + F.col("outside") + F.col("inside")
    placed = copies.join(sums, block).withColumn("before", before)
    taken = placed.where((F.col("epoch") < F.col("whole")) | (F.col("before") + F.col("n_tokens") <= F.col("target")))
    return taken.select(
        "doc_id", "source", "rows", "n_tokens", "epoch", "block", (F.col("before") / F.col("target")).alias("position"), *UNIT
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the plan takes it."""
    names = docs.columns
    times = plan(docs, **options).groupBy(*UNIT).agg(F.count("*").cast("int").alias("times"))
    keys = {f"_mix_{n}": c for n, c in _unit_columns().items()}
    times = times.select("times", *[F.col(n).alias(f"_plan_{n}") for n in UNIT])
    same = [F.col(f"_mix_{n}") == F.col(f"_plan_{n}") for n in UNIT]
    joined = docs.withColumns(keys).join(times.withColumnRenamed("times", "_mix_times"), same)
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*names)
