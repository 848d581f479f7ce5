"""Near duplicates by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles. A MinHash signature of ``COORDINATES`` values
is posted under its (coordinate, value) pairs. Two documents of similarity 0.75 agree in fewer than
``MATCHES`` of 32 coordinates with a probability below 3e-7, so pairs with fewer collisions are let
go. Collisions are counted by prefix and skip: pairs are ordered by list length, only the rarest
``COORDINATES - MATCHES + 1`` of a document are merged (two documents with enough collisions must
meet there), and the remaining coordinates, the long lists, are skipped and only compared for pairs
already found. Every pair that remains is confirmed on the full sets.

Equal sets are one node from the start. Of a list of up to ``SHORT`` members all pairs are tested. In a
longer one every member is first tested against the list's hub, the member that agrees most with all
others; what is confirmed is merged. Members of different components that are left then meet in
jobs: the members of a list, in blocks if they are many, stand in one task as a matrix of signatures,
where all pairs are counted at once, and of each pair that collides often enough the list that is the
first of both takes care. A job gives back its members' partners as one row for each member, and gets
the members' full sets, each once, to count the intersections; it returns no more links than it needs
to join what is connected. So no row is made for a pair of a long list, and a set moves once for a job.

A shingle that no other document of the lists has lies in no intersection. Counting these bounds the
similarity that a document can reach with any other, and a pair's likewise; documents and pairs below
the threshold by this bound are not compared. So a family of copies that are edited too much to be
linked costs no comparison for each pair.

Only documents in lists are read a second time, for their full sets: a bit filter of their keys lets the
other texts go before anything moves.

Defined results: a document is a doc_id with a text, so rows that share a doc_id and have different
texts are decided each for itself, and of rows equal in both one is kept. The smallest doc_id of a
component names it; the smallest text digest decides between that doc_id's texts. A null or empty
text, or one without words, has an empty set and no links; rows without doc_id take part in nothing
and are kept, with a null component_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.llm.common import BitFilter, arrow_step, part_count, save, scratch
from skeinlog.llm.components import components
from skeinlog.llm.hashing import mix, shingle_set, spread

WORDS, SIMILARITY = 5, 75  # words in a shingle; percent of the union
COORDINATES, MATCHES = 32, 11
SHORT = 8  # members of a list whose pairs are all tested
JOB_ITEMS = 1 << 20  # shingles of a job's block

_SIGNED = "doc_id long, digest binary, n_shingles long, set_sum long, set_xor long, signature array<long>"
_SET = ["n_shingles", "set_sum", "set_xor"]


def signature(items: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The smallest of each of len(factors) hashes over a set of 64-bit items."""
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for begin in range(0, len(items), 512):
        part = items[begin : begin + 512, None] * factors + terms
        least = np.minimum(least, part.min(axis=0))
    return least.view(np.int64)


def digest(text: Column) -> Column:
    """Tells texts apart; a null text is not an empty one."""
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b""))


def signatures(docs: DataFrame, words: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """Per row: text digest, size and 128-bit fingerprint of its shingle set, and its signature."""
    factors, terms = spread(coordinates, 2) | np.uint64(1), spread(coordinates, 3)

    def step(batches):
        for batch in batches:
            sizes, sums, xors, all_signed = [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text, words)
                sizes.append(len(items))
                sums.append(int(mix(items).sum(dtype=np.uint64).astype(np.int64)))
                xors.append(int(np.bitwise_xor.reduce(mix(items + np.uint64(7))).astype(np.int64)))
                all_signed.append(signature(items, factors, terms) if len(items) else np.empty(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in all_signed])))
            yield {
                "doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_shingles": sizes, "set_sum": sums, "set_xor": xors,
                "signature": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(all_signed))),
            }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), "text")
    return arrow_step(rows, step, _SIGNED)


def shingles(docs: DataFrame, words: int, keys: list[str], key: Column, filter_: BitFilter) -> DataFrame:
    """The keys and items: the full shingle set of each document whose ``key`` the filter may hold."""
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("items", T.ArrayType(T.LongType()))])

    def step(batches):
        for batch in batches:
            batch = batch.filter(filter_.holds(batch.column("_key")))
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield {**{k: batch.column(k) for k in keys}, "items": sets}

    return arrow_step(docs.select(*keys, "text", key.alias("_key")), step, schema)


def postings(nodes: DataFrame, coordinates: int, prefix: int) -> DataFrame:
    """(list, node, weight, length): each node under the rarest of its coordinate-value pairs. Pairs of
    one node only are the rarest of all and need no list, but count as a part of the prefix. weight:
    how many postings the node's pairs have in all."""
    # One exchange serves the count and the join. A list is named by a hash of its pair; two lists of one
    # name would only be merged as one.
    posted = nodes.select("node", F.posexplode("signature").alias("at", "value"))
    posted = posted.select("node", F.xxhash64("at", "value").alias("list")).repartition(part_count(nodes.sparkSession), "list")
    lists = posted.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    own = posted.join(lists, "list").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("length", "list"))).alias("shared"), F.sum("length").alias("weight"),
    )  # at most one entry per coordinate
    merged = F.slice("shared", 1, F.greatest(F.lit(0), F.size("shared") - (coordinates - prefix)))
    enough = own.where(F.size("shared") > coordinates - prefix)
    return enough.select("node", "weight", F.explode(merged).alias("p")).select("p.list", "p.length", "node", "weight")


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, similarity: int, folder: str) -> DataFrame:
    """Those of the pairs (a, b) that have enough collisions and are similar on their full sets."""

    def beside(rows, table, column):
        for side in ("a", "b"):
            named = table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))
            rows = rows.join(named, side)
        return rows

    hits = F.size(F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda x: x))
    near = save(beside(pairs, nodes, "signature").where(hits >= matches).select("a", "b"), folder, "colliding")
    # Only the sets of these pairs move.
    needed = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    found = beside(near, sets.join(needed, "node", "left_semi"), "items")
    return found.where(100 * both >= similarity * union).select("a", "b")


def unshared(sets: DataFrame) -> DataFrame:
    """(node, alone): how many items of each node no other node has."""
    of_item = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(
        F.count("*").alias("holders"), F.min("node").alias("node")
    )
    alone = of_item.where("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return sets.select("node").join(alone, "node", "left").select("node", F.coalesce("alone", F.lit(0)).alias("alone"))


def hopeful(nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(node, shared, n_shingles, signature) of the nodes with a list that may be similar to another: of
    ``shared`` items at most anyone else has one."""
    found = nodes.join(unshared(sets), "node").withColumn("shared", F.col("n_shingles") - F.col("alone")).drop("alone")
    return found.where(100 * F.col("shared") >= similarity * F.col("n_shingles"))


def reaches(similarity: int, n, shared, other_n, other_shared):
    """Whether two sets of n items, of which at most ``shared`` are anyone else's, can be similar."""
    least = F.least if isinstance(n, Column) else np.minimum
    both = least(shared, other_shared)
    return 100 * both >= similarity * (n + other_n - both)


def _jobs(members: DataFrame, job_items: int) -> DataFrame:
    """The members of open lists with the ``job`` they meet in and the ``side`` they stand on there: 0 and 1
    are two blocks whose pairs are counted, 2 is a block by itself. Short lists share jobs."""
    sizes = members.groupBy("list").agg(F.ceil(F.sum("n_shingles") / F.lit(job_items)).cast("int").alias("blocks"))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    packs = max(1, math.ceil(total / job_items))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = members.join(sizes, "list").withColumn("block", block)
    # A block meets itself and every other block once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    job = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("list"), F.lit(packs))).otherwise(F.xxhash64("list", low, high))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return rows.withColumns({"job": job, "side": side}).drop("blocks", "block", "other")


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["list"].to_numpy(), kind="stable")))


def _candidates(table: pa.Table, matches: int, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows behind it in its list) of the members of a job, by list, that collide often enough, reach
    the threshold by their bounds and have no earlier list in common."""
    lists, n, shared, component, side = (table[c].to_numpy() for c in ("list", "n_shingles", "shared", "component", "side"))
    signed, own = _matrix(table["signature"]), _padded(table["own"])
    edges = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1], [True])))
    for begin, end in zip(edges[:-1], edges[1:]):
        for a in range(begin, end - 1):
            rest = np.arange(a + 1, end)
            rest = rest[(component[rest] != component[a]) & ((side[rest] == 2) | (side[rest] != side[a]))]
            rest = rest[reaches(similarity, n[a], shared[a], n[rest], shared[rest])]
            rest = rest[(signed[rest] == signed[a]).sum(axis=1) >= matches]
            rest = rest[~np.isin(own[rest], own[a][own[a] < lists[begin]]).any(axis=1)]
            if len(rest):
                yield a, rest


def _hopefuls(matches: int, similarity: int):
    """One job: its members that have a candidate."""

    def solve(_, table):
        table = _sorted(table)
        keep = np.zeros(len(table), bool)
        for a, rest in _candidates(table, matches, similarity):
            keep[a] = keep[rest] = True
        return table.filter(pa.array(keep))

    return solve


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as the rows of a matrix, filled up with a value that no list has."""
    parts = _slices(column)
    out = np.full((len(parts), max(map(len, parts), default=0)), np.iinfo(np.int64).max)
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _links(matches: int, similarity: int):
    """One job, with the members' full sets: links (a, b) between similar ones, no more than connect them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(_, table):
        table = _sorted(table)
        node = table["node"].to_numpy()
        # Items by number, so that a table of marks counts an intersection; a node's set once.
        _, first, which = np.unique(node, return_index=True, return_inverse=True)
        whole = _slices(table["items"])
        parts = [whole[i] for i in first]
        numbers, at = np.unique(np.concatenate(parts), return_inverse=True)
        items = np.split(at, np.cumsum([len(p) for p in parts])[:-1])
        mark, root, links = np.zeros(len(numbers), bool), list(range(len(first))), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for row, rest in _candidates(table, matches, similarity):
            a = which[row]
            others = [b for b in which[rest].tolist() if top(b) != top(a)]
            if not others:
                continue
            mark[items[a]] = True
            sizes = np.array([len(items[b]) for b in others])
            both = np.add.reduceat(mark[np.concatenate([items[b] for b in others])].astype(np.int64), np.cumsum(sizes) - sizes)
            mark[items[a]] = False
            similar = 100 * both >= similarity * (len(items[a]) + sizes - both)
            for b in np.array(others)[similar].tolist():
                if top(a) != top(b):
                    links.append((node[first[a]], node[first[b]]))
                    root[top(a)] = top(b)
        columns = list(zip(*links)) or [[], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return solve


def _slices(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    begins, values = whole.offsets.to_numpy(), whole.values.to_numpy(zero_copy_only=False)
    return [values[b:e] for b, e in zip(begins[:-1], begins[1:])]


def job_links(members: DataFrame, sets: DataFrame, matches: int, similarity: int, folder: str, job_items: int = JOB_ITEMS) -> DataFrame:
    """Links (a, b) between the members of open lists, from jobs."""
    rows = _jobs(members, job_items)
    kept = rows.groupBy("job").applyInArrow(_hopefuls(matches, similarity), rows.schema)
    kept = save(kept, folder, "job-members")
    return kept.join(sets, "node").groupBy("job").applyInArrow(_links(matches, similarity), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY,
    coordinates: int = COORDINATES, matches: int = MATCHES,
) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept), one row for each row of docs. Each component
    has one row that is kept, rows without shingles one for each doc_id and text."""
    folder = scratch(docs.sparkSession)
    base = signatures(docs, words, coordinates)
    alone = F.col("n_shingles") == 0  # in a class of its own
    for column, seed in (("set_sum", 0), ("set_xor", 1)):
        base = base.withColumn(column, F.when(alone, F.xxhash64(F.lit(seed), "doc_id", "digest")).otherwise(F.col(column)))
    # Written, so that a row and a node have one number from here on.
    base = save(base.withColumn("row", F.monotonically_increasing_id()), folder, "signatures")
    # A class's members have one signature; the smallest row's goes along.
    head = F.min(F.struct("doc_id", "digest", "row", "signature")).alias("head")
    classes = base.where("doc_id is not null").groupBy(_SET).agg(head).withColumn("node", F.monotonically_increasing_id())
    classes = save(classes.select(*_SET, "head.*", "node"), folder, "classes")
    lists = save(
        postings(classes.where("n_shingles > 0").select("node", "signature"), coordinates, coordinates - matches + 1), folder, "postings"
    )
    active = classes.join(lists.select("node").distinct(), "node", "left_semi")
    active = save(active.select("node", "doc_id", "digest", "n_shingles", "signature"), folder, "active")
    key = F.xxhash64("doc_id", "digest")
    filter_ = BitFilter(active, key)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), "text")
    few = shingles(own, words, ["doc_id", "digest"], key, filter_)
    sets = few.join(active.select("doc_id", "digest", "node"), ["doc_id", "digest"]).select("node", "items")
    sets = save(sets.dropDuplicates(["node"]), folder, "sets")
    nodes = save(hopeful(active.drop("doc_id", "digest"), sets, similarity), folder, "nodes")
    lists = lists.join(nodes.select("node", "n_shingles", "shared"), "node")
    labels = _linked(save(lists, folder, "lists"), nodes, sets, matches, similarity, folder)

    heads = classes.select(*_SET, "node", F.struct("doc_id", "digest", "row").alias("head"))
    # The node numbers are arbitrary; a component's head is its smallest document.
    firsts = labels.join(heads, "node").groupBy("component").agg(F.min("head").alias("first"))
    known = base.drop("signature").join(heads, _SET, "left")
    known = known.join(labels.join(firsts, "component").select("node", "first"), "node", "left")
    known = known.withColumn("head", F.coalesce("first", "head"))
    named = F.col("doc_id").isNotNull()
    return known.select(
        "doc_id", "digest", "n_shingles", F.when(named, F.col("head.doc_id")).alias("component_id"),
        F.when(named, F.col("row") == F.col("head.row")).otherwise(F.lit(True)).alias("kept"),
    )


def _linked(lists: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, similarity: int, folder: str) -> DataFrame:
    """(node, component) of the linked nodes of the lists (list, node, weight, n_shingles, shared)."""
    sized = lists.groupBy("list").agg(F.count("*").alias("size"))
    lists = save(lists.drop("length").join(sized.where("size > 1"), "list"), folder, "sized")
    other = lists.where(F.col("size") <= SHORT).select(
        "list", F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("shared").alias("s")
    )
    pairs = lists.withColumnRenamed("node", "b").join(other, "list").where(
        (F.col("a") < F.col("b")) & reaches(similarity, F.col("n"), F.col("s"), F.col("n_shingles"), F.col("shared"))
    ).select("a", "b")
    long = lists.where(F.col("size") > SHORT)
    hub = F.max(F.struct("weight", "node", "n_shingles", "shared")).alias("hub")
    hubs = long.groupBy("list").agg(hub)
    stars = long.join(hubs, "list").where(
        (F.col("node") != F.col("hub.node"))
        & reaches(similarity, F.col("n_shingles"), F.col("shared"), F.col("hub.n_shingles"), F.col("hub.shared"))
    ).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    tested = save(pairs.union(stars).distinct(), folder, "pairs")
    links = save(confirmed(tested, nodes, sets, matches, similarity, folder), folder, "links")
    labels = components(links, folder, "labels-0")

    placed = long.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("list").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    open_ = placed.join(several.where("least < most").select("list"), "list", "left_semi")
    own = open_.groupBy("node").agg(F.collect_list("list").alias("own"))
    members = open_.select("list", "node", "component").join(own, "node").join(nodes, "node")
    members = save(members, folder, "members")
    more = save(job_links(members, sets, matches, similarity, folder), folder, "job-links")
    return components(links.unionByName(more), folder, "labels-1")
