"""The prefix trie of conversations, from padded matrices of turn ids.

A conversation is the sequence of its turns' ids (128-bit hashes of role and text). Conversations are
dealt out by ranges of their sequences and sorted, so that the members of every trie node are
neighbours. A task reads its range in slabs of at most ``CELLS`` padded cells. A slab's ids stand in
a matrix, are lexsorted, and the masks of columns that change from one row to the next are
OR-accumulated: the first change of a row marks where it begins new nodes, at that depth and all
below. Sums over the members of each depth's nodes are reduceat calls.

All sums are over rows, also those over a subtree: a row counts a child, a distinct turn or a leaf
only where its neighbours show that it is the first, or the last, to have it. So parts of a node
that lies in several slabs or ranges just add up. Nodes that end inside a slab are whole; those of
its first and last row are added by their key, the hash of their path. A range doesn't know the last
row of the range before it; what its first row counted once more is taken off by a correction for
each pair of neighbouring ranges.

Ids of the conversations that end at a node are hashed in ascending order as they come; where a node
lies in several slabs, its runs of ids are streamed in order through one task, as the digest of a
sequence asks for, without being held there.

Defined results: rows without conv_id take no part. Turns are in the order of turn (null first), equal
turns in that of the hash of role and text; repeated rows are turns of their own. A null role or
text is empty. An empty table has no nodes. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm.common import arrow_step, part_count, save, scratch

CELLS, ROWS = 1 << 19, 1 << 15  # of a slab
ID = 16  # bytes of a turn's id
_SUMS = ["n_convs", "n_children", "n_leaves", "spent", "needed"]
_PART = (
    "kind string, conv_id long, depth long, parent_conv_id long, path binary, parent_path binary, "
    "n_convs long, n_children long, n_leaves long, spent long, needed long, ends_sha256 string, "
    "at long, ends array<long>, edge binary, sizes array<long>"
)
_COLUMNS = [f.split()[0] for f in _PART.split(", ")]
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, id as hex, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn"),
        # The length keeps role and text apart.
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(sequences: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Each conversation begins with the first ``head`` turns (at most ``most``) of conversation
    ``base`` and goes on with its own turns after its first ``head``. Both are columns of conv_id."""
    own = sequences.select("conv_id", "turns", base.alias("base"), head.cast("int").alias("head"))
    heads = sequences.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("lead"))
    lead = F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), F.col("head"))
    rest = F.slice("turns", F.col("head") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(lead, rest).alias("turns"))


def keyed(sequences: DataFrame) -> DataFrame:
    """(path, conv_id, sizes): the ids of all turns in one binary key, which sorts as the sequence does."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    return sequences.select(path.alias("path"), "conv_id", F.transform("turns", lambda t: t["size"]).alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share from the first on."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint64), np.frombuffer(b[:n], np.uint64)
    differs = np.flatnonzero(x != y)
    return int(differs[0]) // 2 if len(differs) else n // ID


def path_hashes(path: bytes) -> list[bytes]:
    """The key of the node at each depth of a path, the root's first."""
    state, out = hashlib.md5(), [b""]
    for at in range(0, len(path), ID):
        state.update(path[at : at + ID])
        out.append(state.digest())
    return out


def suffix_sums(sizes: np.ndarray) -> np.ndarray:
    """[.., d]: the sum of the sizes at turns d, d + 1, … (counted from 0), and 0 after the last."""
    out = np.zeros((*sizes.shape[:-1], sizes.shape[-1] + 1), np.int64)
    out[..., :-1] = np.cumsum(sizes[..., ::-1], axis=-1)[..., ::-1]
    return out


class Slab:
    """Rows that are neighbours in the order, as padded matrices."""

    def __init__(self, paths: list[bytes], conv_ids: list[int], sizes: list[list[int]], before: int, after: int):
        """before, after: how many turns the first row shares with the row before it, and the last
        with the row after it; 0 and -1 where there is none."""
        lengths = np.array([len(p) // ID for p in paths])
        width = int(lengths.max())
        ids = np.zeros((len(paths), width, 2), ">u8")
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
        conv_ids = np.array(conv_ids, np.int64)
        # The last key counts most; missing turns come first, as in the order of the paths.
        keys = [conv_ids]
        for d in reversed(range(width)):
            keys += [ids[:, d, 1], ids[:, d, 0], inside[:, d]]
        order = np.lexsort(keys)
        self.paths = [paths[i] for i in order]
        self.conv_ids, self.lengths, ids, inside = conv_ids[order], lengths[order], ids[order], inside[order]
        matrix = np.zeros((len(paths), width), np.int64)
        matrix[lengths_mask(lengths, width)] = np.fromiter((s for row in sizes for s in row), np.int64, int(lengths.sum()))
        self.left = suffix_sums(matrix[order])
        changed = np.ones((len(paths), width), bool)
        changed[1:] = (ids[1:] != ids[:-1]).any(axis=2) | (inside[1:] != inside[:-1])
        np.logical_or.accumulate(changed, axis=1, out=changed)
        self.shared = (~changed).sum(axis=1)  # with the row before
        # Equal rows also share the padding.
        self.shared[1:] = np.minimum(self.shared[1:], np.minimum(self.lengths[1:], self.lengths[:-1]))
        self.shared[0] = before
        following = np.append(self.shared[1:], after)
        self.is_leaf = following < self.lengths
        self.width, self.before, self.after = width, before, after

    def nodes(self, depth: int):
        """(rows of this depth or deeper, where among them each node starts)."""
        rows = np.flatnonzero(self.lengths >= depth)
        starts = np.flatnonzero((self.shared[rows] < depth) | (rows == rows[0])) if len(rows) else rows
        return rows, starts

    def sums(self, depth: int, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        deeper, shared = self.lengths[rows] > depth, self.shared[rows]
        turn = max(depth - 1, 0)  # the node's own turn, counted from 0
        new = np.minimum(np.maximum(turn, shared), self.width)
        return {
            "conv_id": np.minimum.reduceat(self.conv_ids[rows], starts),
            "n_convs": np.diff(np.append(starts, len(rows))),
            "n_children": np.add.reduceat((deeper & (shared <= depth)).astype(np.int64), starts),
            "n_leaves": np.add.reduceat(self.is_leaf[rows].astype(np.int64), starts),
            "spent": np.add.reduceat(self.left[rows, turn], starts),
            "needed": np.add.reduceat(self.left[rows, new], starts),
        }

    def parts(self, part: int, slab: int, open_before: int, open_after: int) -> Iterator[dict]:
        """Columns of rows for each depth. Nodes of the first row down to depth open_before and of
        the last row down to open_after go on outside this slab."""
        first, last = path_hashes(self.paths[0]), path_hashes(self.paths[-1])
        at = (part << 32) + slab
        parent = None  # conv_id of the parent's first member for each row; -1: not known here
        for depth in range(self.width + 1):
            rows, starts = self.nodes(depth)
            if not len(rows):
                break
            found = self.sums(depth, rows, starts)
            count = len(starts)
            edge = np.zeros(count, bool)
            names: dict[int, bytes] = {}
            if depth == 0 or (rows[0] == 0 and depth <= open_before):
                edge[0], names[0] = True, first[depth]
            if rows[-1] == len(self.paths) - 1 and depth <= open_after:
                edge[-1], names[count - 1] = True, last[depth]
            up = [None] * count if depth == 0 else [None if known else int(c) for known, c in zip(parent[1][rows[starts]], parent[0][rows[starts]])]
            # A parent that goes on outside is looked up by its path.
            up_path = [None] * count
            if depth:
                for i in np.flatnonzero(parent[1][rows[starts]]):
                    row = rows[starts[i]]
                    up_path[i] = parent[2][row]
            here = np.zeros(len(self.paths), np.int64), np.zeros(len(self.paths), bool), {}
            sizes = np.diff(np.append(starts, len(rows)))
            here[0][rows], here[1][rows] = np.repeat(found["conv_id"], sizes), np.repeat(edge, sizes)
            for i, name in names.items():
                here[2].update(dict.fromkeys(rows[starts[i] : starts[i] + sizes[i]].tolist(), name))
            parent = here
            # Members that end here come first.
            n_ends = np.add.reduceat((self.lengths[rows] == depth).astype(np.int64), starts)
            ends, digest = [None] * count, [NOTHING] * count
            for i in np.flatnonzero(n_ends):
                of = rows[starts[i] : starts[i] + n_ends[i]]
                if edge[i]:
                    ends[i] = self.conv_ids[of].tolist()
                else:
                    digest[i] = hashlib.sha256(",".join(map(str, self.conv_ids[of].tolist())).encode()).hexdigest()
            yield {
                "kind": ["part" if e else "node" for e in edge], "depth": [depth] * count,
                **{k: v.tolist() for k, v in found.items()}, "parent_conv_id": up, "parent_path": up_path,
                "path": [names.get(i) for i in range(count)], "ends_sha256": digest, "at": [at] * count, "ends": ends,
            }


def lengths_mask(lengths: np.ndarray, width: int) -> np.ndarray:
    return np.arange(width) < lengths[:, None]


def _filled(columns: dict) -> dict:
    n = len(columns["kind"])
    return {c: columns.get(c, [None] * n) for c in _COLUMNS}


def slabs(rows: Iterator[tuple[bytes, int, list[int]]]) -> Iterator[tuple[list, list, list]]:
    """Rows cut where the padded matrix would be too large; a row that is too long stands alone."""
    held, width = ([], [], []), 0
    for path, conv_id, sizes in rows:
        wider = max(width, len(sizes), 1)
        if held[0] and (wider * (len(held[0]) + 1) > CELLS or len(held[0]) >= ROWS):
            yield held
            held, wider = ([], [], []), max(len(sizes), 1)
        for column, value in zip(held, (path, conv_id, sizes)):
            column.append(value)
        width = wider
    if held[0]:
        yield held


def _range_parts(batches):
    """All of one range: its nodes, the parts of nodes that may go on, and its first and last row."""
    part = TaskContext.get().partitionId()

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

    def parts(held, number, before, after, first_of_range, last_of_range):
        open_before = len(held[0][0]) if first_of_range else before
        open_after = len(held[0][-1]) if last_of_range else after
        slab = Slab(*held, before, after)
        for columns in slab.parts(part, number, open_before, open_after):
            yield _filled(columns)

    def edge(kind, held, i):
        return _filled({"kind": [kind], "at": [part], "edge": [held[0][i]], "sizes": [held[2][i]]})

    held, number, before = None, 0, 0
    for following in slabs(rows()):
        if held is None:
            yield edge("first", following, 0)
        else:
            after = shared_turns(held[0][-1], following[0][0])
            yield from parts(held, number, before, after, number == 0, False)
            number, before = number + 1, after
        held = following
    if held is not None:
        yield from parts(held, number, before, -1, number == 0, True)
        yield edge("last", held, -1)


def _corrections(edges: DataFrame) -> DataFrame:
    """What a range's first row counted as new and its neighbour's last row had; and whether that
    last row was a leaf after all."""
    # One row for each range, none of them more than a conversation's path.
    by = Window.orderBy("at")
    firsts = edges.where("kind = 'first'").select("at", F.col("edge").alias("path"), "sizes")
    lasts = edges.where("kind = 'last'").select("at", F.col("edge").alias("end"))
    pairs = firsts.join(lasts, "at").withColumn("end", F.lag("end").over(by)).where("end is not null")

    def step(batches):
        for batch in batches:
            out = {c: [] for c in ("depth", "path", *_SUMS)}
            for path, sizes, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shared = shared_turns(path, end)
                counted_leaf = len(end) // ID <= shared  # the last row goes on, or stands again, in this range
                left = suffix_sums(np.array(sizes[:shared], np.int64))
                names = path_hashes(path[: shared * ID])
                for depth in range(shared + 1):
                    row = (0, -1 if depth < shared else 0, -1 if counted_leaf else 0, 0, -int(left[max(depth - 1, 0)]))
                    for c, v in zip(out, (depth, names[depth], *row)):
                        out[c].append(v)
            yield out

    rows = pairs.select("path", "sizes", "end")
    return arrow_step(rows, step, "depth long, path binary, " + ", ".join(f"{c} long" for c in _SUMS))


def _ends_hashes(parts: DataFrame) -> DataFrame:
    """(depth, path, digest) of the ids that end at nodes of several slabs, streamed in their order."""
    rows = parts.where("ends is not null").select("depth", "path", "at", "ends")
    rows = rows.repartition(part_count(parts.sparkSession), "depth", "path").sortWithinPartitions("depth", "path", "at")

    def step(batches):
        key, state = None, None
        for batch in batches:
            out = {"depth": [], "path": [], "digest": []}
            for depth, path, ends in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                text = ",".join(map(str, ends)).encode()
                if (depth, path) == key:
                    state.update(b"," + text)
                    continue
                if key is not None:
                    for c, v in zip(out.values(), (*key, state.hexdigest())):
                        c.append(v)
                key, state = (depth, path), hashlib.sha256(text)
            yield out
        if key is not None:
            yield {"depth": [key[0]], "path": [key[1]], "digest": [state.hexdigest()]}

    return arrow_step(rows, step, "depth long, path binary, digest string")


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv_id, turns): conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark, folder = sequences.sparkSession, scratch(sequences.sparkSession)
    rows = save(keyed(sequences), folder, "keyed")
    dealt = rows.repartitionByRange(part_count(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = save(arrow_step(dealt, _range_parts, _PART), folder, "parts")

    parts = found.where("kind = 'part'")
    summed = parts.select("depth", "path", "conv_id", "parent_path", *_SUMS).unionByName(
        _corrections(found.where("kind in ('first', 'last')")), allowMissingColumns=True
    )
    summed = summed.groupBy("depth", "path").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_path").alias("parent_path"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    summed = save(summed.join(_ends_hashes(parts), ["depth", "path"], "left"), folder, "summed")
    known = ["depth", "conv_id", "parent_conv_id", "parent_path", *_SUMS, "ends_sha256"]
    open_nodes = summed.select(
        "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "parent_path", *_SUMS,
        F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"),
    )
    nodes = found.where("kind = 'node'").select(*known).unionByName(open_nodes)
    # Only children of nodes that lie in several slabs look their parent up.
    parents = summed.select((F.col("depth") + 1).alias("d"), F.col("path").alias("p"), F.col("conv_id").alias("first"))
    asking = nodes.where("parent_path is not null").join(
        parents, (F.col("depth") == F.col("d")) & (F.col("parent_path") == F.col("p"))
    ).withColumn("parent_conv_id", F.col("first"))
    nodes = nodes.where("parent_path is null").select(*known).unionByName(asking.select(*known))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("spent") - F.col("needed")).alias("saved_tokens"), "ends_sha256",
    )
