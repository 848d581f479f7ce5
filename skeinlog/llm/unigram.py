"""SentencePiece encoding by unigram Viterbi, and decoding.

The pieces of a public model stand in a double-array trie of their UTF-8 bytes. A text begins with a
space and has the white-space marker in place of every space; the best path over the pieces that
match at each place is the encoding. A character that no single piece covers costs ``UNKNOWN`` less than the worst piece
and becomes its byte pieces, so that every text can be encoded, and decoding gives back exactly the
text: bytes are joined, markers become spaces, the first space goes.

In the trie, the marker is the byte 0xFF, which UTF-8 doesn't use: a marker character that is in the
text itself is encoded in bytes and so stays what it was. Where no piece has a marker after another
character, no piece crosses from one word to the next, and the best path of a text is that of its
words. The words of a block that a task does not know yet go through the trie together, one array
step for each place and depth; longer words than ``LANE_BYTES`` go alone, byte by byte. A task remembers
words until it holds ``REMEMBERED`` of them, and then begins anew.

A model made by merges has ranks for scores; the log score of rank r is then -ln((r + 1) * sum(1/i)),
as in Zipf's law. Models with log scores are used as they are.

Defined results: null and empty texts have no pieces and decode to an empty text. Columns named like a
result are replaced. Among equally good paths the one found first from the left stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinlog.llm.common import arrow_step

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN, REMEMBERED = 10.0, 250_000
LANE_BYTES = 64  # bytes of the longest word that advances with others
_LANES, _WORDS_AT_ONCE, _PART_BYTES = 4096, 1 << 16, 1 << 20
MARKER = "▁"  # fixed value: the white-space marker
_SPACE = b"\xff"
_WORDS = re.compile(rb"\xff+[^\xff]*")
_EDGE = re.compile(rb"[^\xff](?=\xff)")


def read_model(path: str = MODEL, ranks: bool = True) -> tuple[dict[bytes, tuple[int, float]], list[int]]:
    """(piece -> id and log score, ids of the 256 byte pieces). ranks: scores are merge ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, bytes_ = {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            bytes_[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal[model.id_to_piece(i).replace(MARKER, "\0").encode().replace(b"\0", _SPACE)] = (i, model.get_score(i))
    if ranks:
        harmonic = sum(1 / (i + 1) for i in range(len(normal)))
        normal = {p: (i, -math.log((1 - score) * harmonic)) for p, (i, score) in normal.items()}
    return normal, bytes_


class DoubleArray:
    """base/check: node s goes by byte b to t = base[s] + b where check[t] is s. piece[t]: the id
    that ends there or -1."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for text, (i, _) in sorted(pieces.items()):
            node = 0
            for byte in text:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = i
        size = 2 * len(children) + 1024
        self.base, self.check, self.piece = [0] * size, [-1] * size, [-1] * size
        self.check[0] = -2  # the root's own place
        place = {0: 0}
        lowest, highest = 257, 257  # first free place; where nodes of several children begin to look
        queue = [0]
        for node in queue:
            out = sorted(children[node])
            if not out:
                continue
            while lowest < len(self.check) and self.check[lowest] != -1:
                lowest += 1
            # Single children fill the holes that wider nodes leave.
            base = lowest - out[0] if len(out) == 1 else highest
            while True:
                if base + 256 >= len(self.check):
                    for column, empty in ((self.base, 0), (self.check, -1), (self.piece, -1)):
                        column.extend([empty] * size)
                if all(self.check[base + byte] == -1 for byte in out):
                    break
                base += 1
            self.base[place[node]] = base
            if len(out) > 1:
                highest = max(highest, base - 64)
            for byte in out:
                child = children[node][byte]
                place[child] = base + byte
                self.check[base + byte] = place[node]
                self.piece[base + byte] = ends[child]
                queue.append(child)


# Bytes of the character that a byte begins; the marker is one byte.
_WIDTH = np.array([1 if b < 0xC0 or b == 0xFF else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])


class Unigram:
    def __init__(self, pieces: dict[bytes, tuple[int, float]], bytes_: list[int]):
        self.trie, self.bytes = DoubleArray(pieces), bytes_
        self.scores = {i: score for i, score in pieces.values()}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self.by_words = not any(re.search(rb"[^\xff]\xff", p) for p in pieces)
        self.text = {i: p for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(bytes_)}

    def best_path(self, data: bytes) -> list[int]:
        base, check, piece, scores = self.trie.base, self.trie.check, self.trie.piece, self.scores
        n = len(data)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        begin, chosen = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            one = i + int(_WIDTH[data[i]])
            covered = False
            node, j = 0, i
            while j < n:
                to = base[node] + data[j]
                if check[to] != node:
                    break
                node = to
                j += 1
                found = piece[node]
                if found >= 0:
                    covered = covered or j == one
                    score = here + scores[found]
                    if score > best[j]:
                        best[j], begin[j], chosen[j] = score, i, found
            if not covered and here + self.unknown > best[one]:
                best[one], begin[one], chosen[one] = here + self.unknown, i, -1
        parts = []
        at = n
        while at > 0:
            start = begin[at]
            if chosen[at] >= 0:
                parts.append([chosen[at]])
            else:
                parts.append([self.bytes[b] for b in data[start:at].replace(_SPACE, b" ")])
            at = start
        return [i for part in reversed(parts) for i in part]


class Encoder:
    """A model's tables as arrays, and the words that a task remembers, by number."""

    def __init__(self, model: Unigram):
        self.model = model
        trie = model.trie
        self.base, self.check, self.piece = (np.array(c, np.int32) for c in (trie.base, trie.check, trie.piece))
        self.scores = np.zeros(max(model.scores, default=0) + 1)
        self.scores[list(model.scores)] = list(model.scores.values())
        self.bytes = np.array(model.bytes, np.int32)
        self.bytes[0xFF] = self.bytes[0x20]  # a marker that no piece covers is a space
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def best_paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, pieces of each word) of words, which advance through the trie together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        n, width = len(words), int(lengths[0]) if len(words) else 0
        data = np.zeros((n, width), np.uint8)
        data[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        begin, chosen = np.zeros((n, width + 1), np.int16), np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero(best[: np.searchsorted(-lengths, -i, side="left"), i] > -np.inf)
            here, one = best[rows, i], i + _WIDTH[data[rows, i]]
            covered = np.zeros(len(rows), bool)
            at, node, j = np.arange(len(rows)), np.zeros(len(rows), np.int32), i
            while len(at):
                inside = lengths[rows[at]] > j
                at, node = at[inside], node[inside]
                if not len(at):
                    break
                to = self.base[node] + data[rows[at], j]
                ok = self.check[to] == node
                at, node, j = at[ok], to[ok], j + 1
                found = self.piece[node]
                hit = found >= 0
                found, by = found[hit], at[hit]
                covered[by[one[by] == j]] = True
                score = here[by] + self.scores[found]
                better = score > best[rows[by], j]
                r = rows[by[better]]
                best[r, j], begin[r, j], chosen[r, j] = score[better], i, found[better]
            left = np.flatnonzero(~covered)
            r, to = rows[left], one[left]
            better = here[left] + self.model.unknown > best[r, to]
            r, to = r[better], to[better]
            best[r, to], begin[r, to], chosen[r, to] = best[r, i] + self.model.unknown, i, -1
        return self._followed(order, data, lengths, begin, chosen)

    def _followed(self, order, data, lengths, begin, chosen) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the best paths, from the ends back to the starts, in the words' own order."""
        rows, ends = np.arange(len(lengths)), lengths
        steps = []
        while len(rows):
            starts = begin[rows, ends].astype(np.int64)
            steps.append((rows, starts, ends, chosen[rows, ends]))
            more = starts > 0
            rows, ends = rows[more], starts[more]
        if not steps:
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
        rows, starts, ends, ids = (np.concatenate(c) for c in zip(*steps))
        by = np.lexsort((ends, order[rows]))
        rows, starts, ends, ids = rows[by], starts[by], ends[by], ids[by]
        # An unknown character becomes its bytes.
        counts = np.where(ids >= 0, 1, ends - starts)
        flat = np.repeat(ids, counts)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        unknown = flat < 0
        flat[unknown] = self.bytes[data[np.repeat(rows, counts)[unknown], (np.repeat(starts, counts) + place)[unknown]]]
        return flat, np.bincount(order[rows], weights=counts, minlength=len(lengths)).astype(np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        short = [w for w in fresh if len(w) <= LANE_BYTES]
        found = [self.best_paths(short[b : b + _LANES]) for b in range(0, len(short), _LANES)]
        long = [w for w in fresh if len(w) > LANE_BYTES]
        for path in map(self.model.best_path, long):
            found.append((np.array(path, np.int32), np.array([len(path)], np.int64)))
        self.known.update(zip(short + long, range(len(self.known), len(self.known) + len(fresh))))
        self.ids, self.counts = ([np.concatenate([old[0], *new])] for old, new in zip((self.ids, self.counts), zip(*found)))

    def block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, pieces of each word)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        which = list(map(self.known.get, words))
        if None in which:
            self._learn(list(dict.fromkeys(w for w, k in zip(words, which) if k is None)))
            which = list(map(self.known.get, words))
        which = np.array(which, np.int64)
        counts = self.counts[0][which]
        starts = (np.cumsum(self.counts[0]) - self.counts[0])[which]
        at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return self.ids[0][at], counts

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The pieces of each text, as lists."""
        if not self.model.by_words:
            paths = [self.model.best_path(_marked(t)) if t else [] for t in texts]
            return pa.array(paths, pa.list_(pa.int32()))
        flat, sizes = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        words, owners, lengths = [], [], []

        def flush() -> None:
            ids, counts = self.block(words)
            flat.append(ids)
            owner = np.repeat(np.array(owners, np.int64), lengths)
            sizes[:] += np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
            for held in (words, owners, lengths):
                held.clear()

        for i, text in enumerate(texts):
            for part in _parts(_marked(text)) if text else ():
                found = _WORDS.findall(part)
                words += found
                owners.append(i)
                lengths.append(len(found))
                if len(words) >= _WORDS_AT_ONCE:
                    flush()
        flush()
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))


def _parts(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a word does."""
    begin = 0
    while begin < len(data):
        edge = _EDGE.search(data, begin + _PART_BYTES)
        end = edge.end() if edge else len(data)
        yield data[begin:end]
        begin = end


def _marked(text: str) -> bytes:
    return _SPACE + text.encode("utf-8").replace(b" ", _SPACE)


class Decoder:
    """The bytes of all pieces in one array."""

    def __init__(self, model: Unigram):
        size = max(model.text, default=-1) + 1
        parts = [model.text.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(p) for p in parts] + [0], np.int64)  # the last for ids without a text
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(parts).replace(_SPACE, b" "), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        out = []
        for b in range(0, len(ids), _WORDS_AT_ONCE):
            part = ids[b : b + _WORDS_AT_ONCE].astype(np.int64)
            part[(part < 0) | (part >= len(self.lengths))] = -1
            lengths = self.lengths[part]
            begin = self.starts[part] - (np.cumsum(lengths) - lengths)
            out.append(self.data[np.arange(lengths.sum()) + np.repeat(begin, lengths)].tobytes())
        return b"".join(out)

    def decode(self, column: pa.Array) -> list[str | None]:
        """The text of each list of pieces. Ids without a text, such as control pieces, give nothing."""
        ids = column.values.to_numpy(zero_copy_only=False)
        found = []
        for begin, end, known in zip(column.offsets[:-1].to_pylist(), column.offsets[1:].to_pylist(), column.is_valid().to_pylist()):
            data = self.joined(ids[begin:end]) if known else b""
            found.append((data[1:] if data[:1] == b" " else data).decode("utf-8", "replace") if known else None)
        return found


def encode(docs: DataFrame, model: Unigram) -> DataFrame:
    """docs with ids, the text's pieces."""
    docs = docs.drop("ids")
    names = docs.columns
    schema = T.StructType(docs.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # as large as the vocabulary

    def step(batches):
        encoder = Encoder(_restored(shared.value))
        for batch in batches:
            ids = encoder.encode(batch.column(names.index("text")).to_pylist())
            yield {**{n: batch.column(i) for i, n in enumerate(names)}, "ids": ids}

    return arrow_step(docs, step, schema)


def decode(encoded: DataFrame, model: Unigram, column: str = "ids") -> DataFrame:
    """The rows with decoded, the text of their pieces."""
    encoded = encoded.drop("decoded")
    names = encoded.columns
    schema = T.StructType(encoded.schema.fields + [T.StructField("decoded", T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(vars(model))

    def step(batches):
        decoder = Decoder(_restored(shared.value))
        for batch in batches:
            texts = decoder.decode(batch.column(names.index(column)))
            yield {**{n: batch.column(i) for i, n in enumerate(names)}, "decoded": texts}

    return arrow_step(encoded, step, schema)


def round_trip(docs: DataFrame, model: Unigram) -> DataFrame:
    """docs with ids and decoded, in one step: a task holds the model once."""
    docs = docs.drop("ids", "decoded")
    names = docs.columns
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def step(batches):
        own = _restored(shared.value)
        encoder, decoder = Encoder(own), Decoder(own)
        for batch in batches:
            ids = encoder.encode(batch.column(names.index("text")).to_pylist())
            yield {**{n: batch.column(i) for i, n in enumerate(names)}, "ids": ids, "decoded": decoder.decode(ids)}

    return arrow_step(docs, step, T.StructType(docs.schema.fields + added))


def _restored(parts: dict) -> Unigram:
    model = Unigram.__new__(Unigram)
    model.__dict__.update(parts)
    return model
