"""Token counts by greedy longest match, in linear time and without building the pieces.

A vocabulary of byte strings is a trie. A node that cannot be left by the next byte fails over to
another node after a known number of pieces, which are the greedy pieces of what the node has
read; both are computed once for every node. Counting a word is then a walk over its bytes that
adds the numbers of the failures it meets; the pieces themselves never exist.

A word is a run of characters other than ``[\\x20\\x09-\\x0D]``; it is read as one space and its
UTF-8 bytes, so that pieces with a leading space begin words. A word that the vocabulary cannot
spell counts as one unknown token. Batches of texts share their distinct words, and all words of
a batch advance together, one array step for each byte place.

Bounds: the automaton has one node for each prefix of a vocabulary entry, and is broadcast.

Defined results: null and empty texts and texts without words have 0 tokens. Columns named like a
result are replaced; repeated rows are counted each.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinlog.llm.common import arrow_step

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NONE = -1
LANE_BYTES = 256  # bytes of the longest word that walks with others; a longer one walks by itself


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file of lines: base64 of the piece, white space, rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """keys/targets: the trie's edges, sorted by node * 256 + byte. fail/popped: where a node fails
    to and the pieces counted there. rest: the pieces counted at a word's end, or none."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][byte]
            if node:
                whole[node] = True
        n = len(children)
        fail, popped, rest = [_NONE] * n, [0] * n, [_NONE] * n
        rest[0] = 0
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node].items():
                    below.append(child)
                    if whole[child]:
                        fail[child], popped[child] = 0, 1
                    else:
                        state, pieces = fail[node], popped[node]
                        while state != _NONE and byte not in children[state]:
                            pieces += popped[state]
                            state = fail[state]
                        if state != _NONE:
                            fail[child], popped[child] = children[state][byte], pieces
                    if fail[child] != _NONE and rest[fail[child]] != _NONE:
                        rest[child] = popped[child] + rest[fail[child]]
            level = below
        edges = sorted((node * 256 + byte, to) for node, out in enumerate(children) for byte, to in out.items())
        self.keys = np.array([k for k, _ in edges] + [n * 256], np.int64)
        self.targets = np.array([t for _, t in edges] + [_NONE], np.int64)
        self.fail, self.popped, self.rest = np.array(fail), np.array(popped), np.array(rest)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; -1 for a word that can't be spelled."""
        alone = [i for i, w in enumerate(words) if len(w) > LANE_BYTES]
        if alone:
            out = self._together([w if len(w) <= LANE_BYTES else b"" for w in words])
            tables = dict(zip(self.keys.tolist(), self.targets.tolist())), self.fail.tolist(), self.popped.tolist()
            out[alone] = [self._alone(words[i], *tables) for i in alone]
            return out
        return self._together(words)

    def _alone(self, word: bytes, edges: dict[int, int], fail: list[int], popped: list[int]) -> int:
        state = pieces = 0
        for byte in word:
            while (to := edges.get(state * 256 + byte)) is None:
                if fail[state] == _NONE:
                    return -1
                pieces += popped[state]
                state = fail[state]
            state = to
        left = int(self.rest[state])
        return -1 if left == _NONE else pieces + left

    def _together(self, words: list[bytes]) -> np.ndarray:
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lengths = np.array([len(words[i]) for i in order], np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.int64)
        state, pieces = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lost = np.zeros(len(words), bool)
        longest = int(lengths[0]) if len(words) else 0
        active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        for j in range(longest):
            walking = np.arange(active[j])
            walking = walking[~lost[walking]]
            while len(walking):
                key = state[walking] * 256 + data[starts[walking] + j]
                at = np.searchsorted(self.keys, key)
                found = self.keys[at] == key
                state[walking[found]] = self.targets[at[found]]
                walking = walking[~found]
                back = self.fail[state[walking]]
                lost[walking[back == _NONE]] = True
                walking, back = walking[back != _NONE], back[back != _NONE]
                pieces[walking] += self.popped[state[walking]]
                state[walking] = back
        left = self.rest[state]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(lost | (left == _NONE), -1, pieces + left)
        return out


def count_tokens(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """docs with n_words, n_tokens and n_unknown."""
    docs = docs.drop("n_words", "n_tokens", "n_unknown")
    names = docs.columns
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("n_words long, n_tokens long, n_unknown long").fields)
    shared = docs.sparkSession.sparkContext.broadcast(vars(Automaton(vocabulary)))

    def step(batches):
        automaton = Automaton.__new__(Automaton)
        automaton.__dict__.update(shared.value)
        for batch in batches:
            place: dict[str, int] = {}
            uses, sizes = [], []
            for text in batch.column(names.index("text")).to_pylist():
                words = _WORD.findall(text or "")
                uses.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)))
                sizes.append(len(words))
            found = automaton.counts([b" " + w.encode("utf-8") for w in place])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            each = found[np.concatenate(uses)] if uses else np.zeros(0, np.int64)
            yield {
                **{n: batch.column(i) for i, n in enumerate(names)},
                "n_words": np.array(sizes, np.int64),
                "n_tokens": np.bincount(owner, np.abs(each), len(sizes)).astype(np.int64),
                "n_unknown": np.bincount(owner, each < 0, len(sizes)).astype(np.int64),
            }

    return arrow_step(docs, step, schema)
