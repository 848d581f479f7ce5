"""Vectorised 64-bit hashes of words and word runs."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finisher)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


_BYTE = spread(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x5851F42D4C957F2D
_BLOCK = 1 << 22  # bytes hashed at once


def _powers(n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate((out, out * _U(pow(_STEP, len(out), 1 << 64))))
    return out


def word_hashes(text: str, breaks: np.ndarray = _SPACE) -> np.ndarray:
    """A hash of each word, A-Z taken as a-z. breaks: whether a byte parts words; as it stands, the
    words are ``[^\\x20\\x09-\\x0D]+``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    found, begin = [], 0
    while begin < len(data):
        end = min(len(data), begin + _BLOCK)
        while end < len(data) and not breaks[data[end]]:  # a word is never cut
            end += 1
        found.append(_words(data[begin:end], breaks))
        begin = end
    return np.concatenate(found) if found else np.empty(0, _U)


def _words(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    inside = ~breaks[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    if not len(edges):
        return np.empty(0, _U)
    lengths = edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
    values = _BYTE[data[inside]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, offsets) + lengths.astype(_U))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; of fewer words, the one hash of
    the whole sequence; of none, nothing."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    run = min(width, len(words))
    total = np.full(len(words) - run + 1, run, _U)
    for i in range(run):
        total = total * _U(_STEP) + words[i : len(words) - run + 1 + i]
    return np.unique(mix(total))
