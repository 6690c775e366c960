"""Word triples of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9)
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_LONG_WORD = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ h >> np.uint64(30)) * _MIX
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of a-z and 0-9 of the lower-cased text) and, for each text, where its words begin.

    Text i has the words ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
    data = np.frombuffer(joined.encode() + b"\0", np.uint8)
    edge = np.flatnonzero(np.diff(_IS_WORD[data], prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    bounds = np.append(0, np.searchsorted(starts, np.flatnonzero(data == 0)))
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    values = np.zeros(len(order), np.uint64)
    for j in range(min(int(size[0]), _LONG_WORD) if len(size) else 0):
        more = int(np.searchsorted(-size, -j, side="left"))  # words longer than j come first
        values[:more] = values[:more] * _BASE + data[at[:more] + j] + np.uint64(1)
    for i in range(int(np.searchsorted(-size, -_LONG_WORD, side="left"))):
        values[i] = np.frombuffer(hashlib.blake2b(data[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    hashes = np.empty_like(values)
    hashes[order] = mixed(values)
    return hashes, bounds


def shingle_sets(texts: list[str | None], words: int = 3, least_words: int = 30) -> list[np.ndarray | None]:
    """The sorted distinct hashes of all runs of ``words`` words of each text; None for a text under ``least_words`` words."""
    hashes, bounds = word_hashes(texts)
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        runs += hashes[j : j + len(runs)] * _WEIGHTS[j]
    runs = mixed(runs)
    out: list[np.ndarray | None] = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a < max(least_words, words):
            out.append(None)
            continue
        own = np.sort(runs[a : b - words + 1])
        out.append(own[np.append(True, own[1:] != own[:-1])])
    return out
