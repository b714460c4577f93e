"""Words of a text as numbers, and its windows of words that occur more than once."""

from __future__ import annotations

import re

import numpy as np

#: Words are runs without white space: no space and no \\t to \\r.
WORD = re.compile(r"[^ \t-\r]+")


def numbered(words: list[str]) -> np.ndarray:
    """Each word as the number of its first occurrence among the distinct words."""
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def repeated(ids: np.ndarray, width: int) -> np.ndarray:
    """Starts, ascending, of the windows of ``width`` words that the sequence holds twice or more.

    Windows are ranked by doubling: a window's rank comes from the ranks of two shorter ones
    that cover it, and only windows whose parts are repeated are looked at again. Exact, and
    memory in proportion to the sequence.
    """
    rank, span = ids, 0
    starts = np.arange(len(ids))
    while span < width and len(starts):
        wider = min(width, max(1, 2 * span))
        shift = wider - span
        if span:
            starts = starts[starts + wider <= len(ids)]
            starts = starts[rank[starts + shift] >= 0]
            key = rank[starts] * len(ids) + rank[starts + shift]
        else:
            key = ids
        order = np.argsort(key, kind="stable")
        listed = key[order]
        first = np.ones(len(listed), bool)
        first[1:] = listed[1:] != listed[:-1]
        group = np.cumsum(first) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else first
        rank = np.full(len(ids), -1, np.int64)
        rank[starts[order[many]]] = group[many]
        starts, span = np.flatnonzero(rank >= 0), wider
    return starts


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Mask of the words inside a window of ``width`` that begins at one of the distinct ``starts``."""
    edges = np.zeros(length + 1, np.int64)
    edges[starts] += 1
    edges[starts + width] -= 1
    return np.cumsum(edges[:-1]) > 0
