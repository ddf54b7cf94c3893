"""Suffix arrays by the difference-cover algorithm, in numpy."""

from __future__ import annotations

import numpy as np


def _ranks(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, from 0."""
    top = int(x.max()) + 1
    if top > 4 * len(x) + 1024:
        return np.unique(x, return_inverse=True)[1].astype(np.int64)
    there = np.zeros(top, np.int64)
    there[x] = 1
    return (np.cumsum(there) - 1)[x]


def _packed(a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """One number for each pair, in the order of pairs, and a bound; ``b`` lies under ``top``."""
    bound = int(a.max(initial=0)) + 1
    if bound * top >= 1 << 63:
        a = np.unique(a, return_inverse=True)[1].astype(np.int64)
        bound = len(a) + 1
    return a * np.int64(top) + b, bound * top


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (non-negative integers) in the order of their suffixes.

    Suffixes at positions 1 and 2 modulo 3 are the sample: their triples are sorted and named, and while names repeat
    the string of names is solved in the same way. The others are sorted by first letter and the rank of the sampled
    suffix after it, and merged in by counting the sampled suffixes before each. Triples and pairs are sorted as one number.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = np.concatenate([_ranks(s) + 1, np.zeros(3, np.int64)])
    letters = int(s.max()) + 1
    extra = n % 3 == 1  # a last, empty triple keeps the two halves of the names apart
    one, two = np.arange(1, n + extra, 3), np.arange(2, n + extra, 3)
    sample = np.concatenate([one, two])
    pair = _packed(s[:-1], s[1:], letters)[0]
    triple = _packed(pair[sample], s[sample + 2], letters)[0]
    order = np.argsort(triple)
    t = triple[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    if not new.all():
        names = np.empty(len(sample), np.int64)
        names[order] = np.cumsum(new)
        order = suffix_array(names)
    ranked = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(sample) + 1)
    if extra:
        ranked = ranked[ranked < n]
    top = n + 3
    zero = np.arange(0, n, 3)
    key = _packed(s[zero], rank[zero + 1], top)[0]
    order = np.argsort(key)
    zero, key = zero[order], key[order]
    kind = ranked % 3
    ones, twos = ranked[kind == 1], ranked[kind == 2]
    before = np.searchsorted(_packed(s[ones], rank[ones + 1], top)[0], key)
    both = np.concatenate([twos, zero])
    key = _packed(pair[both], rank[both + 2], top)[0]
    before = before + np.searchsorted(key[: len(twos)], key[len(twos) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = ranked
    return out


def equal_prefixes(raw: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For adjacent suffixes of ``sa`` whether their first ``length`` (8 or more) bytes are equal; all lie ``length`` bytes before the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    same = np.ones(max(0, len(sa) - 1), bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        w = np.ascontiguousarray(word[sa + offset]).view(np.uint64).ravel()
        same &= w[1:] == w[:-1]
    return same
