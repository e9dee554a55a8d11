"""Suffix arrays by induced sorting, and common prefixes in text order, for one shard.

The bytes of a shard have a small alphabet: suffixes are induced bucket by bucket with whole
arrays. The names of the leftmost-smaller substrings have a large alphabet and about a third of
the length: their suffixes are sorted by doubling, again with whole arrays.
"""

from __future__ import annotations

import numpy as np

from sparkrank.llm.tokens import spread


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Classify suffixes: True where a suffix is smaller than the one after it. The last symbol is the least."""
    n = len(s)
    out = np.zeros(n, dtype=bool)
    out[-1] = True
    change = np.flatnonzero(s[:-1] != s[1:])
    if len(change):
        rises = s[change] < s[change + 1]
        lengths = np.diff(np.concatenate(([-1], change)))
        out[: n - 1] = np.repeat(rises, lengths)
    return out


def _dealt(at: np.ndarray, before: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append the places before `at` to the queues of their symbols, in order; before: those symbols, or -1 for a place to leave out."""
    symbols = before[at]
    taken = symbols >= 0
    at, symbols = at[taken] - 1, symbols[taken]
    if not len(at):
        return
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    for c, i, j in zip(symbols[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        queues[c].append(at[i:j])


def _induce(s: np.ndarray, before_larger: np.ndarray, before_smaller: np.ndarray, seeds: np.ndarray, size: int, apart: int) -> np.ndarray:
    """The order of all suffixes that the order of the leftmost-smaller ones in `seeds` induces; those that begin with apart keep theirs.

    before_larger: for each position the symbol before it, if the suffix there is larger than
    the next, else -1; before_smaller the other way round.
    """
    larger_q: list[list[np.ndarray]] = [[] for _ in range(size)]
    seed_q: list[list[np.ndarray]] = [[] for _ in range(size)]
    smaller_q: list[list[np.ndarray]] = [[] for _ in range(size)]
    _dealt(seeds + 1, np.concatenate(([-1], s)).astype(s.dtype), seed_q)
    nothing = np.zeros(0, dtype=seeds.dtype)

    def emptied(queues: list[list[np.ndarray]], c: int, before: np.ndarray) -> np.ndarray:
        """All that comes to a bucket: what the others put there goes on at once, then what that puts into the bucket itself, and so on."""
        done = []
        while queues[c]:
            done.append(np.concatenate(queues[c]))
            queues[c] = []
            _dealt(done[-1], before, queues)
        return np.concatenate(done) if done else nothing

    larger = []
    for c in range(size):  # left to right: each suffix puts the larger-typed one before it at its bucket's head
        larger.append(emptied(larger_q, c, before_larger))
        for at in seed_q[c]:
            _dealt(at, before_larger, larger_q)
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):  # right to left: smaller-typed ones go to their buckets' tails
        tail = emptied(smaller_q, c, before_smaller)[::-1]
        if len(larger[c]):
            _dealt(larger[c][::-1], before_smaller, smaller_q)
        if c in (0, apart) and seed_q[c]:  # the last symbol stands alone
            tail = np.concatenate(seed_q[c])
        out += [tail, larger[c]]
    return np.concatenate(out[::-1])


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, the last of which occurs once, by doubling the prefix that is sorted.

    A suffix's rank is the place of the first that is equal to it so far, so those that are told
    apart already keep theirs, and only the others are sorted on.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.searchsorted(ordered, ordered)
    same = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
    open_ = order[same[1:] | same[:-1]]
    width = 1
    while len(open_):  # equal prefixes do not hold the last name, so a rank follows them
        key = rank[open_] * n + rank[open_ + width]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = key // n
        fresh = np.concatenate(([True], key[1:] != key[:-1], [True]))
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(fresh[:-1], at, 0))
        head = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), at, 0))
        rank[open_] = group + first - head
        open_ = open_[~(fresh[:-1] & fresh[1:])]
        width *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


def _names(s: np.ndarray, order: np.ndarray, marks: np.ndarray, apart: int) -> np.ndarray:
    """Number the leftmost-smaller substrings, given in order: equal ones get one number, but for those that begin or end with the symbol apart. marks: their starts in text order."""
    length = np.ones(len(s), dtype=np.int64)
    length[marks[:-1]] = np.diff(marks) + 1
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (s[a] != apart) & (s[a + length[a] - 1] != apart)
    pairs = np.flatnonzero(same)
    if len(pairs):
        counts = length[a[pairs]]
        differs = s[spread(a[pairs], counts)] != s[spread(b[pairs], counts)]
        same[pairs] = np.add.reduceat(differs.astype(np.int64), np.cumsum(counts) - counts) == 0
    same[0] = False  # the last symbol
    return np.concatenate(([0], np.cumsum(~same)))


def sort_suffixes(s: np.ndarray, size: int, apart: int = -1) -> np.ndarray:
    """Suffix array of s, whose last symbol is 0 and stands there alone; symbols are below size.

    The symbol apart, if any, separates strings: each of its occurrences counts as a symbol of
    its own, ordered by place (the one before the last symbol first), so that no comparison runs
    on into the next string. It is 1, none stands beside another, and the alphabet is small.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = smaller_than_next(s)
    marks = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    before = np.concatenate(([-1], s[:-1])).astype(s.dtype)
    before_is_smaller = np.concatenate(([False], smaller[:-1]))
    before_larger, before_smaller = np.where(before_is_smaller, -1, before), np.where(before_is_smaller, before, -1)
    is_mark = np.zeros(n, dtype=bool)
    is_mark[marks] = True
    order = _induce(s, before_larger, before_smaller, marks, size, apart)
    order = order[is_mark[order]]
    if len(order) > 1:
        names = _names(s, order, marks, apart)
        n_names = int(names[-1]) + 1
        if n_names < len(order):
            at = np.empty(n, dtype=np.int64)
            at[order] = names
            order = marks[_sort_names(at[marks])]
        # else all names differ, and the order of the substrings is that of the suffixes
    return _induce(s, before_larger, before_smaller, order, size, apart)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, apart: int = -1) -> np.ndarray:
    """For each position, how long a prefix its suffix shares with the one before it in order; apart as in sort_suffixes.

    From a position to the next the value falls by one at most, and does exactly that wherever
    the two suffixes are preceded by the same symbol; only at the other positions it is counted.
    """
    n = len(sa)
    prior = np.empty(n, dtype=np.int64)
    prior[sa[0]] = -1
    prior[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int64)
    at = np.arange(n)
    counted = (prior < 0) | (prior == 0) | (at == 0)
    inner = ~counted
    counted[inner] = (s[at[inner] - 1] != s[prior[inner] - 1]) | (s[at[inner] - 1] == apart)
    open_ = np.flatnonzero(counted & (prior >= 0))
    length = 0
    while len(open_):  # the last symbol is unlike any other, so no comparison runs over the end
        symbols = s[open_ + length]
        open_ = open_[(symbols == s[prior[open_] + length]) & (symbols != apart)]
        length += 1
        out[open_] = length
    last = np.maximum.accumulate(np.where(counted, at, 0))
    return out[last] - (at - last)
