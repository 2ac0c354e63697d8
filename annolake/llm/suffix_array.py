"""Suffix sorting of a byte string in two stages.

A suffix is small if it is smaller than its successor (the suffix one byte on). Only small suffixes are sorted directly; every large one starts with
its successor put behind one byte that is not smaller, so its place follows from its successor's: a scan over the buckets in order hands each suffix's
predecessor to the bucket of its first byte. Order is exact in the first ``depth`` bytes, which is all that prefixes of up to that length need.
"""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray, behind: int) -> np.ndarray:
    """The eight bytes at each place as one big-endian integer, zeros behind the end."""
    padded = np.zeros(len(data) + behind + 8, np.uint64)
    padded[: len(data)] = data
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def small_suffixes(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the empty suffix behind the last is the smallest of all."""
    n = len(data)
    small = np.zeros(n, bool)
    if n > 1:
        step = np.nonzero(data[:-1] != data[1:])[0]
        # within a run of one byte, the run's end decides
        end = np.searchsorted(step, np.arange(n - 1))
        known = end < len(step)
        at = step[end[known]]
        small[:-1][known] = data[at] < data[at + 1]
    return small


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of the suffixes of ``data`` (uint8) in the order of their first ``depth`` bytes; of those that ``wanted`` marks, if given.

    A large suffix is placed by its successor, so from each wanted one the successors up to the next small suffix are sorted along.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    count = -(-depth // 8)
    small = small_suffixes(data)
    needed = np.ones(n, bool)
    if wanted is not None:
        place = np.arange(n)
        last_wanted = np.maximum.accumulate(np.where(wanted, place, -1))
        last_small = np.maximum.accumulate(np.where(small, place, -1))
        needed = last_wanted > np.concatenate([[-1], last_small[:-1]])
    words = _words(data, 8 * count)
    direct = np.nonzero(small & needed)[0]
    direct = direct[np.lexsort([words[direct + 8 * k] for k in range(count - 1, -1, -1)])]
    del words
    large = needed & ~small
    starts = np.concatenate([[0], np.cumsum(np.bincount(data[needed], minlength=256))])
    large_count = np.bincount(data[large], minlength=256)
    order = np.full(starts[256], -1, np.int64)
    first = data[direct]
    split = np.searchsorted(first, np.arange(257))
    for c in range(256):  # small suffixes stand at the end of their bucket
        order[starts[c] + large_count[c] : starts[c + 1]] = direct[split[c] : split[c + 1]]
    head = starts[:256].copy()

    def hand(places: np.ndarray, above: int, same: int | None) -> np.ndarray:
        """Puts the predecessors of ``places`` that are large into their buckets; those of bucket ``same`` are returned."""
        before = places[places > 0] - 1
        before = before[large[before]]
        key = data[before]
        if same is not None:
            again = before[key == same]
            order[head[same] : head[same] + len(again)] = again
            head[same] += len(again)
            return again
        before = before[key > above]
        key = data[before]
        by = np.argsort(key, kind="stable")
        before, key = before[by], key[by]
        sizes = np.bincount(key, minlength=256)
        at = np.repeat(head - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(key))
        order[at] = before
        head[:] += sizes
        return before

    last = n - 1  # successor: the empty suffix, which stands before all
    if large[last]:
        order[head[data[last]]] = last
        head[data[last]] += 1
    for c in range(256):
        if starts[c] == starts[c + 1]:
            continue
        at = starts[c]
        while at < head[c]:  # a run of c reaches back into its own bucket
            end = head[c]
            hand(order[at:end], c, c)
            at = end
        hand(order[starts[c] : starts[c + 1]], c, None)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order how many bytes, ``most`` at most, it shares with the one before it (the first: 0)."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    words = _words(data, most)
    left, right = order[:-1], order[1:]
    going = np.arange(len(left))
    for at in range(0, most, 8):
        a, b = words[left[going] + at], words[right[going] + at]
        differ = a ^ b
        equal = differ == 0
        shared[going[equal] + 1] += 8
        rest = differ[~equal]
        # leading equal bytes of the word that differs
        same = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            same += (rest >> np.uint64(64 - 8 * k)) == 0
        shared[going[~equal] + 1] += same
        going = going[equal]
    ends = len(data) - np.maximum(left, right)
    shared[1:] = np.minimum(np.minimum(shared[1:], ends), most)
    return shared
