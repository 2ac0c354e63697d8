"""Numbers as bit slices: row p of an array holds bit p of each of many numbers, 64 numbers to a word. Sums need only bitwise operations on whole rows."""

from __future__ import annotations

import numpy as np


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers with the sum of three: the sum without carries, and the carries, one slice up. The last slice must not carry."""
    half = a ^ b
    carry = np.zeros_like(a)
    carry[1:] = ((a & b) | (half & c))[:-1]
    return half ^ c, carry


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum, by carries from slice to slice."""
    out, carry = np.empty_like(a), np.zeros(a.shape[1], a.dtype)
    for p in range(len(a)):
        half = a[p] ^ b[p]
        out[p] = half ^ carry
        carry = (a[p] & b[p]) | (half & carry)
    return out


def total(numbers: list[np.ndarray]) -> np.ndarray:
    """The sum of one number or more."""
    if len(numbers) < 3:
        return numbers[0] if len(numbers) == 1 else added(*numbers)
    s, c = carry_save(*numbers[:3])
    for x in numbers[3:]:
        s, c = carry_save(s, c, x)
    return added(s, c)


def times(slices: np.ndarray, factor: int, height: int) -> np.ndarray:
    """Each number times a factor of at least 1, in so many slices: a copy shifted up for each bit of the factor."""
    shifted = []
    for j in range(factor.bit_length()):
        if factor >> j & 1:
            out = np.zeros((height, slices.shape[1]), slices.dtype)
            upper = min(len(slices), height - j)
            out[j : j + upper] = slices[:upper]
            shifted.append(out)
    return total(shifted)


def spread(packed: bytes, places: np.ndarray, height: int, wide: int) -> np.ndarray:
    """Slices of a few numbers as slices of many: number i goes to ``places[i]``, the others are 0. ``packed``: slice after slice, eight numbers to a byte; ``wide``: words of 64 of the result."""
    bits = np.zeros((height, wide * 64), np.uint8)
    rows = np.frombuffer(packed, np.uint8).reshape(height, -1)
    bits[:, places] = np.unpackbits(rows, axis=1, count=len(places))
    return np.packbits(bits, axis=1).view(np.uint64)


def chosen(mask: np.ndarray) -> np.ndarray:
    """The places of the bits of a row."""
    return np.nonzero(np.unpackbits(mask.view(np.uint8)))[0]


def at(slices: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The numbers at some places."""
    own = slices.view(np.uint8)[:, places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1
    return (own.astype(np.int64) << np.arange(len(slices))[:, None]).sum(0)


def top(slices: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest numbers above 0, of equal ones the first; from the highest slice down, those that are certainly among them and those that still may be."""
    sure = np.zeros(slices.shape[1], slices.dtype)
    maybe = np.bitwise_or.reduce(slices, axis=0)
    for row in slices[::-1]:
        both = sure | (maybe & row)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            maybe = maybe & row
        elif n < k:
            sure, maybe = both, maybe & ~row
        else:
            return chosen(both)
    return np.concatenate([chosen(sure), chosen(maybe)[: k - int(np.bitwise_count(sure).sum())]])
