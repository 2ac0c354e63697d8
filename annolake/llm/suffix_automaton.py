"""The suffix automaton of many sequences of numbers, up to a depth.

A state is a class of sequences that end at the same places (endpos); all are suffixes of its longest one, so a state is an end place, a shortest and a longest length and how many places
there are. Its suffix link leads to the state of its shortest sequence without the first number. The links form the tree of the sequences read backwards, and that is how the
states are made here, for all places at once: level by level, each place's sequence is its sequence of the level before, the link, with one number put in front; where the count
stays the same the class goes on, and a state ends where it falls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Automaton:
    end: np.ndarray  # a place where each state's sequences end
    shortest: np.ndarray
    longest: np.ndarray
    count: np.ndarray  # of end places
    link: np.ndarray  # state, -1 for the empty sequence

    def substrings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end place, length, count) of each different sequence once."""
        each = self.longest - self.shortest + 1
        state = np.repeat(np.arange(len(each)), each)
        length = self.shortest[state] + np.arange(len(state)) - np.repeat(np.cumsum(each) - each, each)
        return self.end[state], length, self.count[state]


def automaton(numbers: np.ndarray, levels: Sequence[np.ndarray]) -> Automaton:
    """``levels[k]``: the places, ascending, where a sequence of k + 1 numbers ends that counts; which are left out depends on the sequences alone, and with a sequence its extensions are."""
    size = int(numbers.max(initial=-1)) + 1
    at = np.full(len(numbers), -1)  # node of the level before at each place
    ends, depths, counts, links, base = [], [], [], [], 0
    for k, places in enumerate(levels):
        nodes = numbers[places] if k == 0 else at[places] * size + numbers[places - k]
        _, first, inverse, count = np.unique(nodes, return_index=True, return_inverse=True, return_counts=True)
        links.append(np.full(len(first), -1) if k == 0 else before + at[places[first]])  # noqa: F821
        ends.append(places[first])
        depths.append(np.full(len(first), k + 1))
        counts.append(count)
        at = np.full(len(numbers), -1)
        at[places] = inverse
        before, base = base, base + len(first)
    end, depth, count, link = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ends, depths, counts, links))
    # a node whose extension has as many places is of one class with it
    goes_on = np.zeros(len(end), bool)
    inner = link >= 0
    same = inner.copy()
    same[inner] = count[inner] == count[link[inner]]
    goes_on[link[same]] = True
    longest = np.nonzero(~goes_on)[0]
    state = np.full(len(end), -1)
    state[longest] = np.arange(len(longest))
    shortest, top = longest.copy(), longest.copy()
    while len(top):  # as many rounds as the depth
        top = top[same[top]]
        owner = state[top]
        top = link[top]
        state[top] = owner
        shortest[owner] = top
    out = link[shortest]
    return Automaton(end[longest], depth[shortest], depth[longest], count[longest], np.where(out >= 0, state[out], -1))
