"""Tries over small integer labels in two arrays: a child by ``label`` of state ``s``
is state ``base[s] + label``, and ``check`` of it is ``s``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places that are tried at once for a state's children.
TRIED = 64


def common_prefixes(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many first labels each sequence shares with the one before it."""
    sizes = np.diff(offsets)
    shared = np.zeros(len(sizes), np.int64)
    active, depth = np.arange(1, len(sizes)), 0
    while len(active):
        active = active[(sizes[active] > depth) & (sizes[active - 1] > depth)]
        here, there = offsets[active] + depth, offsets[active - 1] + depth
        active = active[codes[here] == codes[there]]
        depth += 1
        shared[active] = depth
    return shared


@dataclass
class DoubleArray:
    """State 0 is the root; ``check`` is -1 where no state is."""

    base: np.ndarray
    check: np.ndarray

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children of states by labels, -1 where there is none."""
        found = self.base[states] + labels
        inside = (found > 0) & (found < len(self.check))
        found = np.where(inside, found, 0)
        return np.where(inside & (self.check[found] == states), found, -1)


def _edges(codes: np.ndarray, offsets: np.ndarray, shared: np.ndarray):
    """Parent and label of every node, level by level; nodes are numbered in that
    order from 1, children of one parent stand together."""
    sizes = np.diff(offsets)
    rows, node = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    parents, labels, count, depth = [], [], 0, 0
    while True:
        held = sizes[rows] > depth
        rows, node = rows[held], node[held]
        if not len(rows):
            break
        new = shared[rows] <= depth
        parents.append(node[new])
        labels.append(codes[offsets[rows[new]] + depth])
        node = count + np.cumsum(new)
        count += int(new.sum())
        depth += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(parents or none), np.concatenate(labels or none)


def build(codes: np.ndarray, offsets: np.ndarray) -> DoubleArray:
    """The trie of sorted sequences ``codes[offsets[i]:offsets[i + 1]]``.

    States with several children come first, those with most at the front, each at
    the first place where all children fit; only children then fill the holes.
    """
    parents, labels = _edges(codes, offsets, common_prefixes(codes, offsets))
    nodes, span = len(parents) + 1, int(labels.max(initial=0)) + 1
    starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
    starts = starts[: len(parents)]
    sizes = np.diff(np.append(starts, len(parents)))
    used = np.zeros(nodes + span + 1, bool)
    used[0] = True
    place = np.zeros(nodes, np.int64)  # of each node
    bases = np.zeros(nodes, np.int64)  # by node
    end, low = 1, 1
    several = np.flatnonzero(sizes > 1)
    for k in several[np.argsort(-sizes[several], kind="stable")].tolist():
        own = np.arange(starts[k], starts[k] + sizes[k])
        wanted = np.sort(labels[own])
        wanted = wanted - wanted[0]
        if len(used) < end + span + wanted[-1] + 1:
            used = np.append(used, np.zeros(len(used) + span, bool))
        at = low
        while True:
            window = np.arange(at, min(at + TRIED, end + 1))
            free = window[~used[window]]
            if len(free):
                fits = ~used[free[:, None] + wanted].any(1)
                if fits.any():
                    first = int(free[np.argmax(fits)])
                    break
            at += TRIED
            if at > end:
                first = end
                break
        used[first + wanted] = True
        end = max(end, first + int(wanted[-1]) + 1)
        while used[low]:
            low += 1
        base = first - int(labels[own].min())
        bases[parents[own[0]]] = base
        place[own + 1] = base + labels[own]
    single = starts[sizes == 1]
    if len(single):
        free = np.flatnonzero(~used[:end])
        more = max(0, len(single) - len(free))
        free = np.append(free, np.arange(end, end + more))[: len(single)]
        place[single + 1] = free
        bases[parents[single]] = free - labels[single]
    size = int(place.max(initial=0)) + 1
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    base[place] = bases
    check[place[1:]] = place[parents]
    return DoubleArray(base, check)
