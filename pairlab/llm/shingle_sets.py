"""Sets of word shingles in NumPy: hashing, sketches, and exact overlaps from index
lists with skipping and incremental answers."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SHINGLE = 5
#: Bits of a set's parity sketch.
SKETCH_BITS = 512

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits (shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_PLACE = mixed(np.arange(1, SHINGLE + 2, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
_BASE = _U(0x5851F42D4C957F2D)


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word between blanks, A-Z taken as a-z: a polynomial over
    the word's bytes, mixed with its length."""
    data = np.frombuffer(text, np.uint8)
    solid = ~_BLANK[data]
    edges = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, _U)
    lengths = np.flatnonzero(edges == -1) - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, _U))
    sums = np.add.reduceat(_LETTER[data[solid]] * powers[place], firsts)
    return mixed(sums ^ lengths.astype(_U))


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; of fewer words one hash
    of the whole; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, _U(size))
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


def set_id(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_size(size: int, percent: int) -> int:
    """How many tokens, first in any common order, two sets must share one of to be
    as similar as ``percent``: all but the least overlap, less one."""
    return size - -(-size * percent // 100) + 1


class Order:
    """A global order of tokens in which shared ones come late: tokens that no other
    set has shown first, then the others, frequent ones last, else by hash.

    ``shared`` is a bitmap and ``classes`` an array by the tokens' low bits. Both
    are of bounded size and may take a token for a shared one, which moves it in
    every set alike: any order gives right results, a good one short index lists.
    """

    def __init__(self, shared: np.ndarray, classes: np.ndarray) -> None:
        self.shared, self.classes = shared, classes

    def first(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The prefix of a set given by its sorted tokens."""
        low = low_bits(tokens)
        late = marked(self.shared, low).astype(np.uint8)
        late += late * self.classes[low & (len(self.classes) - 1)]
        by_class = np.argsort(late, kind="stable")
        return tokens[by_class[: prefix_size(len(tokens), percent)]]


def low_bits(tokens: np.ndarray) -> np.ndarray:
    """31 bits of each token."""
    return (tokens & _U(0x7FFFFFFF)).astype(np.int64)


def marked(bitmap: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of these numbers a bitmap of 64-bit words holds."""
    bit = low & (64 * len(bitmap) - 1)
    return (bitmap[bit >> 6] >> (bit & 63) & 1).astype(bool)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of ``SKETCH_BITS`` buckets whether it has an odd number of tokens.
    The sketches of two sets differ in no more bits than the sets in tokens."""
    at = (mixed(tokens) & _U(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1)


class Forest:
    """Union-find over places in a list."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def candidate_forest(
    sizes: np.ndarray, places: np.ndarray, sketches: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Edges that connect the members of one index list that may be similar, as far
    as sizes, places of the shared token and sketches tell. Members are sorted by
    size, so that a member's partners are a block of the list."""
    order = np.argsort(sizes, kind="stable")
    n, p, s = sizes[order], places[order], sketches[order].view(_U)
    forest, edges = Forest(len(n)), []
    ends = np.searchsorted(n, n * 100 // percent, "right")
    for i in range(len(n) - 1):
        block = slice(i + 1, int(ends[i]))
        if block.stop <= block.start:
            continue
        both = n[i] + n[block]
        # 100 * common >= percent * (both - common)
        least = -(-percent * both // (100 + percent))
        most = 1 + np.minimum(n[i] - p[i] - 1, n[block] - p[block] - 1)
        apart = np.bitwise_count(s[i] ^ s[block]).sum(axis=1)
        for j in np.flatnonzero((most >= least) & (both - apart >= 2 * least)):
            a, b = int(order[i]), int(order[i + 1 + j])
            if forest.join(a, b):
                edges.append((a, b))
    return edges


def links(
    sets: list[np.ndarray], split: int | None, percent: int, weights: np.ndarray
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All similar pairs among ``sets``, or between those before and from ``split``:
    a spanning forest of them, and the sum of the weights of each set's partners.

    Sets are taken in order of size. Index lists hold them in that order, so that
    only the block with fitting sizes is read of each list. The overlaps of a set
    are derived from those of the one before if these two differ in fewer tokens
    than the set has: lists of lost tokens are subtracted, those of new ones added.
    """
    total = len(sets)
    sizes = np.array([len(x) for x in sets])
    order = np.lexsort((np.array([int(x[0]) for x in sets], _U), sizes))
    sizes = sizes[order]
    flat = np.concatenate([sets[k] for k in order])
    _, tokens = np.unique(flat, return_inverse=True)
    owners = np.repeat(np.arange(total), sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    by_token = np.argsort(tokens, kind="stable")
    lists = owners[by_token]
    starts = np.searchsorted(tokens[by_token], np.arange(tokens.max() + 2))
    side = None if split is None else order < split
    lowest = np.searchsorted(sizes, -(-sizes * percent // 100), "left")
    own = [np.sort(tokens[bounds[k] : bounds[k + 1]]) for k in range(total)]

    def gathered(which: np.ndarray) -> np.ndarray:
        held = [lists[starts[t] : starts[t + 1]] for t in which]
        return np.concatenate(held) if held else np.zeros(0, np.int64)

    forest, edges = Forest(total), []
    weights, degrees = weights[order], np.zeros(total, np.int64)
    counts, before = None, None
    for k in range(total):
        lost = new = None
        if counts is not None:
            lost = np.setdiff1d(before, own[k], assume_unique=True)
            new = np.setdiff1d(own[k], before, assume_unique=True)
        if lost is not None and len(lost) + len(new) < len(own[k]):
            counts = (
                counts
                + np.bincount(gathered(new), minlength=total)
                - np.bincount(gathered(lost), minlength=total)
            )
        else:
            counts = np.bincount(gathered(own[k]), minlength=total)
        before = own[k]
        block = slice(int(lowest[k]), k)
        common, both = counts[block], sizes[block] + sizes[k]
        fit = (100 + percent) * common >= percent * both
        if side is not None:
            fit &= side[block] != side[k]
        partners = np.flatnonzero(fit) + block.start
        degrees[k] += weights[partners].sum()
        degrees[partners] += weights[k]
        for j in partners.tolist():
            if forest.join(j, k):
                edges.append((int(order[j]), int(order[k])))
    placed = np.empty(total, np.int64)
    placed[order] = degrees
    return edges, placed
