"""Lossless counters of packed n-grams: counting quotient filters.

A gram of small integers is packed into few 64-bit parts, which an invertible
permutation spreads evenly. The leading bits of the permuted gram, its quotient,
say where in the filter it stands; the rest is stored whole beside its counter, so
nothing is lost and the grams can be read back. Filters are sorted by construction:
filters of one range of quotients, made by different tasks, are merged like sorted
runs, and no gram makes a range larger than another, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ROUNDS = 2
#: Counters below this take one byte; others stand whole in a list of their own.
BYTE_COUNTERS = 255
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ONE, _32 = np.uint64(1), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _MIX
    return (x ^ (x >> _32)) * _MIX


def _low(x: np.ndarray, bits: int) -> np.ndarray:
    return x & np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """Grams of ``length`` ids below ``2 ** bits``, as parts of whole ids."""

    length: int
    bits: int

    @property
    def ids_of_parts(self) -> list[int]:
        parts = -(-self.length // (64 // self.bits))
        return [self.length // parts + (k < self.length % parts) for k in range(parts)]

    @property
    def widths(self) -> list[int]:
        return [n * self.bits for n in self.ids_of_parts]

    def pack(self, columns: list[np.ndarray]) -> np.ndarray:
        """Columns of ids, one for each place, as parts (parts x grams)."""
        at, made = 0, []
        for n in self.ids_of_parts:
            part = columns[at].astype(np.uint64)
            for column in columns[at + 1 : at + n]:
                part = (part << np.uint64(self.bits)) | column.astype(np.uint64)
            made.append(part)
            at += n
        return np.stack(made)

    def unpack(self, parts: np.ndarray) -> np.ndarray:
        """Grams x ids."""
        columns = []
        for part, n in zip(parts, self.ids_of_parts, strict=True):
            for k in range(n):
                shift = np.uint64((n - 1 - k) * self.bits)
                columns.append(_low(part >> shift, self.bits).astype(np.int64))
        return np.stack(columns, 1)

    def permute(self, parts: np.ndarray) -> np.ndarray:
        """Each part is scrambled by itself, then changed by the next one's value;
        both can be undone."""
        out, widths = parts.copy(), self.widths
        for _ in range(ROUNDS):
            for k, w in enumerate(widths):
                half = np.uint64((w + 1) // 2)
                x = out[k] ^ (out[k] >> half)
                x = _low(x * np.uint64(_ODD), w)
                out[k] = x ^ (x >> half)
                if len(widths) > 1:
                    out[k] ^= _low(_mixed(out[(k + 1) % len(widths)]), w)
        return out

    def restore(self, parts: np.ndarray) -> np.ndarray:
        out, widths = parts.copy(), self.widths
        for _ in range(ROUNDS):
            for k in reversed(range(len(widths))):
                w = widths[k]
                if len(widths) > 1:
                    out[k] ^= _low(_mixed(out[(k + 1) % len(widths)]), w)
                half = np.uint64((w + 1) // 2)
                x = out[k] ^ (out[k] >> half)
                x = _low(x * np.uint64(pow(_ODD, -1, 1 << w)), w)
                out[k] = x ^ (x >> half)
        return out

    def block_bits(self, wanted: int) -> int:
        return min(wanted, self.widths[0])


def collapse(parts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct columns of ``parts``, and the sums of their counts."""
    if not len(counts):
        return parts, counts
    order = (
        np.argsort(parts[0], kind="stable")
        if len(parts) == 1
        else np.lexsort(parts[::-1])
    )
    parts = parts[:, order]
    new = np.append(True, (parts[:, 1:] != parts[:, :-1]).any(0))
    starts = np.flatnonzero(new)
    return parts[:, starts], np.add.reduceat(counts[order], starts)


def _bytes_of(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(
        x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    ).tobytes()


def _from_bytes(data: memoryview, n: int, size: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    return whole.reshape(-1).view("<u8")


@dataclass(frozen=True)
class Layout:
    """How the filters of one range of quotients are laid out: the first
    ``block_bits`` bits of a permuted gram name the range."""

    packing: Packing
    block_bits: int

    def write(self, parts: np.ndarray, counts: np.ndarray) -> bytes:
        """One filter of sorted, distinct, permuted grams of one range: number of
        grams and width of the first remainder; for every quotient its grams in
        unary; remainders; counters of a byte each; the larger counters."""
        n, first = len(counts), self.packing.widths[0]
        left = first - self.block_bits
        size = -(-max(0, left - n.bit_length()) // 8)
        rest = min(left, 8 * size)
        quotient = _low(parts[0], left) >> np.uint64(rest)
        places = quotient.astype(np.int64) + np.arange(n)
        runs = np.zeros((1 << (left - rest)) + n, np.uint8)
        runs[places] = 1
        small = np.minimum(counts, BYTE_COUNTERS).astype(np.uint8)
        return b"".join(
            [
                np.array([n, rest], "<u4").tobytes(),
                np.packbits(runs).tobytes(),
                _bytes_of(_low(parts[0], rest), size),
                *[
                    _bytes_of(part, -(-w // 8))
                    for part, w in zip(parts[1:], self.packing.widths[1:], strict=True)
                ],
                small.tobytes(),
                counts[small == BYTE_COUNTERS].astype("<i8").tobytes(),
            ]
        )

    def read(self, block: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The permuted grams of a filter, sorted, and their counts."""
        view = memoryview(data)
        n, rest = (int(x) for x in np.frombuffer(view, "<u4", 2))
        left = self.packing.widths[0] - self.block_bits
        slots = (1 << (left - rest)) + n
        at = 8 + -(-slots // 8)
        runs = np.unpackbits(np.frombuffer(view[8:at], np.uint8))
        quotient = np.flatnonzero(runs)[:n] - np.arange(n)
        size = -(-rest // 8)
        low = _from_bytes(view[at:], n, size) if size else np.zeros(n, np.uint64)
        at += n * size
        lead = np.full(n, block, np.uint64) << np.uint64(left) if left < 64 else 0
        parts = [lead | (quotient.astype(np.uint64) << np.uint64(rest)) | low]
        for w in self.packing.widths[1:]:
            parts.append(_from_bytes(view[at:], n, -(-w // 8)))
            at += n * -(-w // 8)
        counts = np.frombuffer(view, np.uint8, n, at).astype(np.int64)
        large = counts == BYTE_COUNTERS
        counts[large] = np.frombuffer(view[at + n :], "<i8", int(large.sum()))
        return np.stack(parts), counts

    def blocks(self, parts: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """Sorted grams of all ranges as (range, filter)."""
        shift = np.uint64(self.packing.widths[0] - self.block_bits)
        block = parts[0] >> shift if self.block_bits else np.zeros(len(counts), int)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for start, end in zip(starts, np.append(starts[1:], len(counts)), strict=True):
            own = self.write(parts[:, start:end], counts[start:end])
            yield int(block[start]), own

    def merge(self, block: int, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Grams (restored) and total counts of the filters of one range."""
        read = [self.read(block, data) for data in filters]
        parts, counts = collapse(
            np.concatenate([p for p, _ in read], 1),
            np.concatenate([c for _, c in read]),
        )
        return self.packing.restore(parts), counts


class Counter:
    """Counts grams in bounded memory; what is full goes out as filters."""

    def __init__(self, layout: Layout, limit: int) -> None:
        self.layout, self.limit = layout, limit
        self.parts: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        for start in range(0, len(columns[0]), self.limit):
            some = [c[start : start + self.limit] for c in columns]
            packing = self.layout.packing
            self.parts.append(packing.permute(packing.pack(some)))
            self.counts.append(np.ones(len(some[0]), np.int64))
            self.held += len(some[0])
            if self.held >= self.limit:
                self._collapse()
                if self.held >= self.limit // 2:
                    yield from self.flush()

    def _collapse(self) -> None:
        parts, counts = collapse(
            np.concatenate(self.parts, 1), np.concatenate(self.counts)
        )
        self.parts, self.counts, self.held = [parts], [counts], len(counts)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            self._collapse()
            yield from self.layout.blocks(self.parts[0], self.counts[0])
        self.parts, self.counts, self.held = [], [], 0
