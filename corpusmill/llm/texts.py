"""Texts of an Arrow batch as one run of UTF-8 bytes, and hashes of spans of it.

Everything here works on bounded pieces: :func:`pieces` cuts a batch so that one
piece holds about ``PIECE_BYTES`` of text, or a single longer document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the SplitMix64 finalizer)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _table(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += _U(32)
    return mixed((codes + _U(1)) * _STEP)


BYTE_VALUES = _table(False)
FOLDED_VALUES = _table(True)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_FIRST = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 1024), _U(0xD1342543DE82EF95))
            grown[0] = 1
            _POWERS = np.multiply.accumulate(grown)
    return _POWERS


class Texts:
    """``data`` holds all bytes; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``.

    A null text is an empty one.
    """

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        n = len(column)
        if n == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[at[0] : at[-1]]
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_bytes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def counted(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offsets])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the runs between ASCII white space."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~IS_SPACE[self.data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], before[0] = ~inside[:-1], True
        after[:-1], after[-1] = ~inside[1:], True
        full = self.n_bytes > 0
        before[self.offsets[:-1][full]] = True
        after[self.offsets[1:][full] - 1] = True
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        return starts, ends, self.owner(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the parts between line feeds.

        A text of n line feeds has n + 1 lines; an empty text has one.
        """
        breaks = np.flatnonzero(self.data == 10)
        owners = self.owner(breaks)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        order = np.argsort(np.concatenate([np.arange(len(self)), owners]), kind="stable")
        last = np.argsort(np.concatenate([owners, np.arange(len(self))]), kind="stable")
        return starts[order], ends[last], np.concatenate([np.arange(len(self)), owners])[order]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each span's bytes, with A-Z as a-z if ``fold``."""
        lens = ends - starts
        out = np.zeros(len(starts), np.uint64)
        full = lens > 0
        if full.any():
            s, n = starts[full], lens[full]
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
            byte = self.data[place + np.repeat(s, n)]
            with np.errstate(over="ignore"):
                terms = (FOLDED_VALUES if fold else BYTE_VALUES)[byte]
                terms *= _powers(int(n.max()))[place]
                out[full] = np.add.reduceat(terms, first) + n.astype(np.uint64)
        with np.errstate(over="ignore"):
            return mixed(out * _STEP)


def shingles(hashes: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` neighbouring words of a text, and their text numbers."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0], owners[:0]
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = mixed(out * _U(3) + hashes[k : k + n] + _U(k))
    same = owners[:n] == owners[size - 1 :]
    return out[same], owners[:n][same]


def bounds(owners: np.ndarray, n: int) -> np.ndarray:
    """Where each text's entries begin and end in an array ordered by text."""
    return np.searchsorted(owners, np.arange(n + 1))


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, a row at least each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that is free back to the system.

    A Python worker lives on after its task, and what its allocators keep then
    would be missing to the tasks that run beside it.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run):
    """``run`` for ``mapInArrow``; at its end the worker gives its memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def by_piece(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A ``mapInArrow`` function that applies ``work`` to bounded slices."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                out = work(piece)
                if out is not None:
                    yield out

    return released(run)


def list_array(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Lists from flat values; list ``i`` is ``values[starts[i]:starts[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


class Lookup:
    """A map from 64-bit keys to numbers, for whole arrays at a time.

    ``room`` is how many keys it can take; the given ones must be distinct.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0) -> None:
        self.bits = max(4, int(2 * max(room, len(keys))).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.used = np.zeros(1 << self.bits, bool)
        self.values = np.zeros(1 << self.bits, values.dtype)
        self.size = 0
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Take in new keys, none of which is known yet."""
        self.size += len(keys)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = ~self.used[at]
            self.keys[at[free]] = keys[left[free]]
            self.used[at[free]] = True
            won = self.used[at] & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _STEP) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are known; the value of others is 0."""
        out, known = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            hit = self.used[at] & (self.keys[at] == keys[left])
            out[left[hit]] = self.values[at[hit]]
            known[left[hit]] = True
            on = self.used[at] & ~hit
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out, known
