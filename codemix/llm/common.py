"""Helpers shared by the operators: Arrow slices of bounded size and vectorised word hashes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles at once; a longer text is cut at separators.
SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values drawn from a seed."""
    first = np.uint64((seed * _STEP + 1) & _MASK)
    return mix(first + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def row_slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows [0, n) into runs of about ``limit`` bytes; one row at least."""
    n, start = len(bounds) - 1, 0
    while start < n:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def thin(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``limit`` bytes of one text column, so that Python copies stay small.

    At the end memory that a reused worker holds without need goes back.
    """
    for batch in batches:
        _, bounds = text_buffer(batch.column(column))
        for a, b in row_slices(bounds, limit):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return memory that the worker holds without need to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = space_table()


def _lowered(seed: int) -> np.ndarray:
    table = stream(seed, 256)
    table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1]
    return table


class WordHasher:
    """64-bit hashes of the words of a text: runs of bytes outside ``breaks``, by default ``[\\x20\\x09-\\x0D]``.

    A word's hash sums a random value per byte times a power of its place, then
    mixes; A-Z count as a-z when ``lower`` is set.  Sums of a run of bytes are
    differences of running sums, shifted back by an inverse power.
    """

    def __init__(self, lower: bool, seed: int = 7, breaks: np.ndarray = SPACE):
        self.table = _lowered(seed) if lower else stream(seed, 256)
        self.breaks = breaks
        self.base = int(stream(seed + 1, 1)[0]) | 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                grown = np.full(n, base, np.uint64)
                grown[0] = 1
                setattr(self, name, np.cumprod(grown))

    def pieces(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts of one long text into pieces that end at separators."""
        start, n = 0, len(data)
        while start < n:
            stop = min(start + SLICE_BYTES, n)
            while stop < n:
                gap = np.flatnonzero(self.breaks[data[stop:stop + SLICE_BYTES]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(stop + SLICE_BYTES, n)
            yield start, stop
            start = stop

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words; no word crosses a bound."""
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~self.breaks[data]
        edge = inside[1:] != inside[:-1]
        at = np.flatnonzero(edge)
        starts, ends = at[::2], at[1::2]
        inner = bounds[1:-1]
        cut = inner[(inner > 0) & (inner < len(data))]
        if len(cut):
            cut = np.unique(cut)
            cut = cut[inside[cut] & inside[cut + 1]]
            if len(cut):
                starts = np.sort(np.concatenate([starts, cut]))
                ends = np.sort(np.concatenate([ends, cut]))
        return starts, ends

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes in rising order; steps of about SLICE_BYTES."""
        out, a = np.zeros(len(starts), np.uint64), 0
        while a < len(starts):
            base = int(starts[a])
            if ends[a] - base > SLICE_BYTES:
                out[a] = self._long(data[base:ends[a]])
                a += 1
                continue
            b = int(np.searchsorted(ends, base + SLICE_BYTES, "right"))
            part = data[base:ends[b - 1]]
            self._grow(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.table[part] * self.powers[:len(part)], out=sums[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = mix((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64))
            a = b
        return out

    def _long(self, run: np.ndarray) -> np.uint64:
        cuts = np.arange(0, len(run), SLICE_BYTES)
        found = self.hashes(run, cuts, np.minimum(cuts + SLICE_BYTES, len(run)))
        value = found[:1]
        for k in range(1, len(found)):
            value = mix(value ^ found[k])
        return value[0]

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all rows in order, and the n + 1 bounds of each row's words."""
        if len(bounds) == 2 and len(data) > SLICE_BYTES:
            found = []
            for a, b in self.pieces(data):
                part = data[a:b]
                found.append(self.hashes(part, *self.spans(part, np.array([0, len(part)]))))
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            return hashes, np.array([0, len(hashes)])
        starts, ends = self.spans(data, bounds)
        return self.hashes(data, starts, ends), np.searchsorted(starts, bounds, "left")


class Remembered:
    """A direct-mapped memory from 64-bit hashes to entry numbers; the first hash of a slot stays."""

    def __init__(self, bits: int):
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entries = np.zeros(1 << bits, np.int64)
        self.mask, self.size = np.uint64((1 << bits) - 1), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry numbers; -1 where a hash is not known."""
        slots = (hashes & self.mask).astype(np.int64)
        return np.where((self.keys[slots] == hashes) & (hashes != 0), self.entries[slots], -1)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` (distinct, unknown) of those that found a free slot; they get the next entries."""
        slots = (hashes & self.mask).astype(np.int64)
        free = np.flatnonzero(self.keys[slots] == 0)
        _, first = np.unique(slots[free], return_index=True)
        kept = free[np.sort(first)]
        self.keys[slots[kept]] = hashes[kept]
        self.entries[slots[kept]] = self.size + np.arange(len(kept))
        self.size += len(kept)
        return kept


class Grown:
    """An array that rows are appended to, with room to spare."""

    def __init__(self, dtype):
        self.room, self.size = np.zeros(1 << 12, dtype), 0

    def append(self, rows: np.ndarray) -> None:
        need = self.size + len(rows)
        if need > len(self.room):
            grown = np.zeros(max(need, 2 * len(self.room)), self.room.dtype)
            grown[:self.size] = self.room[:self.size]
            self.room = grown
        self.room[self.size:need] = rows
        self.size = need


class ChunkIds:
    """Ids of texts through their distinct chunks: words, with the white space before them when ``glued``.

    ``encode`` gives the ids of a list of chunks.  Up to ``2 ** bits`` chunks of at most
    ``LONGEST`` ids are remembered; the others are encoded again in the next block.
    """

    LONGEST = 64

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], glued: bool, bits: int = 18):
        self.encode, self.glued = encode, glued
        self.hasher, self.memory = WordHasher(False), Remembered(bits)
        self.begin, self.sizes, self.flat = Grown(np.int64), Grown(np.int64), Grown(np.uint32)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of every text of a block, in order."""
        starts, ends = self.hasher.spans(data, bounds)
        if self.glued:
            border = np.zeros(len(data) + 1, bool)
            border[0] = border[bounds] = border[ends] = True
            edge = np.flatnonzero(border)
            starts, ends = edge[:-1], edge[1:]
        if not len(starts):
            for _ in range(len(bounds) - 1):
                yield np.zeros(0, np.uint32)
            return
        hashes = self.hasher.hashes(data, starts, ends)
        place = self.memory.find(hashes)
        missed = np.flatnonzero(place < 0)
        begin, sizes, flat = (g.room[:g.size] for g in (self.begin, self.sizes, self.flat))
        if len(missed):
            new, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            first, whole = missed[first], memoryview(data)
            found = self.encode([bytes(whole[s:e]).decode("utf-8", "surrogatepass")
                                 for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            more = np.array([len(f) for f in found], np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(more.sum()))
            at = np.cumsum(more) - more
            place[missed] = len(sizes) + back
            begin, sizes = np.concatenate([begin, len(flat) + at]), np.concatenate([sizes, more])
            flat = np.concatenate([flat, ids])
            short = np.flatnonzero(more <= self.LONGEST)
            kept = short[self.memory.add(new[short])]
            stay = np.zeros(len(more), bool)
            stay[kept] = True
            kept_sizes = more[kept]
            self.begin.append(self.flat.size + np.cumsum(kept_sizes) - kept_sizes)
            self.sizes.append(kept_sizes)
            self.flat.append(ids[np.repeat(stay, more)])
        cuts = np.searchsorted(starts, bounds, "left")
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            use = place[s:e]
            take = sizes[use]
            shift = np.cumsum(take) - take
            yield flat[np.arange(int(take.sum())) + np.repeat(begin[use] - shift, take)]
