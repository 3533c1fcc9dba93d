"""Lattices of subword pieces over a whole batch of words: a trie, forward-backward, best paths.

The trie is three flat arrays.  All words of a batch walk it together, one character a step;
the sums and maxima then advance over all words by one position a step, so nothing loops over
words.  A model is a stored table ``piece, logp`` that workers read from the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

CHAR_BITS = 21
#: Characters of words whose lattice is held at once.
BATCH_CHARS = 1 << 18
UNKNOWN_COST = -30.0


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _levels(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per character position the texts that reach it and the places of these characters."""
    live, at = np.flatnonzero(sizes > 0), 0
    while len(live):
        yield live, first[live] + at
        at += 1
        live = live[sizes[live] > at]


class Trie:
    """Nodes are numbered by level; ``edges`` holds (parent, character) in ascending order, child k + 1."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces = pieces
        codes, sizes = code_points(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        first, node, edges, total = np.cumsum(sizes) - sizes, np.zeros(len(pieces), np.int64), [], 0
        for live, places in _levels(first, sizes):
            keys, child = np.unique(node[live] << CHAR_BITS | codes[places], return_inverse=True)
            edges.append(keys)
            node[live] = child + total + 1
            total += len(keys)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.piece, self.logp = np.full(total + 1, -1, np.int64), np.full(total + 1, -np.inf)
        self.piece[node], self.logp[node] = np.arange(len(pieces)), logp
        self.piece[0], self.logp[0] = -1, -np.inf

    def step(self, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes along characters, 0 where there is none."""
        if not len(self.edges):
            return np.zeros(len(node), np.int64)
        keys = node << CHAR_BITS | codes
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where(self.edges[at] == keys, at + 1, 0)


class Lattice:
    """Arcs of all words: boundaries ``start`` and ``end``, trie node (0: unknown character), score.

    Boundaries of word w are ``base[w]`` to ``last[w]``.  ``whole=False`` leaves out the arcs
    over a whole word of two characters or more; ``unknown`` adds single characters without a
    piece at that cost.
    """

    def __init__(self, words: list[str], trie: Trie, whole: bool = True, unknown: float | None = None):
        codes, sizes = code_points(words), np.fromiter(map(len, words), np.int64, len(words))
        word, first = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
        self.base = first + np.arange(len(words))
        self.last, self.size = self.base + sizes, len(codes) + len(words)
        at, left = np.arange(len(codes)), sizes[word] - (np.arange(len(codes)) - first[word])
        live, node, length, found = at, np.zeros(len(codes), np.int64), 0, []
        while len(live):
            node = trie.step(node, codes[live + length])
            length += 1
            on = trie.piece[node] >= 0
            if length == 1 and unknown is not None:
                on = np.ones(len(live), bool)
            found.append((live[on], np.full(on.sum(), length), node[on] * (trie.piece[node[on]] >= 0)))
            go = (node > 0) & (left[live] > length)
            live, node = live[go], node[go]
        pos, length, node = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        if not whole:
            keep = (length < sizes[word[pos]]) | (length < 2)
            pos, length, node = pos[keep], length[keep], node[keep]
        self.word, self.node = word[pos], node
        self.start = pos + self.word
        self.end = self.start + length
        self.logp = np.where(node > 0, trie.logp[node], -np.inf if unknown is None else unknown)

    def _steps(self, side: np.ndarray, backwards: bool):
        """Arcs in groups of equal distance of ``side`` from the word's beginning or end, sorted by ``side``."""
        far = self.last[self.word] - side if backwards else side - self.base[self.word]
        order = np.lexsort((self.start, side, far))
        cuts = np.flatnonzero(np.diff(far[order])) + 1
        for arcs in np.split(order, cuts) if len(order) else ():
            yield arcs, np.flatnonzero(np.diff(side[arcs], prepend=-1))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the sums over all paths up to, and from, every boundary."""
        ahead, back = np.full(self.size, -np.inf), np.full(self.size, -np.inf)
        ahead[self.base], back[self.last] = 0.0, 0.0
        for arcs, cut in self._steps(self.end, False):
            ahead[self.end[arcs[cut]]] = np.logaddexp.reduceat(ahead[self.start[arcs]] + self.logp[arcs], cut)
        for arcs, cut in self._steps(self.start, True):
            back[self.start[arcs[cut]]] = np.logaddexp.reduceat(back[self.end[arcs]] + self.logp[arcs], cut)
        return ahead, back

    def expected(self, weight: np.ndarray, nodes: int) -> tuple[np.ndarray, float]:
        """Expected uses of every node, and the log likelihood, of words that count ``weight`` times."""
        ahead, back = self.sums()
        total = ahead[self.last]
        known = np.isfinite(total)
        arcs = np.flatnonzero(known[self.word])
        path = ahead[self.start[arcs]] + self.logp[arcs] + back[self.end[arcs]] - total[self.word[arcs]]
        uses = np.bincount(self.node[arcs], np.exp(path) * weight[self.word[arcs]], nodes)
        return uses, float((total[known] * weight[known]).sum())

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Best score up to every boundary and the boundary before it; the longest last piece wins a tie."""
        score, before = np.full(self.size, -np.inf), np.full(self.size, -1, np.int64)
        score[self.base] = 0.0
        for arcs, cut in self._steps(self.end, False):
            reach = score[self.start[arcs]] + self.logp[arcs]
            top = np.maximum.reduceat(reach, cut)
            group = np.cumsum(np.isin(np.arange(len(arcs)), cut)) - 1
            hit = np.flatnonzero((reach == top[group]) & np.isfinite(reach))
            ends, one = np.unique(self.end[arcs[hit]], return_index=True)  # first: the smallest start
            before[ends] = self.start[arcs[hit[one]]]
            score[self.end[arcs[cut]]] = top
        return score, before


def batches(words: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``limit`` characters, one word at least."""
    lo, held = 0, 0
    for k, w in enumerate(words):
        if held and held + len(w) > limit:
            yield lo, k
            lo, held = k, 0
        held += len(w) + 1
    if held:
        yield lo, len(words)


def segment(words: list[str], trie: Trie) -> list[list[str]]:
    """Best segmentation of every word; a character without a piece stands alone at a high cost."""
    out: list[list[str]] = []
    for lo, hi in batches(words):
        part = words[lo:hi]
        lattice = Lattice(part, trie, unknown=UNKNOWN_COST)
        before = lattice.best()[1].tolist()
        for w, base, at in zip(part, lattice.base.tolist(), lattice.last.tolist(), strict=True):
            pieces = []
            while at > base:
                pieces.append(w[before[at] - base:at - base])
                at = before[at]
            out.append(pieces[::-1])
    return out


_held: tuple[str, Trie] | None = None


def load(path: str) -> Trie:
    """The trie of a stored model; a worker keeps the last one it read."""
    global _held
    if _held is None or _held[0] != path:
        _held = None
        files, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        table = pq.read_table(place, columns=["piece", "logp"], filesystem=files).combine_chunks()
        _held = path, Trie(table["piece"].to_pylist(), table["logp"].to_numpy())
    return _held[1]


def repeats(suffixes: list[str], counts: np.ndarray, least: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Prefixes shared by a run of sorted distinct suffixes, with their summed counts.

    Adjacent suffixes give the longest common prefixes; for every length the runs between
    shorter ones are its intervals.  Yields (pieces, counts, open): an open interval touches
    an end of the run and may go on beyond it; the others are complete and come only if they
    count ``least`` or have one character.
    """
    n, sizes = len(suffixes), np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    width = int(sizes.max())
    codes = np.array(suffixes, f"<U{width}").view(np.uint32).reshape(n, width)
    same = codes[1:] == codes[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    for length in range(1, width + 1):
        first = np.flatnonzero(np.concatenate(([True], common < length)))
        total = np.add.reduceat(counts, first)
        is_open = np.zeros(len(first), bool)
        is_open[[0, -1]] = True
        keep = (sizes[first] >= length) & (is_open | (total >= least) | (length == 1))
        yield [suffixes[k][:length] for k in first[keep].tolist()], total[keep], is_open[keep]
