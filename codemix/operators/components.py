"""Phrase extraction over Arrow batches.

The phrases of a sentence pair are the connected components of its alignment
graph.  All pairs of a batch form one big graph; numpy labels it at once, so
the cost per edge is a few array operations.  (As built-in array lambdas the
same step took about ten times longer.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

from codemix.functions.digests import md5_words

PHRASES = "array<array<struct<s:array<int>,t:array<int>>>>"
QUEUED = "array<struct<phrases:array<struct<s:array<int>,t:array<int>>>,queue:array<bigint>>>"
EDGE_PARTS = r"^(?P<s>[0-9]{1,9})-(?P<t>[0-9]{1,9})$"
SHIFT = 31
MAX_BYTES = 16 << 20
LOW = (1 << SHIFT) - 1


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting beats hashing here)."""
    values = np.sort(values)
    return values[_group_starts(values)]


def component_labels(n_nodes: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of the component of every node, for undirected links (u, v).

    Roots of linked components are hooked to the smaller root and paths are
    halved until they are flat; the number of rounds is logarithmic in practice.
    """
    lab = np.arange(n_nodes, dtype=np.int64)
    while len(u):
        a, b = lab[u], lab[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        nxt = lab[lab]
        while not np.array_equal(nxt, lab):
            lab, nxt = nxt, nxt[nxt]
    return lab


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else \
        np.empty(0, dtype=np.int64)


def edge_numbers(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the texts are edges ``s-t`` of one to nine digits a side, and the two numbers of those.

    Read from the bytes at once if every text is an edge, else by the pattern.
    """
    tokens = tokens.cast(pa.string())
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1] if len(tokens) else \
        np.zeros(1, np.int32)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] - np.uint8(ord("0"))
    other = np.flatnonzero(data > 9)
    if len(other) == len(tokens) and not tokens.null_count and (data[other] == np.uint8(ord("-") - ord("0") & 255)).all():
        lo, hi = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        before, after = other - lo, hi - other - 1
        if len(tokens) and min(before.min(), after.min()) > 0 and max(before.max(), after.max()) <= 9:
            return np.ones(len(tokens), bool), _number(data, other, before), _number(data, hi, after)
    parts = pc.extract_regex(tokens, pattern=EDGE_PARTS)
    good = parts.is_valid()
    parts = parts.filter(good)
    s, t = (pc.cast(parts.field(k), pa.int64()).to_numpy(zero_copy_only=False) for k in (0, 1))
    return good.to_numpy(zero_copy_only=False), s, t


def _number(digits: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers whose ``size`` digits stand before ``end``."""
    out, scale = digits[end - 1].astype(np.int64), 1
    for k in range(1, int(size.max())):
        scale *= 10
        more = np.flatnonzero(size > k)
        out[more] += digits[end[more] - 1 - k].astype(np.int64) * scale
    return out


def _edges(texts: pa.Array, n_src: np.ndarray, n_tgt: np.ndarray, base: np.ndarray):
    """Distinct in-range edges as (source node, target index), sorted; others are dropped."""
    tokens = pc.ascii_split_whitespace(texts)
    owner = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    good, s, t = edge_numbers(tokens.flatten())
    owner = owner[good]
    inside = (s < n_src[owner]) & (t < n_tgt[owner])
    codes = _distinct(((base[owner] + s)[inside] << SHIFT) | t[inside])
    return codes >> SHIFT, codes & LOW


def _slices(alignments: pa.Array):
    """Row ranges of a batch with about MAX_BYTES of alignment text, so that numpy
    temporaries stay small when rows are very long."""
    per_row = lengths(alignments)
    size = pc.fill_null(pc.binary_length(alignments.flatten()), 0).to_numpy(zero_copy_only=False)
    upto = starts(size)[starts(per_row)]
    start, n = 0, len(per_row)
    while start < n:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + MAX_BYTES, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def _queue(seed: int, row_id: pa.Array, lang: pa.Array, owner: np.ndarray, first: np.ndarray,
           place: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Codes (draw, position) of phrases, sorted within their candidates, and the number of each candidate's."""
    tag = pc.binary_join_element_wise("phrase", lang, ":")  # null where the language is
    at = pa.array(owner)
    draws = md5_words(pc.binary_join_element_wise(
        str(seed), row_id.take(at), pa.array(first).cast(pa.string()), tag.take(at), ":", null_handling="skip"))[0]
    codes = (draws >> np.uint32(1)).astype(np.int64) << SHIFT | place
    return pa.array(codes[np.lexsort((codes, owner))]), np.bincount(owner, minlength=len(row_id))


def phrase_udf(one_to_one: bool = False, contiguous_only: bool = False, seed: int | None = None):
    """UDF (alignments, target lengths, alpha flags) -> phrases of every candidate.

    The first two arrays run over the candidates of a row, ``alpha`` over its
    source words.  A phrase needs an all-letter source word; phrases come in the
    order of their first source word.  With a ``seed`` the UDF takes (…, closed flags, row id
    as text, languages) as well and gives every candidate's ``phrases`` and their ``queue``: sorted
    codes (draw, position) of the phrases without a closed word.
    """

    def extract(alignments: pa.Array, n_tgt: pa.Array, alpha: pa.Array, *more: pa.Array) -> pa.Array:
        per_row, n_words = lengths(alignments), lengths(alpha)
        row_of = np.repeat(np.arange(len(per_row)), per_row)
        n_src = n_words[row_of]
        base = starts(n_src)
        letters = alpha.flatten().to_numpy(zero_copy_only=False).astype(bool)
        letters_from = starts(n_words)
        node, t = _edges(pc.fill_null(alignments.flatten(), ""), n_src,
                         n_tgt.flatten().to_numpy(zero_copy_only=False), base)
        owner_of = lambda x: np.searchsorted(base[:-1], x, side="right") - 1

        by_target = np.lexsort((node, t, owner_of(node)))
        p, q = by_target[:-1], by_target[1:]
        shared = (t[p] == t[q]) & (owner_of(node[p]) == owner_of(node[q]))
        lab = component_labels(int(base[-1]), node[p][shared], node[q][shared])

        words = _distinct(node)
        words = words[np.argsort(lab[words], kind="stable")]
        s_from = _group_starts(lab[words])
        targets = _distinct((lab[node] << SHIFT) | t)
        t_from = _group_starts(targets >> SHIFT)
        word_owner = owner_of(words)
        s_idx = words - base[word_owner]

        s_bounds, t_bounds = np.append(s_from, len(words)), np.append(t_from, len(targets))
        if len(s_from):
            keep = np.logical_or.reduceat(letters[letters_from[row_of[word_owner]] + s_idx], s_from)
            size = np.diff(s_bounds)
            if one_to_one:
                keep &= (size == 1) & (np.diff(t_bounds) == 1)
            if contiguous_only:
                keep &= s_idx[s_bounds[1:] - 1] - s_idx[s_from] + 1 == size
            phrase_owner = word_owner[s_from]
        else:
            keep, phrase_owner = np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)

        lists = [pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(v, pa.int32()))
                 for b, v in ((s_bounds, s_idx), (t_bounds, targets & LOW))]
        phrases = pa.StructArray.from_arrays(lists, names=["s", "t"]).filter(pa.array(keep, pa.bool_()))
        per_cand = np.bincount(phrase_owner[keep], minlength=len(row_of))
        inner = pa.ListArray.from_arrays(pa.array(starts(per_cand), pa.int32()), phrases)
        if seed is not None:
            queue = pa.array(np.empty(0, np.int64)), np.zeros(len(row_of), np.int64)
            if len(s_from):
                shut = more[0].flatten().to_numpy(zero_copy_only=False).astype(bool)
                free = ~np.logical_or.reduceat(shut[letters_from[row_of[word_owner]] + s_idx], s_from)[keep]
                place = np.arange(len(free)) - starts(per_cand)[phrase_owner[keep]]
                queue = _queue(seed, more[1].take(pa.array(row_of)), more[2].flatten(), phrase_owner[keep][free],
                               s_idx[s_from][keep][free], place[free])
            inner = pa.StructArray.from_arrays(
                [inner, pa.ListArray.from_arrays(pa.array(starts(queue[1]), pa.int32()), queue[0])], names=["phrases", "queue"])
        return pa.ListArray.from_arrays(pa.array(starts(per_row), pa.int32()), inner)

    def sliced(*columns: pa.Array) -> pa.Array:
        parts = [extract(*(c.slice(lo, hi - lo) for c in columns)) for lo, hi in _slices(columns[0])]
        return pa.concat_arrays(parts) if parts else extract(*columns)

    if seed is None:
        @arrow_udf(PHRASES)
        def run(alignments: pa.Array, n_tgt: pa.Array, alpha: pa.Array) -> pa.Array:
            return sliced(alignments, n_tgt, alpha)
    else:
        @arrow_udf(QUEUED)
        def run(alignments: pa.Array, n_tgt: pa.Array, alpha: pa.Array, closed: pa.Array, row_id: pa.Array,
                langs: pa.Array) -> pa.Array:
            return sliced(alignments, n_tgt, alpha, closed, row_id, langs)

    # A pure function, marked so that the optimizer neither copies the call into
    # several expressions nor moves a filter on its result below it.
    return run.asNondeterministic()


def _dropped(alignments: pa.Array, n_src: np.ndarray, n_tgt: np.ndarray) -> np.ndarray:
    tokens = pc.ascii_split_whitespace(alignments)
    owner = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    flat = tokens.flatten()
    good, s, t = edge_numbers(flat)
    bad = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bad[good] = (s >= n_src[owner[good]]) | (t >= n_tgt[owner[good]])
    return np.bincount(owner[bad], minlength=len(alignments))


def dropped_udf():
    """UDF (alignment, source and target length) -> number of malformed and out-of-range edges."""

    @arrow_udf("int")
    def run(alignments: pa.Array, n_src: pa.Array, n_tgt: pa.Array) -> pa.Array:
        sizes = [pc.fill_null(n, 0).to_numpy(zero_copy_only=False) for n in (n_src, n_tgt)]
        alignments = pc.fill_null(alignments, "")
        upto = starts(pc.binary_length(alignments).to_numpy(zero_copy_only=False).astype(np.int64))
        out, lo = [np.empty(0, np.int64)], 0
        while lo < len(alignments):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + MAX_BYTES, side="right")) - 1)
            out.append(_dropped(alignments[lo:hi], sizes[0][lo:hi], sizes[1][lo:hi]))
            lo = hi
        return pa.array(np.concatenate(out), pa.int32())

    return run.asNondeterministic()  # marked like the one above


def _parsed(alignments: pa.Array) -> pa.Array:
    tokens = pc.ascii_split_whitespace(alignments)
    owner, flat = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False), tokens.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not some.all():  # blanks at the ends, or no text at all
        owner, flat = owner[some], flat.filter(pa.array(some))
    good, s, t = edge_numbers(flat)
    owner, codes = owner[good], s << SHIFT | t
    same = owner[1:] == owner[:-1]
    if (same & (codes[1:] <= codes[:-1])).any():
        order = np.lexsort((codes, owner))
        owner, codes = owner[order], codes[order]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])))
        owner, codes = owner[first], codes[first]
    edges = pa.StructArray.from_arrays(
        [pa.array(codes >> SHIFT, pa.int32()), pa.array(codes & LOW, pa.int32())], names=["s", "t"])
    upto = pa.array(starts(np.bincount(owner, minlength=len(alignments))), pa.int32())
    return pa.ListArray.from_arrays(upto, edges, mask=alignments.is_null())


def parse_udf():
    """UDF (alignment) -> sorted distinct edges; malformed ones are dropped."""

    @arrow_udf("array<struct<s:int,t:int>>")
    def run(alignments: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(alignments), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, parts, lo = starts(size), [], 0
        while lo < len(alignments):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + MAX_BYTES, side="right")) - 1)
            parts.append(_parsed(alignments[lo:hi]))
            lo = hi
        return pa.concat_arrays(parts) if parts else _parsed(alignments)

    return run.asNondeterministic()  # marked like the ones above


def edge_sums_udf():
    """UDF (edges) -> their number and the sums of both sides."""

    @arrow_udf("struct<n:bigint,s:bigint,t:bigint>")
    def run(edges: pa.Array) -> pa.Array:
        n, flat = lengths(edges), edges.flatten()
        upto = starts(n)
        total = lambda k: np.diff(starts(pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(np.int64))[upto])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total(0)), pa.array(total(1))], names=["n", "s", "t"])

    return run.asNondeterministic()
