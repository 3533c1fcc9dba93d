"""Word counts of many texts at once, over Arrow arrays: the words of ``text.py`` inside a batch."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from codemix.functions.text import BLANK_CHARS

SLICE_BYTES = 16 << 20  # of the texts worked on at a time
SPACES = "[" + "".join(map(re.escape, BLANK_CHARS)) + "]+"
#: Per byte: is it a blank of its own; may it begin a blank of several bytes.
ONE_BYTE = np.isin(np.arange(256), [ord(c) for c in BLANK_CHARS if ord(c) < 128])
LEADS = np.isin(np.arange(256), [c.encode()[0] for c in BLANK_CHARS if ord(c) >= 128])


def in_slices(sizes: np.ndarray, limit: int, work: Callable[[int, int], object]) -> list:
    """Results of ``work(lo, hi)`` over ranges of rows of about ``limit`` in all, one row at least."""
    upto, out, lo = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + limit, side="right")) - 1)
        out.append(work(lo, hi))
        lo = hi
    return out


def _counts(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    blank = ONE_BYTE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = ~blank[begin]
    out = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    wide = np.unique(np.searchsorted(offsets, np.flatnonzero(LEADS[data]), side="right") - 1)
    if len(wide):
        some = pc.utf8_trim(texts.take(pa.array(wide)), characters=BLANK_CHARS)
        n = pc.list_value_length(pc.split_pattern_regex(some, SPACES)).to_numpy(zero_copy_only=False)
        out[wide] = np.where(pc.equal(some, "").to_numpy(zero_copy_only=False), 0, n)
    return out


def count_words(texts: pa.Array) -> np.ndarray:
    """Numbers of words; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    parts = in_slices(sizes, SLICE_BYTES, lambda lo, hi: _counts(texts[lo:hi]))
    return np.concatenate(parts or [np.empty(0, np.int64)])


def n_words(text: Column) -> Column:
    """The size of ``words``, counted over Arrow batches; null for a null text."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_words(texts), pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return count.asNondeterministic()(text)  # a pure function, marked so that the optimizer does not copy the call
