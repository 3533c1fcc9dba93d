"""Bloom filters over 64-bit keys of a table, of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codemix.session import discard, stored

BITS_PER_KEY, PROBES = 16, 3
#: Sizes are powers of two; the larger one bounds the broadcast to 64 MB.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
CHUNK_BITS = 20
#: Bits that come to the driver in one job.
JOB_BITS = 1 << 26


def size_for(keys: int) -> int:
    size = MIN_BITS
    while size < min(BITS_PER_KEY * keys, MAX_BITS):
        size *= 2
    return size


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the filter from places that arrive sorted by chunk."""
    now, flags = None, np.zeros(1 << CHUNK_BITS, bool)

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([now], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        at = batch.column("at").to_numpy()
        chunk = at >> CHUNK_BITS
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(chunk)) + 1):
            if not len(part):
                continue
            if now != chunk[part[0]]:
                if now is not None:
                    yield close()
                now, flags[:] = int(chunk[part[0]]), False
            flags[at[part] & ((1 << CHUNK_BITS) - 1)] = True
    if now is not None:
        yield close()


def build(keys: DataFrame, column: str = "key", distinct: bool = False) -> np.ndarray:
    """The filter of a bigint column as packed bits; at most ``MAX_BITS / 8`` bytes reach the driver.

    Places are shuffled by chunk, so a task holds one chunk at a time.  The chunks are stored and
    come to the driver in jobs of ``JOB_BITS``, not in one per shuffle partition.  With more keys than
    the largest filter has room for, more foreign keys seem known; no key is ever missed.
    Keys known to be ``distinct`` spare the exchange that removes repeated places.
    """
    size = size_for(keys.count())
    low, high = F.col(column).bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(column, 32)
    spots = F.array(*[(low + high * k).bitwiseAND(F.lit(size - 1)) for k in range(PROBES)])
    places = keys.select(F.explode(spots).alias("at"))
    places = (places if distinct else places.distinct()).withColumn("chunk", F.shiftright("at", CHUNK_BITS))
    bits = np.zeros(size // 8, np.uint8)
    step = (1 << CHUNK_BITS) // 8
    rows = stored(places.repartition("chunk").sortWithinPartitions("chunk").select("at")
                  .mapInArrow(_bits, "chunk bigint, bits binary"), "bits")
    for row in rows.coalesce(-(-size // JOB_BITS)).toLocalIterator():
        bits[row["chunk"] * step:(row["chunk"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    discard(rows)
    return bits


def known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether unsigned 64-bit keys may be in the filter."""
    mask = np.uint64(len(bits) * 8 - 1)
    low, high = keys & np.uint64((1 << 31) - 1), keys >> np.uint64(32)
    out = np.ones(len(keys), bool)
    for k in range(PROBES):
        at = (low + high * np.uint64(k)) & mask
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
