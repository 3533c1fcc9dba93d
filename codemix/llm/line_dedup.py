"""Line dedup: two Bloom filters pick suspected repeats, an exact count confirms them.

1. Every partition hashes its lines and notes the filter bits hit once and hit
   twice or more; the notes are merged per chunk of the filter, in two levels, to
   a once-seen and a twice-seen filter.  A key that occurs in two documents hits
   both of its bits twice, so the twice-seen filter misses no repeat.
2. Lines whose bits are all in the twice-seen filter are suspects.  Only their
   128-bit key hashes are shuffled, to count documents exactly and to choose the
   first occurrence.
3. Positions to drop go back to their document.

The filter takes ``bits_per_line`` bits a line between ``MIN_BITS`` and
``MAX_BITS``.  The upper bound also bounds the broadcast; beyond it the filter
fills up and more lines are suspects, but the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codemix.llm.common import row_slices, text_buffer, thin
from codemix.session import stored

BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
CHUNK = 1 << 20
SALTS, JOIN_SALTS = 32, 16
BLANK = b" \t\n\x0b\x0c\r"

_NOTES = "chunk int, salt int, once binary, twice binary"
_CUT = "kept string, n_lines bigint, n_dropped bigint"
_SUSPECTS = "doc_id bigint, mark bigint, hi bigint, lo bigint, at array<int>"


def _keys(text: str | None) -> list[bytes]:
    """Keys of all lines: stripped, A-Z lower-cased."""
    return [line.strip(BLANK) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _bits(digests: list[int], size: int) -> np.ndarray:
    """The two filter bits of each 128-bit digest, one row per digest."""
    low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64)
    mask = np.uint64(size - 1)
    return np.stack([low & mask, (low >> np.uint64(32)) & mask], 1).astype(np.int64)


def _note(size: int):
    """Per partition: the bits hit once, and twice or more, by distinct keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        hit = []
        for batch in thin(batches, "text"):
            digests: list[int] = []
            for text in batch.column(0):
                digests.extend(xxhash.xxh3_128_intdigest(k) for k in set(_keys(text.as_py())) if k)
            if digests:
                found = _bits(digests, size)
                hit.append(np.concatenate([found[:, 0], found[found[:, 0] != found[:, 1], 1]]))
        if not hit:
            return
        at, times = np.unique(np.concatenate(hit), return_counts=True)
        cuts = np.flatnonzero(np.diff(at // CHUNK)) + 1
        for part, n in zip(np.split(at, cuts), np.split(times, cuts), strict=True):
            low = (part % CHUNK).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([int(part[0]) // CHUNK], pa.int32()), "salt": pa.array([salt], pa.int32()),
                "once": pa.array([low[n == 1].tobytes()], pa.binary()),
                "twice": pa.array([low[n > 1].tobytes()], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge notes that arrive sorted by (chunk, salt); one chunk is in memory at a time."""
    now, hits = None, np.zeros(CHUNK, np.uint8)

    def close():
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([now[0]], pa.int32()), "salt": pa.array([now[1]], pa.int32()),
            "once": pa.array([np.flatnonzero(hits == 1).astype(np.uint32).tobytes()], pa.binary()),
            "twice": pa.array([np.flatnonzero(hits > 1).astype(np.uint32).tobytes()], pa.binary())})

    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["chunk"], row["salt"]):
                if now is not None:
                    yield close()
                now = (row["chunk"], row["salt"])
                hits[:] = 0
            once, twice = (np.frombuffer(row[k], np.uint32) for k in ("once", "twice"))
            hits[once] = np.minimum(hits[once] + 1, 2)
            hits[twice] = 2
    if now is not None:
        yield close()


def twice_seen(docs: DataFrame, size: int) -> np.ndarray:
    """The twice-seen filter as packed bits; at most ``MAX_BITS / 8`` bytes."""
    notes = docs.select("text").mapInArrow(_note(size), _NOTES)
    for salt in (F.col("salt"), F.lit(0)):
        notes = (notes.withColumn("salt", salt).repartition("chunk", "salt")
                 .sortWithinPartitions("chunk", "salt").mapInArrow(_merge, _NOTES))
    bits = np.zeros(size // 8, np.uint8)
    for row in notes.select("chunk", "twice").toLocalIterator():
        flags = np.zeros(CHUNK, bool)
        flags[np.frombuffer(row["twice"], np.uint32)] = True
        start = row["chunk"] * CHUNK // 8
        bits[start:start + CHUNK // 8] = np.packbits(flags, bitorder="little")
    return bits


def _suspects(filter_, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in thin(batches, "text"):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "mark", "hi", "lo", "at")}
            owners, digests, places = [], [], []
            for i, text in enumerate(batch.column("text")):
                at: dict[bytes, list[int]] = {}
                for pos, key in enumerate(_keys(text.as_py())):
                    if key:
                        at.setdefault(key, []).append(pos)
                owners.extend([i] * len(at))
                digests.extend(map(xxhash.xxh3_128_intdigest, at))
                places.extend(at.values())
            if not digests:
                continue
            spots = _bits(digests, size)
            known = ((bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(1)
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
            for k in np.flatnonzero(known):
                owner, digest = owners[k], digests[k].to_bytes(16, "big")
                rows["doc_id"].append(ids[owner])
                rows["mark"].append(marks[owner])
                rows["hi"].append(int.from_bytes(digest[:8], "big", signed=True))
                rows["lo"].append(int.from_bytes(digest[8:], "big", signed=True))
                rows["at"].append(places[k])
            yield pa.RecordBatch.from_pydict({
                k: pa.array(v, pa.list_(pa.int32()) if k == "at" else pa.int64()) for k, v in rows.items()})

    return run


def _without(texts: pa.Array, drops: pa.Array) -> pa.Array:
    cuts = list(row_slices(text_buffer(texts)[1], 4 << 20))
    if len(cuts) > 1:
        return pa.concat_arrays([_without(texts.slice(a, b - a), drops.slice(a, b - a)) for a, b in cuts])
    kept, lines, dropped = [], [], []
    for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
        parts = (text or "").split("\n")
        gone = set(drop or ())
        kept.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else text or "")
        lines.append(len(parts))
        dropped.append(len(gone))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
        ["kept", "n_lines", "n_dropped"])


def _mark(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = False,
                bits_per_line: int = BITS_PER_LINE) -> DataFrame:
    """Drop lines whose key occurs in at least ``min_docs`` documents.

    ``docs`` needs doc_id and text; other columns pass through.  Returns all
    columns with ``text`` reduced, plus ``n_lines`` (before) and ``n_dropped``;
    columns of these names are replaced.  With ``keep_first`` a key keeps its
    lines in the first document, by (doc_id, place).

    Every row is a document: repeated rows count each for itself, and rows that
    share doc_id and text are treated alike.  Null or empty text is one empty
    line; empty keys are never dropped.  A null doc_id is an id like any other.
    An empty table gives an empty table.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lines = ids.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = MIN_BITS
    while size < min(bits_per_line * lines, MAX_BITS):
        size *= 2
    filter_ = docs.sparkSession.sparkContext.broadcast(twice_seen(ids, size))
    suspects = stored(ids.select("doc_id", F.xxhash64("text").alias("mark"), "text")
                            .mapInArrow(_suspects(filter_, size), _SUSPECTS))
    common = (suspects.groupBy("hi", "lo")
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", F.col("at")[0], "mark")).alias("first"))
              .filter(F.col("n") >= min_docs))
    # a line that every third document holds is one key: its suspects are spread over salts
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    drops = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(JOIN_SALTS)).cast("int")).join(
        common, ["hi", "lo", "salt"])
    if keep_first:
        drops = drops.filter(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
                               & F.col("first.mark").eqNullSafe(F.col("mark"))))
    drops = (drops.groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("at")).alias("at"))
             .select(F.col("doc_id").alias("_ld_id"), F.col("mark").alias("_ld_mark"), F.col("at").alias("_ld_at")))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_ld_id"]) & _mark(docs).eqNullSafe(drops["_ld_mark"]),
                       "left")
    without = F.arrow_udf(_without, _CUT)
    cut = joined.withColumn("_ld", without(docs["text"], drops["_ld_at"]))
    out = {c: docs[c] for c in rest} | {"text": F.col("_ld.kept")}
    return cut.select(*[out[c].alias(c) for c in docs.columns if c in out],
                      F.col("_ld.n_lines").alias("n_lines"), F.col("_ld.n_dropped").alias("n_dropped"))
