"""Length order, token-budget batches, shards and length buckets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codemix.functions.draw import draw
from codemix.session import BROADCAST_BYTES, dense_order, fits_broadcast, stored

#: Rows that one task packs, maps joined by one task, and ranks that share a row of the table of batches.
CHUNK, FAN, BLOCK = 1 << 18, 64, 512


def _tie(row_id: str, shuffle: bool, seed: int) -> list[Column]:
    return ([draw(seed, F.col(row_id), 0, "length")] if shuffle else []) + [F.col(row_id)]


def _ranked(df: DataFrame, row_id: str, shuffle: bool, seed: int) -> DataFrame:
    """Id, lengths and rank: only keys are sorted and stored.

    The keys are stored before, too: the range exchange reads its input twice, and lengths are costly.
    """
    keys = stored(df.select(row_id, "src_len", "tgt_len", *[t.alias("_tie") for t in _tie(row_id, shuffle, seed)[:-1]]), "lengths")
    return dense_order(keys, *[F.col(c) for c in keys.columns if c != row_id], F.col(row_id)).drop("_tie")


def _with_rest(df: DataFrame, numbered: DataFrame, row_id: str) -> DataFrame:
    """Other columns of the rows join their numbers by id; rows of keys alone need no join."""
    if set(df.columns) == {row_id, "src_len", "tgt_len"}:
        return numbered
    return df.join(numbered.drop("src_len", "tgt_len"), row_id)


def order_by_length(df: DataFrame, row_id: str = "ex_id", shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Dense 0-based ``rank`` by source length, then target length; ties random or by id.

    Ties end in the unique id, so one very frequent length is split over
    partitions by the range exchange.  Wide rows are neither sorted nor stored.
    """
    return _with_rest(df, _ranked(df, row_id, shuffle, seed), row_id)


def next_starts(sizes: np.ndarray, n: int, max_tokens: int, max_sentences: int, multiple: int) -> np.ndarray:
    """Where the batch that begins at each of the first ``n`` rows ends, by the greedy rule.

    A batch closes when one more row would break the token budget (rows x longest) or the row
    limit, and is cut down to a multiple; its rest begins the next one.  So the end depends on
    the beginning alone.  Maxima over powers of two rows give all ends at once, by bisection.
    """
    tops, count, longest = [sizes], np.zeros(n, np.int64), np.zeros(n, np.int64)
    while 2 << len(tops) - 1 <= min(max_tokens, max_sentences, len(sizes)):
        half = 1 << len(tops) - 1
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    at = np.arange(n)
    for k in reversed(range(len(tops))):
        more, place = count + (1 << k), at + count
        inside = place < len(tops[k])
        top = np.maximum(longest, tops[k][np.minimum(place, len(tops[k]) - 1)])
        ok = inside & (more * top <= max_tokens) & (more <= max_sentences)
        count, longest = np.where(ok, more, count), np.where(ok, top, longest)
    return at + np.maximum(multiple * (count // multiple), count % multiple)


def chunk_exits(following: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """For a batch that begins at each of the first rows: the first beginning past the chunk, batches until there."""
    n, target, steps = len(following), following.copy(), np.ones(len(following), np.int64)
    while (inside := np.flatnonzero(target < n)).size:
        on = target[inside]
        steps[inside] += steps[on]
        target[inside] = target[on]
    return target[:entries] - n, steps[:entries]


def _then(exits: np.ndarray, steps: np.ndarray, following) -> tuple[np.ndarray, np.ndarray]:
    """Two chunks as one: entries of the second that lie past the corpus end there."""
    known = exits < len(following["exits"])
    at = np.where(known, exits, 0)
    return (np.where(known, np.asarray(following["exits"])[at], 0),
            steps + np.where(known, np.asarray(following["steps"])[at], 0))


MAPS = "node bigint, exits array<bigint>, steps array<bigint>"
ENTRIES = "node bigint, at bigint, batch bigint"


def _joined_maps(maps: pd.DataFrame) -> pd.DataFrame:
    """One map of consecutive ones."""
    rows = maps.sort_values("node").to_dict("records")
    exits, steps = np.asarray(rows[0]["exits"]), np.asarray(rows[0]["steps"])
    for row in rows[1:]:
        exits, steps = _then(exits, steps, row)
    return pd.DataFrame({"node": [rows[0]["up"]], "exits": [exits], "steps": [steps]})


def _entered(maps: pd.DataFrame) -> pd.DataFrame:
    """Where the batches enter each of consecutive chunks; ``at, batch`` hold the entry of the first."""
    rows, out = maps.sort_values("node").to_dict("records"), []
    at, batch = np.array([rows[0]["at"]]), np.array([rows[0]["batch"]])
    for row in rows:
        out.append((row["node"], at[0], batch[0]))
        at, batch = _then(at, batch, row)
    return pd.DataFrame(out, columns=["node", "at", "batch"])


def pack_batches(df: DataFrame, max_tokens: int = 4000, max_sentences: int = 1 << 30, multiple: int = 1,
                 row_id: str = "ex_id", shuffle: bool = False, seed: int = 0, chunk: int = CHUNK,
                 fan: int = FAN, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Greedy token-budget batches over the length order: adds ``rank`` and ``batch_no``.

    The result is that of one pass over the whole order; a row counts one token at least.
    Chunks of ``chunk`` rows (at least a batch) are packed in parallel from the run-length histogram: each finds,
    for every row at which the open batch may enter it, where the batches leave it and how
    many they are.  These maps are joined pairwise in a tree (a parallel prefix), which
    gives every chunk its real entry; then the chunks cut their batches.  Rows find theirs by blocks of ranks.
    """
    window = min(max_tokens, max_sentences)
    chunk = max(chunk, window)
    ranked = _ranked(df, row_id, shuffle, seed)
    hist = stored(ranked.groupBy(F.greatest("src_len", "tgt_len").alias("size"), "src_len", "tgt_len")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
                  .select("first", (F.col("first") + F.col("n")).alias("upto"), F.greatest("size", F.lit(1)).alias("size")), "runs")
    total, widest = hist.agg(F.max("upto"), F.max("size")).first()
    if widest is not None and widest > max_tokens:
        raise ValueError(f"a row of size {widest} exceeds the budget of {max_tokens}")
    touched = F.sequence(F.greatest(F.floor((F.col("first") - window) / chunk), F.lit(0)), F.floor((F.col("upto") - 1) / chunk))
    begin = F.col("node") * chunk
    runs = (hist.withColumn("node", F.explode(touched))
            .select("node", F.greatest("first", begin).alias("first"), F.least("upto", begin + chunk + window).alias("upto"), "size")
            .filter("first < upto"))

    def ends(rows: pd.DataFrame) -> np.ndarray:
        rows = rows.sort_values("first")
        sizes = np.repeat(rows["size"].to_numpy(np.int64), (rows["upto"] - rows["first"]).to_numpy())
        return next_starts(sizes, min(chunk, len(sizes)), max_tokens, max_sentences, multiple)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        exits, steps = chunk_exits(ends(rows), window)
        return pd.DataFrame({"node": [rows["node"].iloc[0]], "exits": [exits], "steps": [steps]})

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        following, base, at = ends(rows).tolist(), int(rows["node"].iloc[0]) * chunk, int(rows["at"].iloc[0])
        batch, out = int(rows["batch"].iloc[0]), []
        while at < len(following):
            lo, per, first = at, following[at] - at, batch
            while at < len(following) and following[at] - at == per:
                at, batch = following[at], batch + 1
            for block in range((base + lo) // BLOCK, (base + at - 1) // BLOCK + 1):
                out.append((block, max(base + lo, block * BLOCK), min(base + at, (block + 1) * BLOCK), first, base + lo, per))
        return pd.DataFrame(out, columns=["block", "a", "b", "batch", "lo", "per"])

    entries = df.sparkSession.createDataFrame([(0, 0, 0)], ENTRIES)
    nodes = -(-(total or 0) // chunk)
    if nodes > 1:
        levels = [stored(runs.groupBy("node").applyInPandas(solve, MAPS), "chunk-maps")]
        up = F.floor(F.col("node") / fan).alias("up")
        while (nodes := -(-nodes // fan)) > 1:
            levels.append(stored(levels[-1].select("*", up).groupBy("up").applyInPandas(_joined_maps, MAPS), "chunk-maps"))
        for maps in reversed(levels):
            below = maps.select("*", up).join(entries.withColumnRenamed("node", "up"), "up")
            entries = below.groupBy("up").applyInPandas(_entered, ENTRIES)
        entries = stored(entries, "entries")
    segments = "block bigint, a bigint, b bigint, batch bigint, lo bigint, per bigint"
    table = stored(runs.join(entries, "node").groupBy("node").applyInPandas(cut, segments).groupBy("block")
                   .agg(F.collect_list(F.struct("a", "b", "batch", "lo", "per")).alias("segs")), "batches")
    seg = F.get(F.filter("segs", lambda s: (F.col("rank") >= s["a"]) & (F.col("rank") < s["b"])), F.lit(0))
    side = F.broadcast(table) if fits_broadcast(table, limit) else table
    numbered = (ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(side, "block").withColumn("seg", seg)
                .withColumn("batch_no", F.col("seg.batch") + F.floor((F.col("rank") - F.col("seg.lo")) / F.col("seg.per")))
                .drop("segs", "seg", "block"))
    return _with_rest(df, numbered, row_id)


def assign_shards(df: DataFrame, n: int, drop_remainder: bool = False, n_batches: int | None = None,
                  grouped_shuffle_seed: int | None = None) -> DataFrame:
    """Batch ``b`` goes to shard ``b mod n`` as its ``b div n``-th step.

    ``drop_remainder`` keeps only steps in which every shard has a batch;
    a grouped shuffle permutes whole steps (``order_key``).
    """
    out = df.withColumn("shard", F.pmod("batch_no", F.lit(n)).cast("int")).withColumn(
        "step", F.floor(F.col("batch_no") / n))
    if drop_remainder:
        if n_batches is None:
            last = df.agg(F.max("batch_no")).first()[0]
            n_batches = 0 if last is None else last + 1
        out = out.filter(F.col("step") < n_batches // n)
    if grouped_shuffle_seed is not None:
        out = out.withColumn("order_key", draw(grouped_shuffle_seed, F.col("step"), 0, "batch"))
    return out


def length_buckets(df: DataFrame, col: str, n: int) -> DataFrame:
    """Upper lengths of n buckets of equal share: exact percentiles from the length histogram.

    The k-th bound is the value at position floor((rows - 1) * k / n) of the
    sorted lengths.  The histogram has one row per distinct length.
    """
    hist = df.groupBy(F.col(col).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    by_len = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select("len", F.sum("n").over(by_len).alias("upto"),
                      F.sum("n").over(Window.partitionBy()).alias("total"), "n")
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.floor((F.col("total") - 1) * k / n)))
    return (cum.select("len", "upto", "n", at.alias("at"))
            .filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
            .select(F.col("len").alias("bound")).distinct())


def bucket_lengths(df: DataFrame, col: str, n: int) -> DataFrame:
    """Add ``bucket_len``: the smallest bucket bound that holds the row (at most n bounds)."""
    bounds = length_buckets(df, col, n).agg(F.sort_array(F.collect_list("bound")).alias("b")).first()["b"]
    case = F.lit(None).cast("int")
    for b in reversed(bounds):
        case = F.when(F.col(col) <= b, F.lit(b)).otherwise(case)
    return df.withColumn("bucket_len", case)


def padded_len(length: Column, multiple: int) -> Column:
    return (F.ceil(length / multiple) * multiple).cast("bigint")
