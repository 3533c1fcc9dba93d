"""MinHash near-dedup with tensored banding.

Two small collections of band hashes, U (``BANDS_U`` bands of ``ROWS_U`` minimums) and
V (``BANDS_V`` of ``ROWS_V``), give ``BANDS_U * BANDS_V`` tables: table (i, j) is keyed
by the pair (U_i, V_j).  So 52 minimums serve 96 tables of five minimums each.  A pair
of similarity 0.8 shares no table with probability 5e-4.  A key can only repeat where both
of its hashes do: the 20 hashes of a class are counted first, and only pairs of repeated
ones become keys.  Keys are counted once; then only those that repeat send their rows.

Texts with the same shingle set form one class, and classes are compared once.  In
every bucket all members are first compared with one pivot.  Classes that end up in
one component need no more comparisons.  In buckets that still span components, rows of
small components are pivots for all others, ``PIVOTS`` at a time, until every pair of the
bucket was compared or lies in one component; they meet blockwise in memory.  So no
bucket is expanded to all pairs, and no link inside it is lost.  Before texts are fetched, counts of shingles by their first byte bound the
intersection from above, which excludes nearly all chance candidates and no link.  Links
are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codemix.llm import bloom
from codemix.llm.common import WordHasher, mix, row_slices, stream, text_buffer, thin
from codemix.session import discard, stored

BANDS_U, ROWS_U = 8, 2
BANDS_V, ROWS_V = 12, 3
#: Rows of an open bucket that all its rows are compared with per round, and rows of a band's buckets in one block (held).
PIVOTS, BLOCK_ROWS = 1024, 65_536
SALTS = 32
#: Ids that may be broadcast to pick texts (8 bytes each).
BROADCAST_IDS = 1_000_000

_SIGNED = "doc_id bigint, n bigint, d1 bigint, d2 bigint, u array<bigint>, v array<bigint>, spread binary"
_WEIGHTS = stream(101, 64)
_DIGEST = stream(103, 2)
_TIMES = stream(107, BANDS_U * ROWS_U + BANDS_V * ROWS_V) | np.uint64(1)
_PLUS = stream(109, BANDS_U * ROWS_U + BANDS_V * ROWS_V)


# --- sets and signatures ----------------------------------------------------

def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct 64-bit hashes of its word shingles.

    Fewer words than ``words`` make one shingle; none make an empty set.
    """
    hasher = WordHasher(True)
    data, bounds = text_buffer(column)
    for a, b in row_slices(bounds):
        base = bounds[a]
        found, cuts = hasher.words(data[base:bounds[b]], bounds[a:b + 1] - base)
        rolled = found[:max(len(found) - words + 1, 0)]
        for j in range(1, words):
            rolled = mix(rolled + _WEIGHTS[j]) ^ found[j:len(found) - words + 1 + j]
        rolled = mix(rolled + np.uint64(words))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e - s >= words:
                yield np.unique(rolled[s:e - words + 1])
            elif e > s:
                one = found[s:s + 1]
                for j in range(1, e - s):
                    one = mix(one + _WEIGHTS[j]) ^ found[s + j:s + j + 1]
                yield mix(one + np.uint64(e - s))
            else:
                yield found[:0]


def minimums(values: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(values), 4096):
        part = values[None, s:s + 4096] * _TIMES[:, None] + _PLUS[:, None]
        least = np.minimum(least, part.min(1))
    return least


def _bands(least: np.ndarray, rows: int, tag: int) -> np.ndarray:
    groups = least.reshape(-1, rows)
    band = stream(tag, len(groups))
    for r in range(rows):
        band = mix(band ^ groups[:, r])
    return band


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = BANDS_U * ROWS_U
        for batch in thin(batches, "text", 1 << 20):
            cols: dict[str, list] = {k: [] for k in ("n", "d1", "d2", "u", "v", "spread")}
            for values in shingle_sets(batch.column("text"), words):
                cols["n"].append(len(values))
                for k in range(2):
                    cols[f"d{k + 1}"].append(np.add.reduce(mix(values ^ _DIGEST[k]), dtype=np.uint64))
                least = minimums(values) if len(values) else np.zeros(0, np.uint64)
                cols["u"].append(_bands(least[:split], ROWS_U, 113).view(np.int64))
                cols["v"].append(_bands(least[split:], ROWS_V, 127).view(np.int64))
                counts = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=256)
                cols["spread"].append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(cols["n"], pa.int64()),
                "d1": pa.array(np.array(cols["d1"], np.uint64).view(np.int64)),
                "d2": pa.array(np.array(cols["d2"], np.uint64).view(np.int64)),
                "u": pa.array(cols["u"], longs), "v": pa.array(cols["v"], longs),
                "spread": pa.array(cols["spread"], pa.binary())})

    return run


def _possible(percent: int):
    """Pairs whose sets can reach the similarity, by the bound on their intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ~(batch.column("s_a").is_null().to_numpy(zero_copy_only=False)
                      | batch.column("s_b").is_null().to_numpy(zero_copy_only=False))
            keep = ~known
            some = batch.filter(pa.array(known))
            x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, 256)
                    for c in ("s_a", "s_b"))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            whole = some.column("n_a").to_numpy() + some.column("n_b").to_numpy()
            keep[known] = 100 * most >= percent * (whole - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thin(batches, "text_a", 1 << 20):
            linked = []
            for x, y in zip(shingle_sets(batch.column("text_a"), words),
                            shingle_sets(batch.column("text_b"), words), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


# --- links ------------------------------------------------------------------

def _alike(x: Column, y: Column, percent: int) -> Column:
    """Sizes that can reach the similarity at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _keys(halves, repeated=None):
    """(id, n, u, key) of the tables whose two hashes are in a filter of repeated hashes, and whose key is in one of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                u, v = (part.column(c).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1) for c in "uv")
                use = (bloom.known(halves.value, u.ravel()).reshape(u.shape)[:, :, None]
                       & bloom.known(halves.value, v.ravel()).reshape(v.shape)[:, None, :])
                row, i, j = np.nonzero(use)
                key = mix(mix(u[row, i]) + v[row, j])
                if repeated is not None:
                    keep = bloom.known(repeated.value, key)
                    row, i, key = row[keep], i[keep], key[keep]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("n").take(at), pa.array(u[row, i].view(np.int64)),
                     pa.array(key.view(np.int64))], ["id", "n", "u", "key"])

    return run


def _buckets(reps: DataFrame) -> DataFrame:
    """The rows (id, n, u, key, pivot) of the buckets of two classes or more, each set of members once."""
    sc, schema = reps.sparkSession.sparkContext, "id bigint, n bigint, u bigint, key bigint"
    signed = reps.select(F.col("doc_id").alias("id"), "n", "u", "v")
    halves = (signed.select(F.explode(F.concat("u", "v")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size"))
              .filter(F.col("size") > 1).select("key"))
    halves = stored(halves, "repeated")
    known = sc.broadcast(bloom.build(halves))
    discard(halves)
    same = ["pivot", "size", "x", "y"]  # buckets of the same members are compared once
    keys = signed.mapInArrow(_keys(known), schema)
    buckets = stored(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size"),
                                             F.bit_xor(F.xxhash64("id")).alias("x"),
                                             F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
                     .filter(F.col("size") > 1).groupBy(*same).agg(F.min("key").alias("key")).select("key", "pivot"), "buckets")
    repeated = sc.broadcast(bloom.build(buckets))
    rows = stored(signed.mapInArrow(_keys(known, repeated), schema).join(buckets, "key"))
    discard(buckets)
    known.destroy()
    repeated.destroy()
    return rows


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the counts do not exclude."""
    sides = [reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("spread").alias(f"s_{c}"))
             for c in "ab"]
    return stored(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_possible(percent), "a bigint, b bigint"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"))
    return stored(both.select("a", "b", "text_a", "text_b")
                        .mapInArrow(_confirm(words, percent), "a bigint, b bigint").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), for every id that has a link.

    Labels move to neighbours and are shortened by looking up the label's own label.
    """
    sides = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y"))
                   .union(links.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    held = stored(sides.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m"))
                  .select("id", F.least("id", "m").alias("label")))
    labels = held
    while True:
        near = (sides.join(labels.withColumnRenamed("id", "y"), "y")
                .groupBy(F.col("x").alias("id")).agg(F.min("label").alias("m")))
        moved = labels.join(near, "id").select("id", "label", F.least("label", "m").alias("to"))
        roots = labels.select(F.col("id").alias("to"), F.col("label").alias("root"))
        now = stored(moved.join(roots, "to").select("id", "label", F.least("to", "root").alias("to")))
        if now.filter(F.col("to") != F.col("label")).isEmpty():
            discard(now)
            discard(sides)
            return labels
        discard(held)
        held, labels = now, now.select("id", F.col("to").alias("label"))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with their label, of the buckets that span more than one component."""
    named = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    spans = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return named.join(spans.filter(F.col("lo") != F.col("hi")).select("key"), "key", "left_semi")


def _pivots(rows: DataFrame) -> DataFrame:
    """The next pivots of each bucket, smallest component first; cut per salt before the bucket meets."""
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("share"))
    ranked = rows.join(sizes, ["key", "label"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    order = [F.col("share"), F.col("label"), F.col("id")]
    for keys in (["key", "salt"], ["key"]):
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
            F.col("rank") <= PIVOTS)
    return ranked.select(*rows.columns)


def _meet(percent: int):
    """Pairs of a band's pivots and rows that share a bucket, lie in different components and can be alike.

    Bands arrive one after the other, in blocks: first the block's rows, which are held, then its
    pivots.  A pivot meets a row once, however many of the band's buckets hold both.
    """

    def parts(batch: pa.RecordBatch) -> tuple:
        spread = batch.column("spread")
        known = ~spread.is_null().to_numpy(zero_copy_only=False)
        spread = spread.fill_null(b"\0" * 256)  # not read where unknown
        keys = batch.column("keys")
        sizes = np.diff(keys.offsets.to_numpy())
        flat = keys.flatten()
        return (*(batch.column(c).to_numpy() for c in ("id", "label", "n")),
                np.frombuffer(b"".join(spread.to_pylist()), np.uint8).reshape(-1, 256), known,
                sizes, flat.field("key").to_numpy(), flat.field("once").to_numpy(zero_copy_only=False))

    def distinct(out: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(out)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])
        return pa.RecordBatch.from_arrays([pa.array(pairs[new, 0]), pa.array(pairs[new, 1])], ["a", "b"])

    def gathered(held: list[tuple]) -> tuple:
        """The rows of a block, the keys of its buckets in order, and the row of each of them."""
        ids, labels, ns, spreads, known, sizes, keys, _ = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        return ids, labels, ns, spreads, known, keys[order], np.repeat(np.arange(len(ids)), sizes)[order]

    def pairs(rows: tuple, pivots: tuple) -> Iterator[np.ndarray]:
        ids, labels, ns, spreads, known, keys, owner = rows
        ends = np.cumsum(pivots[5])
        lo, hi = (np.searchsorted(keys, pivots[6], side) for side in ("left", "right"))
        for i, label, n, spread, sure, size, end in zip(*pivots[:6], ends, strict=True):
            met = []
            for k in range(end - size, end):
                there = owner[lo[k]:hi[k]]
                met.append(there[ids[there] > i] if pivots[7][k] else there)
            fit = np.unique(np.concatenate(met)) if len(met) > 1 else met[0]
            sizes = ns[fit]
            fit = fit[(labels[fit] != label) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))]
            if len(fit) and sure:  # unknown counts exclude nothing
                most = np.minimum(spreads[fit], spread).sum(1, dtype=np.int64)
                fit = fit[~known[fit] | (100 * most >= percent * (ns[fit] + n - most))]
            if len(fit):
                yield np.stack([np.minimum(ids[fit], i), np.maximum(ids[fit], i)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, held, rows, out, size = None, [], None, [], 0
        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in ("u", "block", "kind")]
            edges = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                u, block, kind = (m[s] for m in marks)
                if band != (u, block):
                    if out:
                        yield distinct(out)
                    band, held, rows, out, size = (u, block), [], None, [], 0
                part = parts(batch.slice(s, e - s))
                if kind == 0:
                    held.append(part)
                elif held:
                    rows = rows or gathered(held)
                    for found in pairs(rows, part):
                        out.append(found)
                        size += len(found)
                        if size > 1_000_000:
                            yield distinct(out)
                            out, size = [], 0
        if out:
            yield distinct(out)

    return run


def _near_pairs(rows: DataFrame, pivots: DataFrame, spreads: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of open buckets; large bands are cut into blocks that each get the pivots.

    A row is sent once for all its buckets of a U band, and meets its counts of shingles so too.
    """
    sizes = rows.groupBy("u", "key").agg(F.count(F.lit(1)).alias("whole"))
    blocks = sizes.groupBy("u").agg(F.ceil(F.sum("whole") / BLOCK_ROWS).cast("int").alias("blocks"))
    chosen = pivots.select("u", "key", "id").distinct().withColumn("chosen", F.lit(True))
    bucket = F.struct("key", (F.col("whole") <= PIVOTS).alias("once"))  # all rows are pivots: a pair would be met twice
    sent = (rows.join(sizes, ["u", "key"]).join(chosen, ["u", "key", "id"], "left").groupBy("u", "id", "label", "n").agg(
        F.collect_list(bucket).alias("all"),
        F.collect_list(F.when(F.col("chosen"), bucket)).alias("pivots")).join(spreads, "id").join(blocks, "u"))
    columns = ["u", "id", "label", "n", "spread"]
    here = sent.select(*columns, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
                       F.lit(0).alias("kind"), F.col("all").alias("keys"))
    there = sent.filter(F.size("pivots") > 0).select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
        F.col("pivots").alias("keys"))
    return (here.unionByName(there).repartition("u", "block").sortWithinPartitions("u", "block", "kind")
            .mapInArrow(_meet(percent), "a bigint, b bigint").distinct())


def links_of(reps: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between class representatives, and their component labels."""
    rows = _buckets(reps)
    sizes = reps.select(F.col("doc_id").alias("pivot"), F.col("n").alias("p_n"))
    seen = stored(rows.filter(F.col("id") != F.col("pivot")).select("id", "n", "pivot").distinct()
                        .join(sizes, "pivot").filter(_alike(F.col("n"), F.col("p_n"), percent))
                        .select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    links = confirmed(possible(seen, reps, percent), texts, words, percent)
    labels = components(links)
    rows = rows.filter(F.col("id") != F.col("pivot")).select("u", "key", "id", "n")
    spreads = reps.select(F.col("doc_id").alias("id"), "spread")
    while True:
        rows = stored(_open(rows, labels))
        if rows.isEmpty():
            return links, labels
        pivots = stored(_pivots(rows))
        pairs = stored(_near_pairs(rows, pivots, spreads, percent).join(seen, ["a", "b"], "left_anti"))
        found = confirmed(pairs, texts, words, percent)
        seen = seen.union(pairs)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
        rows = rows.select("u", "key", "id", "n").join(pivots.select("key", "id"), ["key", "id"], "left_anti")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked doc_id) and kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    ``words``-word shingles.  Empty sets are linked with nothing, not even each other.
    Every row is judged by its own text, also when rows share a doc_id.  A null doc_id
    takes no part: its component_id is null and it is kept.  Only doc_id and text are read.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(ids.mapInArrow(_sign(words), _SIGNED))
    full = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = ["d1", "d2", "n"]
    classes = stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    first = classes.withColumnRenamed("rep", "doc_id")
    reps = stored(full.join(first, [*same, "doc_id"], "left_semi").dropDuplicates([*same, "doc_id"]))
    _, labels = links_of(reps, ids.filter(F.col("doc_id").isNotNull()), words, percent)
    owners = (classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
              .select(*same, F.coalesce("label", "rep").alias("component_id")))
    out = (signed.select("doc_id", *same).join(owners, same, "left")
           .withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(
               F.when(F.col("doc_id").isNotNull(), F.col("component_id")))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Of rows that share a kept doc_id one stays, by the smallest hash of its text.  Rows
    without a doc_id stay.
    """
    found = near_duplicates(docs, words, percent)
    kept = found.filter("kept").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull())
    stay = named.join(kept, "doc_id", "left_semi").select(*docs.columns)
    ids = named.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("m")).first()
    if ids["n"] != ids["m"]:
        first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
        stay = stay.withColumn("_nd_row", F.row_number().over(first)).filter(F.col("_nd_row") == 1).drop("_nd_row")
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))
