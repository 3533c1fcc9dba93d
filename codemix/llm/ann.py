"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by ``FUNCTIONS`` projections on normal vectors,
cut into cells of a common width.  Every vector is filed in its cell of every table.  A
query visits ``PROBES`` cells a table: its own and cells perturbed by -1, 0 or 1 a
coordinate, in the order of estimated success (the sum of squared distances to the cell's
borders).  The candidates of all tables are merged by their exact distance.

The width is fitted on a bounded sample (``SAMPLE`` vectors, ``SAMPLE_QUERIES`` queries): the
smallest one on a fixed grid of multiples of the sample's typical distance that reaches
``TARGET`` recall against brute force.  Neighbours in the whole table are closer than in
the sample, which only helps.

Equal vectors form one class that is filed and searched once.  Cells are split by a salt so
that no task holds more than its share; cell members meet the queries blockwise, and only
each query's best members of a block leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codemix.llm.common import mix, stream
from codemix.llm.vectors import classes, commonest_size, matrix, ranked, sample, usable
from codemix.session import stored

TABLES, FUNCTIONS, PROBES = 8, 8, 48
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 128, 0.96
#: Classes per split of a cell.
SPLIT_ROWS = 250_000
#: Queries that the completing search compares with all rows at once.
BLOCK = 1024

_HITS = "q bigint, vec_id bigint, score double"
MOVES = np.array(list(product((0, -1, 1), repeat=FUNCTIONS)), np.int8)


class Hashing:
    """The projections of all tables and the cell width."""

    def __init__(self, size: int, width: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size, self.width = size, width
        self.lines = rng.normal(size=(TABLES, size, FUNCTIONS))
        self.shifts = rng.random((TABLES, FUNCTIONS))

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.lines[table] / self.width + self.shifts[table]

    @staticmethod
    def cell(corner: np.ndarray) -> np.ndarray:
        """One number per cell; a collision only adds candidates."""
        key = np.zeros(corner.shape[:-1], np.uint64)
        for k, salt in enumerate(stream(211, FUNCTIONS)):
            key = mix(key ^ (corner[..., k].astype(np.int64).view(np.uint64) * (salt | np.uint64(1))))
        return key.view(np.int64)

    def filed(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return self.cell(np.floor(self.places(vectors, table)))

    def probes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(queries, PROBES) cells, likeliest first."""
        at = self.places(vectors, table)
        corner = np.floor(at)
        down = (at - corner) ** 2
        up = (corner + 1 - at) ** 2
        cost = down @ (MOVES == -1).T.astype(float) + up @ (MOVES == 1).T.astype(float)
        few = np.argpartition(cost, PROBES - 1, axis=1)[:, :PROBES]
        few = np.take_along_axis(few, np.argsort(np.take_along_axis(cost, few, 1), axis=1, kind="stable"), 1)
        return self.cell(corner[:, None, :] + MOVES[few])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y, good to about 1e-7."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def fit(reps: np.ndarray, vectors: np.ndarray, k: int) -> Hashing:
    """The hashing with the smallest width on the grid that reaches the target recall on the sample."""
    size = vectors.shape[1] if vectors.ndim == 2 and len(vectors) else 1
    if len(vectors) < 2:
        return Hashing(size, 1.0)
    pick = np.arange(min(SAMPLE_QUERIES, len(vectors)))
    far = distances(vectors[pick], vectors)
    far[pick, pick] = np.inf
    k = min(k, len(vectors) - 1)
    near = np.argsort(far, axis=1, kind="stable")[:, :k]
    scale = float(np.median(np.take_along_axis(far, near, 1))) or 1.0
    for step in np.arange(0.4, 6.1, 0.2):
        hashing = Hashing(size, step * scale)
        found = np.zeros(near.shape, bool)
        for table in range(TABLES):
            home, seen = hashing.filed(vectors, table), hashing.probes(vectors[pick], table)
            found |= (home[near][:, :, None] == seen[:, None, :]).any(2)
        if found.mean() >= TARGET:
            break
    return hashing


def _best(q: np.ndarray, queries: np.ndarray, ids: list, vectors: np.ndarray, keep: int) -> pa.RecordBatch:
    """Each query's ``keep`` nearest members by (distance, id), distances in double precision."""
    out_q, out_id, out_d = [], [], []
    for a in range(0, len(q), 512):
        rough = distances(queries[a:a + 512], vectors)
        limit = np.partition(rough, min(keep, rough.shape[1]) - 1, axis=1)[:, min(keep, rough.shape[1]) - 1]
        for i, row in enumerate(rough):
            near = np.flatnonzero(row <= limit[i] + 1e-6)
            exact = np.sqrt(((vectors[near] - queries[a + i]) ** 2).sum(1))
            rows = sorted((d, v) for d, j in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[j])[:keep]
            out_q.extend([int(q[a + i])] * len(rows))
            out_d.extend(d for d, _ in rows)
            out_id.extend(v for _, v in rows)
    return pa.RecordBatch.from_pydict({"q": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()),
                                       "score": pa.array(out_d, pa.float64())})


def _file(shared, splits: int, queries: bool):
    """Rows (cell, kind, rep, ids, vec): members once a table, queries once a probed cell and split."""

    def rows(keys: np.ndarray, batch: pa.RecordBatch, pick: pa.Array | None) -> pa.RecordBatch:
        taken = batch if pick is None else batch.take(pick)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.full(len(keys), 0 if queries else 1, np.int32)), *taken.columns],
            ["cell", "kind", "rep", "ids", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = shared.value
        salts = stream(223, TABLES * splits).reshape(TABLES, splits)
        for whole in batches:
            for start in range(0, whole.num_rows, 256 if queries else 10_000):
                batch = whole.slice(start, 256 if queries else 10_000)
                vectors = matrix(batch.column("vec"))
                reps = batch.column("rep").to_numpy()
                own = (mix(reps.view(np.uint64)) % np.uint64(splits)).astype(np.int64)
                for table in range(TABLES):
                    if not queries:
                        keys = mix(hashing.filed(vectors, table).view(np.uint64) ^ salts[table][own])
                        yield rows(keys.view(np.int64), batch, None)
                        continue
                    cells = hashing.probes(vectors, table).view(np.uint64)
                    pick = pa.array(np.repeat(np.arange(batch.num_rows), PROBES))
                    for salt in salts[table]:
                        yield rows(mix(cells.ravel() ^ salt).view(np.int64), batch, pick)

    return run


def _meet(keep: int):
    """Cells arrive one after the other, queries before members; the queries of one cell are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
                if a == b:
                    continue
                if now != cells[a]:
                    now, held = cells[a], []
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((part.column("rep").to_numpy(), matrix(part.column("vec"))))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    yield _best(*held[0], part.column("ids").to_pylist(), matrix(part.column("vec")), keep)

    return run


def _all_rows(shared, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, queries = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _best(q, queries, batch.column("ids").to_pylist(), matrix(batch.column("vec")), keep)

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 10, vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest found rows of every query: query_id, rank, vec_id, score (distance).

    ``embeddings`` needs vec_id and the vector column; ``is_query`` is a condition on its
    rows.  Candidates are all rows but the query's own.  Vectors that are null, zero, hold
    null or non-finite components, or differ in size from most take no part, nor do rows
    without a vec_id.  Repeated rows count once.  Ties go to the smaller vec_id.  Queries
    that probing gives fewer than k rows are completed against all rows, so only a table
    too small for k gives fewer.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col(vec).alias("vec"),
                             F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec"), zero=False))
    size = commonest_size(rows)
    rows = rows.filter(F.size("vec") == size).dropDuplicates(["id", "vec"])
    found = classes(rows.select("id", "vec"), k + 1)
    queries = stored(rows.filter("asks").select(F.col("id").alias("query_id"), "vec")
                           .join(found.select("vec", F.col("rep").alias("q")), "vec").select("query_id", "q"))
    asked = stored(found.join(queries.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi")
                         .select("rep", "ids", "vec"))
    n = found.count()
    splits = max(1, -(-n // SPLIT_ROWS))
    shared = spark.sparkContext.broadcast(fit(*sample(found, SAMPLE), k))
    filed = f"cell bigint, kind int, rep bigint, ids array<bigint>, {_vec_type(found)}"
    both = (found.select("rep", "ids", "vec").mapInArrow(_file(shared, splits, False), filed)
            .unionByName(asked.mapInArrow(_file(shared, splits, True), filed)))
    hits = stored(both.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_meet(k + 1), _HITS))
    short = (asked.select("rep", "vec").join(
        hits.groupBy(F.col("q").alias("rep")).agg(F.countDistinct("vec_id").alias("n")), "rep", "left")
        .filter(F.coalesce("n", F.lit(0)) <= k).select("rep", "vec"))
    if n > 0 and not short.isEmpty():
        hits = hits.unionByName(_completed(spark, found, stored(short), k))
    return ranked(hits, queries, k, F.col("score"))


def _vec_type(found: DataFrame) -> str:
    return f"vec {found.schema['vec'].dataType.simpleString()}"


def _completed(spark, found: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """The stated queries against all rows, BLOCK queries at a time."""
    parts, last = None, None
    while True:
        rest = short if last is None else short.filter(F.col("rep") > last)
        block = rest.orderBy("rep").limit(BLOCK).collect()
        if not block:
            return parts
        last = block[-1]["rep"]
        shared = spark.sparkContext.broadcast((np.array([r["rep"] for r in block], np.int64),
                                               np.array([list(r["vec"]) for r in block], np.float64)))
        part = stored(found.mapInArrow(_all_rows(shared, k + 1), _HITS))
        parts = part if parts is None else parts.unionByName(part)
