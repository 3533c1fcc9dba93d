"""Exact top-k inner products by dual-tree search over cover trees.

The top level is shared by all data: up to ``PIVOTS`` centres taken from a bounded sample,
farthest first.  Every distinct vector belongs to the group of its nearest centre; large
groups are split by a hash, so a block has about ``BLOCK_ROWS`` members however the data
grow.  Queries are grouped by the same centres.  A pair of groups is skipped when its bound

    c_q . c_p + r_q |c_p| + r_p |c_q| + r_q r_p

over centres c and covering radii r is below the query group's worst k-th score, for which
the sample gives a first value.  The surviving pairs meet in tasks: a cover tree of the
block and one of the queries are searched together, pruned by the same bound with the
worst k-th score of each query node, which rises as leaves are compared.

Components are integers, scores are exact; bounds get a slack for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codemix.llm.vectors import classes, commonest_size, matrix, ranked, sample, usable
from codemix.session import stored

PIVOTS, SAMPLE, BLOCK_ROWS, QUERY_ROWS = 48, 2048, 4096, 2048
LEAF, SHRINK = 48, 0.7

_HITS = "q bigint, vec_id bigint, score bigint"


# --- cover tree -------------------------------------------------------------

class Node:
    """A centre, the radius that covers all members below, and children or member rows."""

    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray, children: list[Node]):
        self.center, self.radius, self.rows, self.children = center, radius, rows, children
        self.norm = float(np.sqrt(center @ center))


def _gaps(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - center) ** 2).sum(1))


def cover_tree(points: np.ndarray, rows: np.ndarray, center: np.ndarray | None = None) -> Node:
    """Children are centres farther apart than the level's scale, each with the points it covers.

    A node whose points the next scale would not gather stays a leaf.
    """
    own = points[rows]
    center = own[0] if center is None else center
    gaps = _gaps(own, center)
    radius = float(gaps.max())
    if len(rows) <= LEAF or radius == 0:
        return Node(center, radius, rows, [])
    scale, children, left = radius * SHRINK, [], rows
    groups = []
    while len(left):
        head = points[left[0]]
        near = _gaps(points[left], head) <= scale
        groups.append((head, left[near]))
        left = left[~near]
        if len(groups) > len(rows) // 8 + 2:
            return Node(center, radius, rows, [])
    if len(groups) > 1:
        children = [cover_tree(points, part, head) for head, part in groups]
        return Node(center, radius, rows, children)
    return Node(center, radius, rows, [])


def bound(a: Node, b: Node) -> float:
    """No inner product between members of the two nodes is larger."""
    top = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return top + 1e-6 * (1.0 + abs(top))


class Best:
    """The k best rows of each query so far, by (score falling, id)."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.astype(np.float64)
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in floors]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids, rows = scores[keep], ids[keep], rows[keep]
        merged = self.found[query] + list(zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True))
        merged.sort()
        self.found[query] = merged[:self.k]
        if len(merged) >= self.k:
            self.floors[query] = max(self.floors[query], -merged[self.k - 1][0])


def dual_search(queries: np.ndarray, floors: np.ndarray, data: np.ndarray, ids: np.ndarray, tree: Node, k: int) -> Best:
    """Search the query tree and the data tree together; ``floors`` are scores known to be reached."""
    best = Best(floors, k)
    real = queries.astype(np.float64)
    stack = [(cover_tree(real, np.arange(len(queries))), tree)]
    while stack:
        q, p = stack.pop()
        worst = best.floors[q.rows].min()
        if bound(q, p) < worst:
            continue
        if not q.children and not p.children:
            scores = queries[q.rows] @ data[p.rows].T
            for i, row in zip(q.rows.tolist(), scores, strict=True):
                good = np.flatnonzero(row >= best.floors[i])
                if len(good):
                    best.add(i, row[good], ids[p.rows[good]], p.rows[good])
            continue
        if p.children and (not q.children or p.radius >= q.radius):
            pairs = [(q, child) for child in p.children]
        else:
            pairs = [(child, p) for child in q.children]
        stack.extend(sorted(pairs, key=lambda x: bound(*x)))
    return best


# --- Spark ------------------------------------------------------------------

def centres(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n sample points, farthest first."""
    if not len(points):
        return points
    chosen, gaps = [0], _gaps(points, points[0])
    while len(chosen) < min(n, len(points)) and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, _gaps(points, points[chosen[-1]]))
    return points[chosen]


def _placed(shared, k: int):
    """Add the nearest centre, the distance to it, and the k-th score on the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, known = shared.value
        squares = (heads * heads).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("vec"))
            group = (squares[None] - 2 * points @ heads.T).argmin(1)
            gap = np.sqrt(((points - heads[group]) ** 2).sum(1))
            floor = np.full(len(points), -np.inf)
            if len(known) > k:
                scores = points @ known.T
                floor = np.partition(scores, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
            names = ["rep", "ids", "vec", "grp", "gap", "floor"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:3]), pa.array(group.astype(np.int32)), pa.array(gap),
                 pa.array(floor)], names)

    return run


def _search(k: int):
    """Blocks arrive one after the other, members before queries; a block's tree is built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, data, tree = None, [], None, None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if now != blocks[a]:
                    now, members, data, tree = blocks[a], [], None, None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    members.append((part.column("ids").to_pylist(), matrix(part.column("vec"), np.int64)))
                    continue
                if not members:
                    continue
                if tree is None:
                    ids = [x for m in members for x in m[0]]
                    data = np.concatenate([m[1] for m in members])
                    first = np.array([x[0] for x in ids], np.int64)
                    tree = cover_tree(data.astype(np.float64), np.arange(len(data)))
                for s in range(0, b - a, QUERY_ROWS):
                    some = part.slice(s, QUERY_ROWS)
                    best = dual_search(matrix(some.column("vec"), np.int64), some.column("floor").to_numpy(),
                                       data, first, tree, k)
                    q, vec_id, score = [], [], []
                    for rep, rows in zip(some.column("rep").to_pylist(), best.found, strict=True):
                        whole = sorted((low, i) for low, _, row in rows for i in ids[row])[:k]
                        q.extend([rep] * len(whole))
                        vec_id.extend(i for _, i in whole)
                        score.extend(-low for low, _ in whole)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, vec_id, score)],
                                                     ["q", "vec_id", "score"])

    return run


def _pairs(heads: np.ndarray, groups: dict[int, tuple[float, int]], asks: dict[int, tuple[float, float]]):
    """(query group, data group, its blocks) of the group pairs that the bound does not exclude.

    ``groups`` has radius and number of blocks, ``asks`` radius and worst k-th score.
    """
    for g, (reach, worst) in asks.items():
        for p, (radius, blocks) in groups.items():
            a, b = Node(heads[g], reach, np.zeros(0, int), []), Node(heads[p], radius, np.zeros(0, int), [])
            if bound(a, b) >= worst:
                yield g, p, blocks


def top_products(embeddings: DataFrame, is_query, k: int = 5, scale: int = 256, vec: str = "embedding") -> DataFrame:
    """Every query's ``k`` rows of the largest inner product: query_id, rank, vec_id, score.

    A component x counts as floor(``scale`` * x), computed in double precision.  Candidates
    are all rows but the query's own; ties go to the smaller vec_id.  Vectors that are null,
    hold null or non-finite components or differ in size from most take no part, nor do rows
    without a vec_id; zero vectors do.  Repeated rows count once.  A table too small for k
    gives all its rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col(vec).alias("vec"),
                             F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vec"), zero=True))
    size = commonest_size(rows)
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = rows.filter(F.size("vec") == size).select("id", whole.alias("vec"), "asks").dropDuplicates(["id", "vec"])
    found = classes(rows.select("id", "vec"), k + 1)
    queries = stored(rows.filter("asks").select(F.col("id").alias("query_id"), "vec")
                           .join(found.select("vec", F.col("rep").alias("q")), "vec").select("query_id", "q"))
    _, known = sample(found, SAMPLE)
    heads = centres(known, PIVOTS)
    if not len(heads):
        return ranked(spark.createDataFrame([], _HITS), queries, k, F.desc("score"))
    shared = spark.sparkContext.broadcast((heads, known))
    shape = "rep bigint, ids array<bigint>, vec array<bigint>, grp int, gap double, floor double"
    placed = stored(found.select("rep", "ids", "vec").mapInArrow(_placed(shared, k), shape))
    asked = placed.join(queries.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi")
    groups = {r["grp"]: (r["gap"], -(-r["n"] // BLOCK_ROWS)) for r in
              placed.groupBy("grp").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).collect()}
    asks = {r["grp"]: (r["gap"], r["floor"]) for r in
            asked.groupBy("grp").agg(F.max("gap").alias("gap"), F.min("floor").alias("floor")).collect()}
    blocks = F.create_map(*[F.lit(x) for g, (_, n) in groups.items() for x in (g, n)])
    targets: dict[int, list[tuple[int, int]]] = {}
    for g, p, n in _pairs(heads, groups, asks):
        targets.setdefault(g, []).append((p, n))
    split = F.pmod(F.xxhash64("rep"), F.element_at(blocks, F.col("grp")).cast("bigint"))
    columns = ["block", "kind", "rep", "ids", "vec", "floor"]
    members = placed.withColumn("block", F.shiftleft(F.col("grp").cast("bigint"), 32) + split).withColumn(
        "kind", F.lit(0)).select(*columns)
    goals = spark.createDataFrame(list(targets.items()), "grp int, goals array<struct<p: bigint, n: int>>") if targets else None
    if goals is None:
        return ranked(spark.createDataFrame([], _HITS), queries, k, F.desc("score"))
    each = F.transform(F.sequence(F.lit(0), F.col("goal.n") - 1),
                       lambda s: F.shiftleft(F.col("goal.p"), 32) + s.cast("bigint"))
    sent = (asked.join(F.broadcast(goals), "grp").withColumn("goal", F.explode("goals"))
            .withColumn("block", F.explode(each)).withColumn("kind", F.lit(1)).select(*columns))
    hits = (members.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")
            .mapInArrow(_search(k + 1), _HITS))
    return ranked(hits, queries, k, F.desc("score"))
