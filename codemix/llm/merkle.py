"""Merkle manifest of a dataset: leaves, subroots, a root, and a proof for every row.

A leaf hashes the fields of a row.  The leaves of a source, in the order of doc_id, are the
lowest level of its tree; every ``FAN`` consecutive nodes make one node of the next level,
until one is left, the subroot.  The subroots, in the order of source, make the root alike.

One level is one window: columns at fixed offsets behind (lag) and ahead (lead), masked by
the slot of a node in its run and by the length of that run, hold a node's siblings.  Rows
of slot 0 hash their parent from their own digest and those ahead.  A window spans
``BLOCK`` consecutive nodes, so a source of any size is spread over all tasks.  Levels are
climbed once for the parents, and walked down once for the proofs: a node's path is its own
siblings followed by the path of its parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codemix.llm.order import numbered
from codemix.session import discard, stored

FAN_BITS = 4
#: Children of a node, and nodes of a level that one window holds (whole runs).
FAN, BLOCK_BITS = 1 << FAN_BITS, 2 * FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings before and after a node, as hex digests in a row, level by level.
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` for null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The hex digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _tree(source: Column) -> Column:
    """A name per source that is never null and sorts like the sources, null first."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


#: A node's run in its level, its slot there, the length of the run, and the window that holds whole runs.
_RUN, _SLOT = f"shiftright(pos, {FAN_BITS})", f"(pos & {FAN - 1})"
_LENGTH = f"least({FAN}, m - shiftleft({_RUN}, {FAN_BITS}))"
_HERE = f"(partition by tree, shiftright(pos, {BLOCK_BITS}) order by pos)"
#: Siblings behind, farthest first, and ahead; empty where there are none.
BEHIND = "concat(" + ", ".join(
    f"if({_SLOT} >= {k}, lag(digest, {k}) over {_HERE}, '')" for k in range(FAN - 1, 0, -1)) + ")"
AHEAD = "concat(" + ", ".join(
    f"if({_SLOT} + {k} < {_LENGTH}, lead(digest, {k}) over {_HERE}, '')" for k in range(1, FAN)) + ")"


def _shown(nodes: DataFrame) -> DataFrame:
    """Inner nodes, those of trees that go on, with their digests as hex text."""
    return nodes.filter(F.col("m") > 1).withColumn("digest", F.lower(F.hex("hash")))


def _parents(nodes: DataFrame) -> DataFrame:
    rows = _shown(nodes).selectExpr("tree", "m", "pos", f"concat(digest, {AHEAD}) as digests")
    return rows.filter(f"{_SLOT} = 0").selectExpr(
        "tree", f"{_RUN} as pos", f"shiftright(m + {FAN - 1}, {FAN_BITS}) as m", "unhex(sha2(digests, 256)) as hash")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all trees, from ``nodes(tree, pos, m, hash)`` up to those of one node."""
    levels, size = [nodes], nodes.agg(F.max("m")).first()[0] or 0
    while size > 1:
        levels.append(stored(_parents(levels[-1].select("tree", "pos", "m", "hash")), "level"))
        size = -(-size // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the node that remains of every tree."""
    out = None
    for level in levels:
        last = level.filter(F.col("m") == 1).select("tree", "hash")
        out = last if out is None else out.unionByName(last)
    return out


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with ``path`` and the columns of ``above(tree, path, ...)``.

    ``above`` holds one row per tree, with the path of the tree's last node.
    """
    known, extra = None, [c for c in above.columns if c not in ("tree", "path")]
    for depth, level in reversed(list(enumerate(levels))):
        own = [c for c in level.columns if c not in ("tree", "pos", "m")]
        columns = ["tree", "pos", *own, "path", *extra]
        found = level.filter(F.col("m") == 1).join(above, "tree").select(*columns)
        if known is not None:
            rows = _shown(level).selectExpr("tree", "pos", f"{_RUN} as run", *own,
                                            f"struct({BEHIND} as before, {AHEAD} as after) as step")
            up = known.select("tree", F.col("pos").alias("run"), F.col("path").alias("up"), *extra)
            found = found.unionByName(rows.join(up, ["tree", "run"]).withColumn(
                "path", F.concat(F.array("step"), "up")).select(*columns))
        known = stored(found.drop("hash"), "paths") if depth else found
    return known


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda now, s: F.sha2(F.concat(s["before"], now, s["after"]), 256))


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path, and the columns of ``carry`` over ``docs``.

    ``docs`` needs ``fields``, which make the leaf in this order, doc_id and source among
    them; other columns are not read, unless ``carry`` names them.  Digests are lowercase hex.
    ``path`` holds, per level, the siblings before and after the row's node; ``fold`` and
    ``proof_digest`` read it.  Null is a source of its own and comes first, as does a null
    doc_id; rows that share a doc_id are ordered by their leaves, so equal rows are leaves
    each for itself and may swap places.  Null and empty text give different leaves.  An
    empty table gives no rows.
    """
    carry = carry or {}
    clash = {"tree", "pos", "m", "hash", "path", "subroot", "run", "digest", "step", "up", "doc_id"} & set(carry)
    if clash:
        raise ValueError(f"carried columns may not be named {sorted(clash)}")
    rows = stored(docs.select(_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
                              F.unhex(leaf([docs[c] for c in fields])).alias("hash"),
                              *[c.alias(name) for name, c in carry.items()]), "rows")
    placed = stored(numbered(rows, "tree", F.asc_nulls_first("doc_id"), F.asc("hash")), "placed")
    discard(rows)
    levels = climb(placed)
    subroots = numbered(tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), "tree", F.asc("name"))
    upper = climb(stored(subroots, "subroots"))
    last = tops(upper).first()
    root = bytes(last["hash"]).hex() if last else None
    start = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
    above = stored(descend(upper, start).select(
        F.col("name").alias("tree"), "path", F.lower(F.hex("hash")).alias("subroot")), "above")
    return descend(levels, above).select(
        "doc_id", F.lower(F.hex("hash")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path",
        *carry)
