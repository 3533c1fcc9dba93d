"""Session-wide helpers: shared scratch space, size-checked broadcast, dense row order."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

BROADCAST_BYTES = 128 << 20
ROW_OVERHEAD = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="codemix-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    The zip is built beside the driver's temporary files; ``addPyFile`` serves it
    to every executor, so UDFs import the package wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_codemix_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="codemix-py-"), "codemix.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._codemix_shipped = True


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let Arrow batches hold ``limit`` bytes at most: by their rows alone, batches of long texts grow large.

    A smaller limit of the session stays.  Results do not depend on batches.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= limit:
        spark.conf.set(name, str(limit))


@contextmanager
def files_cleaned(spark: SparkSession):
    """Let Spark remove the shuffle files of the queries run inside as each of them ends.

    Else they stay until the driver's garbage is collected, beside those of the query that follows.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target, files = _files(spark, path)
    files.deleteOnExit(target)
    return path


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by a table in the shared folder.

    Unlike a checkpoint it is planned with its true size: estimates of a checkpoint carry
    on those of its plan, which joins multiply, so they explode in loops.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing will read again."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        target, files = _files(df.sparkSession, path)
        files.delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _bytes(col: Column, kind: DataType) -> Column:
    """Bytes of a value in columnar memory: eight of a number, content and four more of a text or list."""
    four = F.lit(4).cast("bigint")
    if isinstance(kind, (StringType, BinaryType)):
        return four + F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(kind, StructType):
        inner = F.lit(0).cast("bigint")
        for f in kind.fields:
            inner = inner + _bytes(col[f.name], f.dataType)
        return inner
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
            return four + F.coalesce(F.aggregate(
                col, F.lit(0).cast("bigint"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0))
        return four + 8 * F.coalesce(F.size(col), F.lit(0))
    if isinstance(kind, MapType):
        return _bytes(F.map_keys(col), ArrayType(kind.keyType)) + _bytes(F.map_values(col), ArrayType(kind.valueType))
    return F.lit(8).cast("bigint")


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, overhead: int = ROW_OVERHEAD) -> bool:
    """Measure a side before it may be broadcast.

    Sums the bytes of all values and an overhead per row; the caller keeps another plan
    for the case that this returns False.
    """
    per_row = F.lit(overhead).cast("bigint")
    for f in df.schema.fields:
        per_row = per_row + _bytes(F.col(f.name), f.dataType)
    total = df.agg(F.sum(per_row).alias("b")).first()["b"] or 0
    return total <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def dense_order(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the 0-based position of every row in a global order.

    One range exchange and sort.  The sorted rows are stored with their partition and row,
    so that the per-partition counts and the result see the same places.  The offsets table
    has one row per partition.  ``order`` must end in a unique key: then equal leading keys
    are spread over partitions as well.
    """
    spark = df.sparkSession
    done = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = {r["_pid"]: r["n"] for r in
              done.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for pid in sorted(counts):
        offsets.append((pid, total))
        total += counts[pid]
    table = spark.createDataFrame(offsets or [(0, 0)], "_pid bigint, _off bigint")
    return (done.withColumn("_pid", part).join(F.broadcast(table), "_pid")
            .withColumn(name, F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_pid", "_at", "_off"))
