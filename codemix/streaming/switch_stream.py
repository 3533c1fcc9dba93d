"""Code-switching of a stream of assembled candidates.

The job is row-local after assembly, so it needs neither state nor a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codemix.operators.switch import CANDIDATE, SwitchOptions, rebuild, switch_picks

ASSEMBLED = f"sent_id bigint, text string, cands {CANDIDATE}, ref string"


def read_assembled(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ASSEMBLED).parquet(path)


def switch_stream(assembled: DataFrame, out: str, checkpoint: str, opts: SwitchOptions = SwitchOptions(),
                  **trigger) -> StreamingQuery:
    """Write ``sent_id, switched, ref`` of every arriving row once."""
    done = rebuild(switch_picks(assembled, opts)).select("sent_id", "switched", "ref")
    return (done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
