"""Derivation of a stream: each micro-batch is one stamped, at-most-once unit of work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.derive import Deriver
from vecloom.plans.spec import Spec


def derive_stream(rows: DataFrame, spec: Spec, deriver: Deriver, checkpoint: str, trigger: dict[str, object] | None = None, base: int = 0) -> StreamingQuery:
    """Derive a streaming DataFrame. A batch's number, over `base`, is its sequence number; a batch that is delivered
    again after a failure is recognised by its key in the content map's log and changes nothing."""

    def batch(df: DataFrame, n: int) -> None:
        seq = base + n + 1
        stamped = df.select(*spec.needed).withColumns({"__seq": F.lit(seq).cast("long"), "__snapshot_id": F.lit(seq).cast("long"), "__committed_at": F.lit(seq).cast("long")})
        deriver.derive(stamped, spec, f"stream-{spec.source_table}-{spec.config_id}-{seq}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def schedule(spark: SparkSession, every_s: int, action: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Run an action on the driver every so many seconds (a cycle, a maintenance pass, an index build), until stopped.

    A run that takes longer delays the next one; an error of the action ends the query and shows in its exception.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: action()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_s} seconds").start()
