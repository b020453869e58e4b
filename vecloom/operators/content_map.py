"""The content map: an append-only history of which row's chunk points at which content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.identity import packed, unpacked

CHUNK = ["source_table", "source_row_id", "chunk_ordinal", "config_id"]


def _newest() -> list:
    """Newest first; the last two make ties repeatable."""
    return [F.col("source_sequence_number").desc(), F.col("source_committed_at").desc(), F.col("created_at").desc_nulls_last(), F.col("content_hash").desc_nulls_last(), F.col("deleted").asc()]


def newest(history: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The newest assertion of each chunk, tombstones included.

    A maximum over one struct, not a window: it is combined before the shuffle and keeps no chunk's history in memory.
    """
    best = _newest_packed(history.withColumn("content_hash", packed(F.col("content_hash"))), key or CHUNK)
    return best.withColumn("content_hash", unpacked(F.col("content_hash"))).select(*history.columns)


def _newest_packed(history: DataFrame, key: list[str]) -> DataFrame:
    """`newest` where content hashes are packed, and stay so."""
    order = ["source_sequence_number", "source_committed_at", "created_at", "content_hash"]
    # structs compare field by field with nulls first, which is last among the newest; `live` puts live rows over tombstones
    rank = F.struct(*order, (~F.col("deleted")).alias("live"), *[c for c in history.columns if c not in (*key, *order, "deleted")])
    best = history.groupBy(*key).agg(F.max(rank).alias("__best"))
    return best.select(*(F.col(c) if c in key else (~F.col("__best.live")).alias(c) if c == "deleted" else F.col(f"__best.{c}").alias(c) for c in history.columns))


def live_entries(history: DataFrame, as_of: int | None = None) -> DataFrame:
    """What rows point at, newest wins; tombstones and blank hashes drop out last. `as_of` bounds the sequence number."""
    rows = history if as_of is None else history.filter(F.col("source_sequence_number") <= as_of)
    return newest(rows).filter(~F.col("deleted") & F.col("content_hash").isNotNull() & (F.trim("content_hash") != ""))


def live_ordinals(history: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """source_row_id, chunk_ordinal of live chunks, of the given rows only if any are named."""
    slim = history.select(*CHUNK, "source_sequence_number", "source_committed_at", "created_at", packed(F.col("content_hash")).alias("content_hash"), "deleted")
    part = slim if rows is None else slim.join(rows.select("source_row_id").distinct(), "source_row_id", "left_semi")
    return _newest_packed(part, CHUNK).filter(~F.col("deleted")).select("source_row_id", "chunk_ordinal")


def chunk_history(history: DataFrame, table: str, row: str, ordinal: int, config_id: str) -> DataFrame:
    """Every assertion about a chunk, oldest first, with the flag `superseded` on all but the last."""
    rows = history.filter((F.col("source_table") == table) & (F.col("source_row_id") == row) & (F.col("chunk_ordinal") == ordinal) & (F.col("config_id") == config_id))
    return superseded(rows).orderBy("source_sequence_number", "source_committed_at", "created_at")


def superseded(history: DataFrame) -> DataFrame:
    """The history with `superseded`: whether a later assertion of the same chunk follows."""
    return history.withColumn("superseded", F.lag("source_sequence_number").over(Window.partitionBy(*CHUNK).orderBy(*_newest())).isNotNull())


def latest_sequence(history: DataFrame) -> DataFrame:
    return history.agg(F.coalesce(F.max("source_sequence_number"), F.lit(0)).cast("long").alias("latest_sequence"))


def covered_watermark(live: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The sequence number up to which a projection holds all: that of its newest row, or just before the first unresolved one."""
    top = live.agg(F.coalesce(F.max("source_sequence_number"), F.lit(0)).alias("top"))
    low = unresolved.agg(F.min("source_sequence_number").alias("low"), F.count("*").alias("unresolved_rows"))
    mark = F.when(F.col("low").isNull(), F.col("top")).otherwise(F.greatest(F.lit(0), F.least("top", F.col("low") - 1)))
    return top.crossJoin(low).select(mark.cast("long").alias("covered_watermark"), "unresolved_rows")  # one row each


def is_invalid() -> Column:
    """Whether a content map refuses an entry: live without content, or blank table, row or configuration."""
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("source_table", "source_row_id", "config_id")]
    return (~F.col("deleted") & (F.coalesce(F.trim("content_hash"), F.lit("")) == "")) | blank[0] | blank[1] | blank[2]


def invalid(entries: DataFrame) -> DataFrame:
    return entries.filter(is_invalid())
