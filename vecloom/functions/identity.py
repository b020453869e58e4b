"""Identity of rows, content, configurations and vectors, as column expressions and driver-side helpers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"
EMPTY_COVERAGE = hashlib.sha256(b"coverage.empty").hexdigest()


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hex_digest(*parts: str) -> str:
    """SHA-256 of the parts joined by the separator, lower-case hex."""
    return hashlib.sha256(SEP.join(parts).encode()).hexdigest()


def canonical_text(columns: Sequence[str], join_separator: str = " ") -> Column:
    """The values in order, joined; a null counts as the empty text and keeps its separator."""
    if not columns:
        return F.lit("")
    return F.concat_ws(join_separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def content_hash(text: Column) -> Column:
    return sha256_hex(text)


def packed(content: Column) -> Column:
    """A content hash in the 32 bytes that it holds, for shuffles; any other text behind 33 zero bytes, so that none is taken for another."""
    other = F.concat(F.lit(bytes(33)), content.cast("binary"))
    return F.when(content.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(content)).otherwise(other)


def unpacked(content: Column) -> Column:
    """What `packed` packed."""
    return F.when(F.length(content) == 32, F.lower(F.hex(content))).otherwise(F.substring(content, 34, 1 << 30).cast("string"))


def hash_prefix(content: Column) -> Column:
    """The first two digits, `00` where there are fewer."""
    return F.when(F.length(content) >= 2, F.substring(content, 1, 2)).otherwise("00")


def row_id(keys: Sequence[str]) -> Column:
    """Key values joined by the separator; null if any of them is null or empty."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return F.when(~bad, F.concat_ws(SEP, *(F.col(k).cast("string") for k in keys)))


def chunk_key(table: Column, row: Column, ordinal: Column, config: Column) -> Column:
    return F.concat_ws("::", table, row, ordinal.cast("string"), config)


def store_key(content: Column, model_version: Column, config: Column) -> Column:
    return F.concat_ws(SEP, content, model_version, config)


def vector_id(table: Column, row: Column, snapshot: Column, ordinal: Column, model: Column, version: Column, config: Column) -> Column:
    return sha256_hex(F.concat_ws(SEP, table, row, snapshot.cast("string"), ordinal.cast("string"), model, version, config))


def index_id(source_table: str, model_version: str, config_id: str) -> str:
    return hex_digest("index", source_table, model_version, config_id)


def preprocessing_id(columns: Sequence[str], separator: str, chunker: str, size: int, overlap: int) -> str:
    return hex_digest("preprocessing", ",".join(columns), separator, chunker, str(size), str(overlap))


def coverage_digest(hashes: DataFrame, column: str = "content_hash", fan: int = 256) -> str:
    """SHA-256 of the distinct hashes in order, each followed by the separator.

    Hashes are sorted by Spark and streamed to the driver one partition at a time, so neither an executor nor the
    driver ever holds them all.
    """
    ordered = hashes.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    digest, empty = hashlib.sha256(), True
    for row in ordered.toLocalIterator(prefetchPartitions=False):
        digest.update(row[0].encode() + SEP.encode())
        empty = False
    return EMPTY_COVERAGE if empty else digest.hexdigest()


def tree_digest(hashes: DataFrame, column: str = "content_hash") -> DataFrame:
    """n_contents, digest: a coverage digest that needs no global order, for sets too large to stream.

    Distinct hashes are digested by their first four digits, those digests by their first two, and then together.
    """
    each = hashes.select(F.col(column).alias("h")).filter(F.col(column).isNotNull()).distinct()

    def fold(df: DataFrame, digits: int) -> DataFrame:
        joined = F.concat_ws(SEP, F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]))
        return df.groupBy(F.substring("k", 1, digits).alias("k")).agg(sha256_hex(joined).alias("h"), F.sum("n").alias("n"))

    level = each.select(F.col("h").alias("k"), "h", F.lit(1).cast("long").alias("n"))
    for digits in (4, 2, 0):
        level = fold(level, digits)
    return level.select(F.col("n").alias("n_contents"), F.col("h").alias("digest"))


def dedup_key(materialization_id: str, path: str, snapshot_id: int) -> str:
    """Identity of a unit of work in the queue."""
    return hex_digest(materialization_id, path, str(snapshot_id))


def projection_name(source: str, config_id: str) -> str:
    """`vectors_` and the source's name in [a-z0-9_], 80 characters at most, a hash of the name, and the configuration."""
    clean = re.sub(r"[^a-z0-9_]+", "_", source.lower()).strip("_")[:80] or "source"
    return f"vectors_{clean}_{hashlib.sha256(source.encode()).hexdigest()[:6]}_{config_id}"


def clustered_name(source: str) -> str:
    return "clustered_" + re.sub(r"[^A-Za-z0-9]", "_", source).lower()
