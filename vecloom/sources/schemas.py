"""Schemas and layouts of the derived tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
_V = T.ArrayType(T.FloatType(), False)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


EMBEDDING_STORE = _schema(
    ("content_hash", _S, False), ("model_version", _S, False), ("config_id", _S, False), ("hash_prefix", _S, False),
    ("embedding_dim", _I, False), ("embedding", _V, False), ("text", _S, True), ("created_at", _TS, False),
)
CONTENT_MAP = _schema(
    ("source_table", _S, False), ("source_row_id", _S, False), ("chunk_ordinal", _I, False), ("content_hash", _S, True), ("config_id", _S, False), ("model_version", _S, False),
    ("source_snapshot_id", _L, False), ("source_sequence_number", _L, False), ("source_committed_at", _L, False), ("deleted", _B, False), ("created_at", _TS, False),
)
PROJECTION = _schema(
    ("vector_id", _S, False), ("source_table", _S, False), ("source_row_id", _S, False), ("chunk_ordinal", _I, False), ("content_hash", _S, False), ("model_version", _S, False), ("config_id", _S, False),
    ("embedding_dim", _I, False), ("embedding", _V, False), ("text", _S, True), ("source_snapshot_id", _L, False), ("source_sequence_number", _L, False), ("created_at", _TS, False),
)
CLUSTERED = _schema(("content_hash", _S, False), ("cluster_id", _I, False), ("model_version", _S, False), ("config_id", _S, False), ("embedding_dim", _I, False), ("embedding", _V, False), ("text", _S, True))
#: Centroids and coverage carry the source table too: one configuration may serve many sources.
CENTROIDS = _schema(("source_table", _S, False), ("model_version", _S, False), ("config_id", _S, False), ("cluster_id", _I, False), ("centroid", _V, False))
COVERAGE = _schema(("source_table", _S, False), ("model_version", _S, False), ("config_id", _S, False), ("coverage_digest", _S, False), ("content_count", _L, False), ("created_at", _TS, False), ("refit_content_count", _L, True))

LAYOUT = {
    "embedding_store": (EMBEDDING_STORE, ["model_version"]),
    "content_map": (CONTENT_MAP, ["source_table", "config_id"]),
    "projection": (PROJECTION, ["source_table", "model_version"]),
    "clustered": (CLUSTERED, ["model_version", "config_id", "cluster_id"]),
    "vector_centroids": (CENTROIDS, ["source_table", "model_version", "config_id"]),
    "vector_index_coverage": (COVERAGE, ["source_table", "model_version", "config_id"]),
}
