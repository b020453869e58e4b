"""SQL text for readers that share the tables but not this library."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

SEGMENT = re.compile(r"[A-Za-z0-9_$]+\Z")
QUERY, LIMIT = "${query_vector}", "${limit}"


def quoted(identifier: str, mark: str) -> str:
    parts = identifier.split(".")
    if not all(SEGMENT.match(p) for p in parts):
        raise ValueError(f"not an identifier: {identifier!r}")
    return ".".join(f"{mark}{p}{mark}" for p in parts)


def _check(dimension: int) -> None:
    if dimension <= 0:
        raise ValueError(f"the dimension must be positive: {dimension}")


def _spark_scored(table: str, dimension: int) -> str:
    """Rows with their similarity; a query of another width gives no rows, zero norms give nulls."""
    _check(dimension)
    def fold(a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, v) -> s + v)"

    v, q = "transform(t.embedding, x -> CAST(x AS DOUBLE))", "q.v"
    return (
        f"WITH q AS (SELECT transform({QUERY}, x -> CAST(x AS DOUBLE)) AS v)\n"
        f"SELECT t.content_hash, t.source_row_id, t.chunk_ordinal, t.text, {fold(v, q)} / NULLIF(sqrt({fold(v, v)}) * sqrt({fold(q, q)}), 0D) AS similarity\n"
        f"FROM {quoted(table, '`')} t CROSS JOIN q\n"
        f"WHERE size(t.embedding) = {dimension} AND size(q.v) = {dimension}"
    )


def _trino_scored(table: str, dimension: int) -> str:
    _check(dimension)
    return (
        f"SELECT t.content_hash, t.source_row_id, t.chunk_ordinal, t.text, cosine_similarity(CAST(t.embedding AS array(double)), q.v) AS similarity\n"
        f"FROM {quoted(table, chr(34))} t CROSS JOIN (SELECT CAST({QUERY} AS array(double)) AS v) q\n"
        f"WHERE cardinality(t.embedding) = {dimension} AND cardinality(q.v) = {dimension}"
    )


def spark_search(table: str, dimension: int) -> str:
    """A top-k query in Spark SQL."""
    return f"{_spark_scored(table, dimension)}\nORDER BY similarity DESC NULLS LAST, t.content_hash LIMIT {LIMIT}"


def trino_search(table: str, dimension: int) -> str:
    return f"{_trino_scored(table, dimension)}\nORDER BY similarity DESC, t.content_hash LIMIT {LIMIT}"


def similarity_view(view: str, table: str, dimension: int, engine: str = "spark", temporary: bool = False) -> str:
    """A view of the rows with their similarity to a query vector, whose placeholder bind_vector() fills."""
    if engine not in ("spark", "trino"):
        raise ValueError(f"unknown engine: {engine!r}; known are spark, trino")
    body = (_spark_scored if engine == "spark" else _trino_scored)(table, dimension)
    return f"CREATE OR REPLACE {'TEMPORARY ' if temporary else ''}VIEW {quoted(view, '`' if engine == 'spark' else chr(34))} AS\n{body}"


def view_ddl(view: str, table: str, engine: str = "spark") -> str:
    """A view of a serving table without its internal columns."""
    if engine not in ("spark", "trino"):
        raise ValueError(f"unknown engine: {engine!r}; known are spark, trino")
    mark = "`" if engine == "spark" else '"'
    return f"CREATE OR REPLACE VIEW {quoted(view, mark)} AS SELECT vector_id, source_table, source_row_id, chunk_ordinal, content_hash, embedding_dim, embedding, text FROM {quoted(table, mark)}"


def search_sql(table: str, dimension: int, engine: str = "spark") -> str:
    if engine == "spark":
        return spark_search(table, dimension)
    if engine == "trino":
        return trino_search(table, dimension)
    raise ValueError(f"unknown engine: {engine!r}; known are spark, trino")


def vector_literal(vector: Sequence[float]) -> str:
    values = [float(x) for x in vector]
    if not values or not all(map(math.isfinite, values)):
        raise ValueError("a query vector must have components, all of them finite")
    return f"array({', '.join(f'{x!r}D' if 'e' not in repr(x) else f'CAST({x!r} AS DOUBLE)' for x in values)})"


def bind_vector(sql: str, vector: Sequence[float], engine: str = "spark") -> str:
    """The text with its vector filled in; one without the placeholder is refused."""
    if QUERY not in sql:
        raise ValueError(f"the query lacks {QUERY}")
    text = vector_literal(vector)
    if engine == "trino":
        text = "ARRAY[" + ", ".join(f"DOUBLE '{float(x)!r}'" for x in vector) + "]"
    return sql.replace(QUERY, text)


def bind(sql: str, vector: Sequence[float], limit: int, engine: str = "spark") -> str:
    """The query with its placeholders filled; a text without them is refused."""
    if LIMIT not in sql:
        raise ValueError(f"the query lacks {LIMIT}")
    return bind_vector(sql, vector, engine).replace(LIMIT, str(int(limit)))


def run(spark: SparkSession, sql: str, vector: Sequence[float], limit: int):
    """The same with a named parameter in place of literals."""
    return spark.sql(sql.replace(QUERY, ":query_vector").replace(LIMIT, str(int(limit))), args={"query_vector": [float(x) for x in vector]})
