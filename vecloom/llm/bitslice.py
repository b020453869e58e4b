"""Exact top-k inner-product search over a bit-sliced index.

Components are quantised to floor(256 * x). Slice j of a row is a bitmap over its attributes: bit d holds bit j of
attribute d (two's complement). An inner product is a sum over pairs of slices of popcount(query slice AND row slice),
weighted by powers of two. Rows are packed in blocks; for a tile of queries the slices are added from the most
significant one down. After each slice the rest is bounded by the query's own component sums, and rows whose upper
bound lies under the k-th best lower bound fall out; the rows at the boundary are added up to the last slice, so that
scores are exact and ties go to the smaller id.

Plan: queries (one in `every`) stand in groups of about QUERY_BYTES, candidate blocks in groups of about BLOCK_BYTES; each
pair of groups is one task (a stated query set against all rows, in blocks), which keeps k rows a query, and a last
ranking by query keeps k. Nothing is collected or broadcast; a query's answers are k rows a group of blocks.

Defined results. Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null
id; vectors of other lengths are filled with zeros; an empty vector scores 0 with all. Repeated rows of one id are
candidates each, save for queries of that id, however many rows it has. Rows of one id with different vectors are
queries of their own, told apart by `query_digest` (of the quantised vector); equal ones are one query. Components need
|256 * x| < 2^31 (others raise); scores are exact longs. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.base import map_arrow, materialize

SCALE, K, EVERY = 256, 5, 50
BLOCK, TILE = 4096, 64
#: Bytes of bit slices, and of queries as long integers, that one task holds.
BLOCK_BYTES, QUERY_BYTES = 64 << 20, 32 << 20


NONE = np.iinfo(np.int64).min


def slices(x: np.ndarray, bits: int) -> np.ndarray:
    """[slice, row, word] bitmaps over the attributes of x [row, attribute]."""
    n, d = x.shape
    words = max(1, -(-d // 64))
    padded = np.zeros((n, words * 64), np.int64)
    padded[:, :d] = x
    out = np.empty((bits, n, words), np.uint64)
    for j in range(bits):
        plane = ((padded >> j) & 1).astype(np.uint8)
        out[j] = np.packbits(plane, axis=1, bitorder="little").view("<u8").reshape(n, words)
    return out


def width(x: np.ndarray) -> int:
    """Bits of two's complement that hold all of x."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0)
    return top.bit_length() + 1


class Queries:
    """A group of queries and the best rows found for each so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.bits = width(x)
        self.slices = slices(x, self.bits)
        self.up, self.down = np.maximum(x, 0).sum(1), np.minimum(x, 0).sum(1)
        self.score = np.full((len(ids), k), NONE)
        self.row = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.weight = [(-1 if i == self.bits - 1 else 1) << i for i in range(self.bits)]

    def add(self, ids: np.ndarray, planes: np.ndarray) -> None:
        """Hold the queries against a block of rows."""
        bits, n, words = planes.shape
        own = min(words, self.slices.shape[2])
        for lo in range(0, len(self.ids), TILE):
            hi = min(lo + TILE, len(self.ids))
            total = np.zeros((hi - lo, n), np.int64)
            mine = ids[None, :] == self.ids[lo:hi, None]  # rows of the query's own id are no candidates
            q_at = r_at = None  # places of the pairs still in play; all, at first
            for j in range(bits - 1, -1, -1):
                sign = -1 if j == bits - 1 else 1
                part = np.zeros(total.shape, np.int64)
                for i in range(self.bits):
                    count = np.zeros(total.shape, np.int64)
                    for w in range(own):
                        q, r = self.slices[i, lo:hi, w], planes[j, :, w]
                        both = q[:, None] & r[None, :] if q_at is None else q[q_at] & r[r_at]
                        count += np.bitwise_count(both)
                    count *= self.weight[i]
                    part += count
                total += part * (sign << j)
                # slices left add between down and up times 2^j - 1
                rest = (1 << j) - 1
                up, down = self.up[lo:hi] * rest, self.down[lo:hi] * rest
                if q_at is None:
                    known = self.score[lo:hi, -1]
                    if rest and n >= self.k:
                        kth = np.partition(np.where(mine, NONE, total), n - self.k, 1)[:, n - self.k]
                        known = np.maximum(known, np.where(kth > NONE, kth + down, NONE))
                    alive = (total + up[:, None] >= known[:, None]) & ~mine
                    if not rest or alive.sum() * 4 < alive.size:
                        q_at, r_at = np.nonzero(alive)
                        total = total[q_at, r_at]
                else:
                    alive = total + up[q_at] >= self.score[lo:hi, -1][q_at]
                    q_at, r_at, total = q_at[alive], r_at[alive], total[alive]
            self.keep(q_at + lo, ids[r_at], total)

    def keep(self, q: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        """Merge exact scores of pairs into the best k."""
        touched = np.unique(q)
        if not len(touched):
            return
        q = np.concatenate([q, np.repeat(touched, self.k)])
        rows, score = np.concatenate([rows, self.row[touched].ravel()]), np.concatenate([score, self.score[touched].ravel()])
        order = np.lexsort((rows, ~score, q))
        q, rows, score = q[order], rows[order], score[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        at = first[:, None] + np.arange(self.k)[None, :]
        self.row[touched], self.score[touched] = rows[at], score[at]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, row, score) of all that was kept."""
        q, r = np.nonzero(self.score > NONE)
        return q, self.row[q, r], self.score[q, r]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Quantised components [row, attribute], short rows filled with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy()
    flat = np.floor(pc.list_flatten(vectors).to_numpy().astype(np.float64) * SCALE)
    if np.abs(flat).max(initial=0) >= 1 << 31:
        raise ValueError("a component is too large for the index")
    out = np.zeros((len(vectors), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.astype(np.int64)
    return out


def usable(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """id, v of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def index(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """block, ids, planes (bit slices), bits, words: rows of vectors packed in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = matrix(part.column("v"))
                ids = part.column("id").to_numpy()
                bits = width(x)
                planes = slices(x, bits)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([planes.tobytes()], pa.binary()), pa.array([bits], pa.int32()), pa.array([planes.shape[2]], pa.int32())], ["block", "ids", "planes", "bits", "words"])

    return map_arrow(usable(vectors, column, key), pack, "block long, ids binary, planes binary, bits int, words int")


def query_groups(vectors: DataFrame, every: int, column: str = "embedding", key: str = "vec_id", group_bytes: int = QUERY_BYTES) -> tuple[DataFrame, int]:
    """id, digest, v of the queries with the number g of their group, and the number of groups."""
    digest = F.md5(F.array_join(F.transform("v", lambda x: F.floor(x * SCALE).cast("string")), ","))
    chosen = materialize(usable(vectors, column, key).filter(F.col("id") % every == 0).withColumn("digest", digest).dropDuplicates(["id", "digest"]), "queries")
    sizes = chosen.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    groups = max(1, -(-sizes["n"] * 8 * (sizes["d"] or 1) // group_bytes))
    return chosen.withColumn("g", F.pmod(F.xxhash64("id", "digest"), F.lit(groups)).cast("int")), groups


def search(vectors: DataFrame, k: int = K, every: int = EVERY, column: str = "embedding", key: str = "vec_id", group_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score, query_digest: the k best other rows of each row whose id `every` divides."""
    queries, groups = query_groups(vectors, every, column, key, group_bytes)

    blocks = materialize(index(vectors, column, key), "slices")
    # a task gets one group of queries and about BLOCK_BYTES of blocks
    sizes = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("planes")), F.lit(0)).alias("bytes")).first()
    salts = max(1, -(-sizes["bytes"] // BLOCK_BYTES), min(sizes["n"], 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    left = blocks.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({"query_id": pa.array([], pa.int64()), "query_digest": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        asked = asked.combine_chunks()
        own = Queries(asked.column("id").to_numpy(), matrix(asked.column("v").combine_chunks()), k)
        for ids, planes, bits, words in zip(*(rows.column(c) for c in ("ids", "planes", "bits", "words")), strict=True):  # a block at a time
            ids = np.frombuffer(ids.as_py(), np.int64)
            own.add(ids, np.frombuffer(planes.as_py(), np.uint64).reshape(bits.as_py(), len(ids), words.as_py()))
        q, row, score = own.found()
        return pa.table({"query_id": asked.column("id").take(q), "query_digest": asked.column("digest").take(q), "vec_id": row, "score": score})

    best = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(compare, "query_id long, query_digest string, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_digest").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_digest")


#: DuckDB's words for search() over embeddings.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id, e, md5(array_to_string(e, ',')) as query_digest from v where vec_id % 50 = 0),
s as (
  select q.vec_id as query_id, query_digest, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from q join v c on c.vec_id != q.vec_id)
select query_id, rank::int as rank, vec_id, score, query_digest
from (select *, row_number() over (partition by query_id, query_digest order by score desc, vec_id) as rank from s) where rank <= 5
"""
