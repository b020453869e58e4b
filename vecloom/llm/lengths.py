"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Texts are encoded whole with a public byte-level vocabulary; each partition sums its documents by length before the
shuffle, so that rows move in proportion to distinct lengths. Suffix sums over the lengths give, for every context
limit, how many documents reach it, the tokens they hold, and the corpus's tokens when each document is cut there.
Sums run in blocks of BLOCK lengths, then over the blocks' totals, so that no task orders all lengths.

Defined results. Null and empty texts have length 0 and are counted as documents. Repeated rows count each time.
An empty table gives an empty curve; its totals are 0 and its quantiles null. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.base import map_arrow, materialize, text_chunks
from vecloom.llm.pieces import load

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024

_encodings: dict = {}


def encoding(data: bytes, pattern: str = PATTERN):
    """The encoder of a ranks file, built once per worker; one is kept."""
    key = hash((data, pattern))
    if key not in _encodings:
        _encodings.clear()
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def histogram(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """n_tokens, n_docs from docs (text)."""
    data = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))  # a vocabulary, under a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(data.value).encode_ordinary
        total: dict[int, int] = {}
        for _, texts in text_chunks(batches):
            for n in [len(encode(t)) if t else 0 for t in texts]:
                total[n] = total.get(n, 0) + 1
            if len(total) > 1 << 20:
                yield batch_of(total)
                total = {}
        yield batch_of(total)

    def batch_of(total: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["n_tokens", "n_docs"])

    return map_arrow(docs.select("text"), run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def curve(hist: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, tokens_truncated (every document cut to n_tokens), docs_at_most, share_at_most."""
    rows = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up = Window.orderBy(F.col("block").desc())
    after = sums.select(
        "block",
        F.sum("d").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("from_d"), F.sum("t").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("from_t"),
        F.sum("d").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_d"),
        F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_t"),
        "d", "t",
    )
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = rows.withColumn("own_d", F.sum("n_docs").over(inner)).withColumn("own_t", F.sum("tokens").over(inner)).join(after, "block")
    docs, tokens = F.col("from_d") - F.col("d") + F.col("own_d"), F.col("from_t") - F.col("t") + F.col("own_t")
    return full.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("all_t") - tokens + F.col("n_tokens") * docs).alias("tokens_truncated"),
        (F.col("all_d") - docs + F.col("n_docs")).alias("docs_at_most"), ((F.col("all_d") - docs + F.col("n_docs")) / F.col("all_d")).alias("share_at_most"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, tokens, docs_cut: the corpus's tokens with every document cut to each of a few limits."""
    cut = [F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("docs_cut")) for x in limits]
    return hist.agg(F.array(*cut).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def quantile(full: DataFrame, q: float) -> int | None:
    """The least length that a share of q of the documents doesn't exceed, from curve(); counts are compared, not shares."""
    n, share = full.agg(F.max("docs_at_most")).first()[0], Fraction(str(q))
    if n is None:
        return None
    return full.filter(F.col("docs_at_most") >= -(-n * share.numerator // share.denominator)).agg(F.min("n_tokens")).first()[0]


def context_curve(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """The curve of docs (text)."""
    return curve(materialize(histogram(docs, path), "lengths"))
