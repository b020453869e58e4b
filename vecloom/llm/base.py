"""Shared helpers: materialisation in the shared folder, hold-out folds, Arrow batches bounded by bytes.

Worker memory: Spark is asked for Arrow batches of ARROW_BYTES at most (unless the session sets another bound), texts are
handled CHUNK_BYTES at a time, and what a step has learned or cached ends with its task, after which free memory goes
back to the system; idle workers that Spark keeps hold little.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources.shared import shared_dir

#: One run of white space between words, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python step handles at once.
CHUNK_BYTES = 5 << 18
#: Bytes of an Arrow batch between Spark and Python (one row at least).
ARROW_BYTES = 4 << 20

_made: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _made:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is materialised inside is deleted at the end, but for paths taken out of the list."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made[:] = [x for x in _made if x is not paths]
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has materialised; DataFrames that read it can't be used any more."""
    delete(spark, f"{shared_dir(spark)}/vecloom/{spark.sparkContext.applicationId}")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes, and workers that give memory back when a task ends."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if key not in conf.getAll:  # a bound that the session has set stays
        conf.set(key, str(ARROW_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give free memory back to the system, as far as the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: Column) -> Column:
    """crc32(key as text) mod 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def hash_below(key: Column, seed: int, bound: Column) -> Column:
    """A repeatable sample: true where key's hash, spread over [0, 1), lies under bound."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < bound * float(1 << 30)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches that hold about `size` bytes of text (one row at least), with their texts."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + (n or 0) > size:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, held = i, 0
            held += n or 0
        if start < len(lengths):
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()


def map_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], keep: str, out: str, column: str = "text") -> DataFrame:
    """Run make()(texts) -> columns over chunks of df; df's columns in `keep` (DDL) pass through, `out` (DDL) are new.

    If what make() returns has a function `done`, it is called at the end of a task.
    """
    names = [x.strip().split(" ")[0] for x in keep.split(",")]
    ddl = f"{keep}, {out}"
    schema = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in df.sparkSession.createDataFrame([], ddl).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for part, texts in text_chunks(batches, column):
                made = step(texts)
                columns = [part.column(f.name).cast(f.type) if f.name in names else pa.array(made[f.name], type=f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        finally:
            getattr(step, "done", int)()

    return map_arrow(df, run, ddl)


def _arrow(kind: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return plain[kind]
