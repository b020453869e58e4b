"""Embedders: DataFrames of distinct texts in, vectors out. A failed text is a row with an error, not a failed job."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.identity import packed, unpacked
from vecloom.plans.spec import Spec


class Embedder(Protocol):
    #: The model that it runs; None if it answers for any name.
    model: str | None

    def embed(self, texts: DataFrame) -> DataFrame:
        """content_hash, text -> content_hash, text, embedding (array<double>), error (null if it went well)."""

    def embed_query(self, text: str) -> list[float]: ...


class StoredVectors:
    """Deterministic, and expressible in SQL: a text's hash picks one of the vectors of a table."""

    model: str | None = None
    #: Texts are spread by slot on the way to their vectors, and copies of a content meet there: one comes back.
    drops_copies = True

    def __init__(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> None:
        self.vectors = vectors.select(F.col(key).alias("__id"), F.col(column).alias("__v"))
        self.n = vectors.count()

    def slot(self, content: Column) -> Column:
        return F.conv(F.substring(content, 1, 7), 16, 10).cast("long") % self.n

    def embed(self, texts: DataFrame) -> DataFrame:
        rows = texts.select(self.slot(F.col("content_hash")).alias("__slot"), packed(F.col("content_hash")).alias("__h"), "text")
        once = rows.repartition("__slot").dropDuplicates(["__slot", "__h"])  # spread by slot already, so texts are shuffled once
        return once.join(self.vectors, F.col("__slot") == F.col("__id"), "left").select(unpacked(F.col("__h")).alias("content_hash"), "text", F.col("__v").cast("array<double>").alias("embedding"), F.when(F.col("__v").isNull(), F.lit("no vector")).alias("error"))

    def vectors_of(self, contents: DataFrame) -> DataFrame:
        """content_hash -> __h (packed), embedding, error: what `embed` gives, for contents whose texts need not move."""
        rows = contents.select(self.slot(F.col("content_hash")).alias("__slot"), packed(F.col("content_hash")).alias("__h"))
        return rows.join(self.vectors, F.col("__slot") == F.col("__id"), "left").select("__h", F.col("__v").alias("embedding"), F.when(F.col("__v").isNull(), F.lit("no vector")).alias("error"))

    def embed_query(self, text: str) -> list[float]:
        slot = int(hashlib.sha256(text.encode()).hexdigest()[:7], 16) % self.n
        return [float(x) for x in self.vectors.filter(F.col("__id") == slot).first()["__v"]]


class Batched:
    """An embedder that calls a client on batches within each partition; batches that fail give rows with the error."""

    def __init__(self, client: Callable[[list[str]], list], batch: int = 64, attempts: int = 3, wait_s: float = 0.2, model: str | None = None) -> None:
        self.client, self.batch, self.attempts, self.wait_s, self.model = client, batch, attempts, wait_s, model

    def embed(self, texts: DataFrame) -> DataFrame:
        client, size, attempts, wait = self.client, self.batch, self.attempts, self.wait_s

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import time

            for rows in batches:
                for lo in range(0, rows.num_rows, size):
                    part = rows.slice(lo, size)
                    n, error, vectors = part.num_rows, None, None
                    for k in range(attempts):
                        try:
                            vectors = client(part.column("text").to_pylist())
                            if len(vectors) != n:
                                raise ValueError(f"{len(vectors)} vectors for {n} texts")
                            error = None
                            break
                        except Exception as e:  # an outside service: the rows carry what it said
                            error = f"{type(e).__name__}: {e}"[:500]
                            if k + 1 < attempts:
                                time.sleep(wait * 2**k)
                    found = [None] * n if error else [None if v is None else [float(x) for x in v] for v in vectors]
                    said = [error if error else "no vector" if v is None else None for v in found]
                    yield pa.RecordBatch.from_arrays([part.column("content_hash"), part.column("text"), pa.array(found, pa.list_(pa.float64())), pa.array(said, pa.string())], ["content_hash", "text", "embedding", "error"])

        return texts.select("content_hash", "text").mapInArrow(run, "content_hash string, text string, embedding array<double>, error string")

    def embed_query(self, text: str) -> list[float]:
        if not text.strip():
            raise ValueError("the query text is blank")
        return [float(x) for x in self.client([text])[0]]


def gaussian(dim: int = 384, model: str = "gaussian") -> Batched:
    """Unit vectors of Gaussians, seeded by all of SHA-256 over model and text."""

    def client(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(f"{model}\x1f{t}".encode()).digest(), "big")
            v = np.random.default_rng(seed).standard_normal(dim)
            out.append(v / np.linalg.norm(v))
        return out

    return Batched(client, batch=512, attempts=1, model=model)


def http(url: str, template: str = '{"input": {{texts}}}', pointer: str = "/data/*/embedding", headers: dict[str, str] | None = None, batch: int = 64, timeout: float = 60.0, model: str | None = None) -> Batched:
    """An external service: `{{texts}}` in the template becomes the JSON list, `pointer` leads to the vectors in the answer."""

    def client(texts: list[str]) -> list:
        import urllib.request

        body = template.replace("{{texts}}", json.dumps(texts)).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return resolve(json.load(answer), pointer)

    return Batched(client, batch, model=model)


TEMPLATES = {
    "openai": ('{"model": "{{model}}", "input": {{texts}}}', "/data/*/embedding"),
    "gemini": ('{"model": "{{model}}", "texts": {{texts}}}', "/embeddings/*/values"),
    "http": ('{"texts": {{texts}}}', "/embeddings"),
}


def external(kind: str, url: str, model: str = "", key: str | None = None, batch: int = 64) -> Batched:
    if kind not in TEMPLATES:
        raise ValueError(f"unknown provider: {kind!r}; known are {', '.join(TEMPLATES)}")
    template, pointer = TEMPLATES[kind]
    return http(url, template.replace("{{model}}", model), pointer, {"Authorization": f"Bearer {key}"} if key else None, batch, model=model or None)


def embedder_for(embedders: Embedder | Mapping[str, Embedder], spec: Spec) -> Embedder:
    """The embedder of a spec's model: texts and queries of one scope go through one model, and no other."""
    if isinstance(embedders, Mapping):
        if spec.model_name not in embedders:
            raise LookupError(f"there is no embedder for model {spec.model_name!r}; there are {', '.join(sorted(embedders))}")
        return embedders[spec.model_name]
    if embedders.model is not None and embedders.model != spec.model_name:
        raise LookupError(f"the embedder runs model {embedders.model!r}, not {spec.model_name!r}")
    return embedders


def resolve(value: object, pointer: str) -> object:
    """A JSON pointer in which `*` stands for every item of a list."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.strip("/").split("/") if p]
    for i, p in enumerate(parts):
        if p == "*":
            return [resolve(x, "/".join(parts[i + 1 :])) for x in value]
        value = value[int(p)] if isinstance(value, list) else value[p]
    return value
