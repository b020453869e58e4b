"""The cluster index: spherical k-means, assignment as partitions, refits only when they are due."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.identity import EMPTY_COVERAGE, clustered_name, tree_digest
from vecloom.functions.vectors import unit_or_null
from vecloom.operators.content_map import live_entries
from vecloom.operators.projection import distinct_vectors
from vecloom.operators.search import probe, recall, top_k
from vecloom.plans.spec import Spec
from vecloom.sources.catalog import Catalog
from vecloom.sources.schemas import CENTROIDS, CLUSTERED, COVERAGE, LAYOUT
from vecloom.sources.shared import shared_dir
from vecloom.sources.versioned import CODEC

MAX_ROUNDS, GROWTH, MAX_CLUSTERS, FEW_BYTES = 25, 0.25, 4096, 8 << 20
FRESH, BEHIND, UNKNOWN = "FRESH", "BEHIND", "UNKNOWN"


def suggested_clusters(n: int) -> int:
    return 1 if n <= 4 else min(max(round(n**0.5), 2), MAX_CLUSTERS)


def fit(vectors: DataFrame, clusters: int, rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, int]:
    """Centroids of vectors (content_hash, embedding) and the rounds it took.

    Starts from every n/k-th vector in order of hash. A round assigns by cosine (the lowest id wins ties) and sums unit
    vectors by cluster in double, within each task first; only k sums ever reach the driver (or the tasks' own, where all
    of them take FEW_BYTES at most). An empty cluster c takes the c-th vector in order of hash. Stops when no assignment moves.
    """
    unit = vectors.select("content_hash", unit_or_null(F.col("embedding")).alias("u")).filter("u is not null")
    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/kmeans/{uuid.uuid4().hex}"
    unit.write.parquet(path)
    unit = spark.read.schema(unit.schema).parquet(path)
    n = unit.count()
    if not n:
        raise ValueError("there are no vectors to cluster")
    k = min(max(clusters, 1), n)
    # places in order of hash: counts by range give each start's rank without numbering all rows in one task
    seeds = _at_ranks(unit, [i * n // k for i in range(k)], n)
    centroids = np.array(seeds, np.float64)
    mark = None
    few = unit.rdd.getNumPartitions() * centroids.nbytes <= FEW_BYTES
    for done in range(rounds):
        sums = _round(unit, centroids, few)  # at most k of them
        now = tuple(sorted((c, n, m) for c, (n, m, _) in sums.items()))
        if now == mark:
            return centroids, done
        mark = now
        by = {c: s for c, (_, _, s) in sums.items()}
        empty = [c for c in range(k) if c not in by or not np.linalg.norm(by[c]) > 0]
        again = dict(zip(empty, _at_ranks(unit, empty, n), strict=True)) if empty else {}
        for c in range(k):
            centroids[c] = again[c] if c in again else (by[c] / np.linalg.norm(by[c])).astype(np.float32)
    return centroids, rounds


def covered(rows: DataFrame) -> str:
    """The digest of the contents of rows, folded by executors; one row reaches the driver."""
    found = tree_digest(rows).first()
    return found["digest"] if found else EMPTY_COVERAGE


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The most similar centroid of each vector, the lowest id among equals; zero vectors take 0."""
    norms = np.linalg.norm(centroids, axis=1)
    sims = vectors @ (centroids / np.where(norms > 0, norms, 1)[:, None]).T
    return sims.argmax(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> dict[int, list]:
    """[n, mark, s] by cluster over rows (c, n, mark, s)."""
    held: dict[int, list] = {}
    for batch in batches:
        for c, n, mark, x in zip(batch.column("c").to_pylist(), batch.column("n").to_pylist(), batch.column("mark").to_pylist(), batch.column("s"), strict=True):
            x = x.values.to_numpy()
            if c in held:
                held[c][0] += n
                held[c][1] += mark
                held[c][2] += x
            else:
                held[c] = [n, mark, x.copy()]
    return held


def _round(unit: DataFrame, centroids: np.ndarray, few: bool) -> dict[int, list]:
    """By cluster, its size, a checksum of its members, and its vector sum; summed by task first."""
    model = unit.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CLUSTERS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = model.value
        n, mark, s = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(at.shape)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("u"))
                c = nearest(x, at)
                n += np.bincount(c, minlength=len(at))
                np.add.at(mark, c, batch.column("mark").to_numpy())
                np.add.at(s, c, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(mark[own]), pa.array(list(s[own]), pa.list_(pa.float64()))], ["c", "n", "mark", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _summed(batches)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1] for h in held.values()], pa.int64()), pa.array([h[2] for h in held.values()], pa.list_(pa.float64()))], ["c", "n", "mark", "s"])

    schema = "c int, n long, mark long, s array<double>"
    parts = unit.select("u", F.pmod(F.xxhash64("content_hash"), F.lit(1 << 40)).alias("mark")).mapInArrow(run, schema)
    # a row of whole vectors for each task and cluster; sums of a cluster end in one task
    sums = parts if few else parts.repartition("c").mapInArrow(add, schema)
    return _summed(sums.toArrow().to_batches())


def _at_ranks(unit: DataFrame, ranks: Sequence[int], n: int) -> list[list[float]]:
    """The vectors at places of the order by content_hash."""
    rows = unit.withColumn("b", F.substring("content_hash", 1, 4))
    sizes = rows.groupBy("b").count().orderBy("b").collect()  # 65,536 rows at most for hexadecimal hashes
    starts, at = {}, 0
    for r in sizes:
        starts[r["b"]] = at
        at += r["count"]
    wanted = {}
    bounds = [(starts[r["b"]], starts[r["b"]] + r["count"], r["b"]) for r in sizes]
    i = 0
    for rank in ranks:
        while bounds[i][1] <= rank:
            i += 1
        wanted.setdefault(bounds[i][2], []).append(rank - bounds[i][0])
    from pyspark.sql import Window

    spark = unit.sparkSession
    pick = spark.createDataFrame([(b, p) for b, ps in wanted.items() for p in ps], "b string, p int")
    ranked = rows.filter(F.col("b").isin(list(wanted))).withColumn("p", F.row_number().over(Window.partitionBy("b").orderBy("content_hash")) - 1)
    got = ranked.join(F.broadcast(pick), ["b", "p"]).orderBy("content_hash").select("u").collect()  # k rows
    return [list(r["u"]) for r in got]


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with `cluster_id`; the centroids are broadcast, a batch is one matrix product."""
    model = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CLUSTERS vectors
    place = vectors.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = model.value
        for batch in batches:
            c = nearest(_matrix(batch.column(place)), at) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c.astype(np.int32))], [*batch.schema.names, "cluster_id"])

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("cluster_id", T.IntegerType())]))


def rank_clusters(query: Sequence[float], centroids: np.ndarray) -> list[int]:
    """Cluster ids from the nearest on, ties by id."""
    q = np.asarray(query, np.float64)
    norms = np.linalg.norm(centroids, axis=1) * np.linalg.norm(q)
    sims = np.divide(centroids @ q, norms, out=np.zeros(len(centroids)), where=norms > 0)
    return np.argsort(-sims, kind="stable").tolist()


@dataclass(frozen=True)
class Built:
    action: str
    reason: str
    contents: int
    clusters: int
    rounds: int = 0


class ClusterIndex:
    """The index of one catalog. Scopes are (source, model version, configuration)."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.spark = catalog, catalog.spark

    def _scope(self, spec: Spec) -> dict[str, object]:
        return {"source_table": spec.source_table, "model_version": spec.model_version, "config_id": spec.config_id}

    def canonical(self, spec: Spec, columns: Sequence[str] = ("embedding_dim", "embedding", "text")) -> DataFrame:
        """One row for each live content of the source that has a vector, with the columns named."""
        return self._canonical(*self._pinned(spec), spec, columns)

    def _pinned(self, spec: Spec) -> tuple[DataFrame, DataFrame]:
        """The scope's content map and vectors, as of now."""
        history = self.catalog.table("content_map").read(partition={"source_table": spec.source_table, "config_id": spec.config_id})
        return history, self.catalog.table("embedding_store").read(partition={"model_version": spec.model_version})

    def _canonical(self, history: DataFrame, store: DataFrame, spec: Spec, columns: Sequence[str]) -> DataFrame:
        return distinct_vectors(store, spec, columns).join(live_entries(history).select("content_hash").distinct(), "content_hash", "left_semi")

    def canonical_count(self, spec: Spec, limit: int = 2_000_000) -> tuple[int, bool]:
        """The number of canonical contents, and whether it is exact (counting stops past the limit)."""
        n = self.canonical(spec, ["embedding_dim"]).limit(limit + 1).count()
        return min(n, limit), n <= limit

    def _rows(self, name: str, schema, spec: Spec, scope: dict[str, object] | None = None) -> DataFrame:
        table = self.catalog.load(name)
        return table.read(partition=scope or self._scope(spec)) if table else self.spark.createDataFrame([], schema)

    def clustered(self, spec: Spec) -> DataFrame:
        scope = {k: v for k, v in self._scope(spec).items() if k != "source_table"}
        return self._rows(clustered_name(spec.source_table), CLUSTERED, spec, scope)

    def coverage(self, spec: Spec):
        return self._rows("vector_index_coverage", COVERAGE, spec).orderBy(F.desc("created_at")).first()

    def centroids(self, spec: Spec) -> np.ndarray | None:
        """The centroids by id; an error unless ids run from 0 without a gap."""
        rows = self._rows("vector_centroids", CENTROIDS, spec).orderBy("cluster_id").collect()  # at most MAX_CLUSTERS
        if not rows:
            return None
        if [r["cluster_id"] for r in rows] != list(range(len(rows))):
            raise ValueError("the ids of the centroids have gaps or repeat")
        return np.array([r["centroid"] for r in rows], np.float64)

    def build(self, spec: Spec, clusters: int | None = None, force: bool = False) -> Built:
        """Reuse, extend or refit the index, whichever the change of contents asks for.

        That is told by hashes alone; vectors and texts are read where they are indexed, from the same versions.
        """
        pinned = self._pinned(spec)
        path = f"{shared_dir(self.spark)}/index/{uuid.uuid4().hex}"
        self._canonical(*pinned, spec, ["embedding_dim"]).write.option("compression", CODEC).parquet(path)
        now = self.spark.read.schema("content_hash string, embedding_dim int").parquet(path)
        rows = self._canonical(*pinned, spec, ["embedding_dim", "embedding", "text"])
        n = now.count()
        if not n:
            raise ValueError("there are no canonical vectors to index")
        if now.select("embedding_dim").distinct().limit(2).count() > 1:
            raise ValueError("canonical vectors have different widths")
        digest, had, known = covered(now), self.coverage(spec), self.centroids(spec)
        indexed = self.clustered(spec)
        if not force and had is not None and known is not None and not indexed.isEmpty():
            if had["coverage_digest"] == digest:
                return Built("reused", "the index covers just these contents", n, len(known))
            removed = indexed.select("content_hash").join(now.select("content_hash"), "content_hash", "left_anti")
            added = now.join(indexed.select("content_hash"), "content_hash", "left_anti")
            base = had["refit_content_count"] or had["content_count"]
            if removed.isEmpty() and n > had["content_count"] and n <= base + max(1, int(base * GROWTH)):
                self._table(spec).append(self._clustered_rows(rows.join(added.select("content_hash"), "content_hash", "left_semi"), known, spec))
                self._cover(spec, digest, n, base)
                return Built("extended", "additions within the growth that the centroids bear", n, len(known))
        centroids, rounds = fit(self._canonical(*pinned, spec, ["embedding"]), clusters or suggested_clusters(n))
        self.install(spec, rows, centroids, digest, n)
        return Built("refitted", "contents were removed, outgrew the centroids, or had no index", n, len(centroids), rounds)

    def install(self, spec: Spec, vectors: DataFrame, centroids: np.ndarray, digest: str | None = None, n: int | None = None) -> None:
        """Make vectors (content_hash, embedding_dim, embedding, text), assigned to centroids, the index of a scope."""
        scope = {k: v for k, v in self._scope(spec).items() if k != "source_table"}
        self._table(spec).overwrite(self._clustered_rows(vectors, centroids, spec), scope)
        rows = [(*self._scope(spec).values(), i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        self.catalog.load_or_create("vector_centroids", *LAYOUT["vector_centroids"]).overwrite(self.spark.createDataFrame(rows, CENTROIDS), self._scope(spec))
        n = vectors.count() if n is None else n
        self._cover(spec, digest or covered(vectors), n, n)  # last: until then a reader sees the index as stale

    def _table(self, spec: Spec):
        return self.catalog.load_or_create(clustered_name(spec.source_table), *LAYOUT["clustered"])

    def _clustered_rows(self, vectors: DataFrame, centroids: np.ndarray, spec: Spec) -> DataFrame:
        rows = assign(vectors, centroids).withColumns({"model_version": F.lit(spec.model_version), "config_id": F.lit(spec.config_id)})
        return rows.select(*CLUSTERED.names)

    def _cover(self, spec: Spec, digest: str, n: int, base: int) -> None:
        import datetime

        row = [(*self._scope(spec).values(), digest, n, datetime.datetime.fromtimestamp(time.time()), base)]
        self.catalog.load_or_create("vector_index_coverage", *LAYOUT["vector_index_coverage"]).overwrite(self.spark.createDataFrame(row, COVERAGE), self._scope(spec))

    def freshness(self, spec: Spec) -> str:
        """FRESH if the index covers just the live contents, BEHIND if not, UNKNOWN without an index. Compares content, not counts."""
        had = self.coverage(spec)
        if had is None:
            return UNKNOWN
        now = covered(self.canonical(spec, ["embedding_dim"]))
        return FRESH if now == had["coverage_digest"] and now != EMPTY_COVERAGE else BEHIND

    def status(self) -> DataFrame:
        """Scopes with their clusters, contents and digest."""
        if self.catalog.load("vector_centroids") is None or self.catalog.load("vector_index_coverage") is None:
            return self.spark.createDataFrame([], "source_table string, model_version string, config_id string, clusters long, content_count long, coverage_digest string")
        scope = ["source_table", "model_version", "config_id"]
        c = self.catalog.table("vector_centroids").read().groupBy(*scope).agg(F.count("*").alias("clusters"))
        return c.join(self.catalog.table("vector_index_coverage").read().select(*scope, "content_count", "coverage_digest"), scope, "left")

    def cluster_sizes(self, spec: Spec) -> DataFrame:
        return self.clustered(spec).groupBy("cluster_id").count().orderBy("cluster_id")

    def search(self, spec: Spec, query: Sequence[float], k: int = 10, probes: int = 8, require_fresh: bool = False, include_exact: bool = False) -> dict[str, object]:
        """Top k of the nearest clusters: hits (DataFrame), the clusters probed, rows scanned and their share; with include_exact also recall."""
        if require_fresh and (state := self.freshness(spec)) != FRESH:
            raise RuntimeError(f"the index is {state}, and a fresh one was asked for")
        centroids = self.centroids(spec)
        if centroids is None:
            raise LookupError("there is no index for this scope")
        chosen = rank_clusters(query, centroids)[: max(1, probes)]
        table, scope = self.catalog.table(clustered_name(spec.source_table)), {"model_version": spec.model_version, "config_id": spec.config_id}
        part = table.read(partition=scope | {"cluster_id": chosen})
        hits = probe(part, chosen, query, k)
        sizes = {True: 0, False: 0}
        ids = {str(c) for c in chosen}
        for f in table.live_files():
            if all(f.partition.get(a) == b for a, b in scope.items()):
                sizes[f.partition.get("cluster_id") in ids] += f.rows
        total = sum(sizes.values())
        out: dict[str, object] = {"hits": hits, "probed_clusters": chosen, "rows_scanned": sizes[True], "total_rows": total, "fraction_scanned": sizes[True] / total if total else 0.0}
        if include_exact:
            exact = top_k(self.clustered(spec).drop("text"), query, k, "zero")
            out |= {"exact": exact, "recall": recall(hits, exact).first()["recall"]}
        return out
