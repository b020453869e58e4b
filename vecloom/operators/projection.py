"""The serving table: the live content map joined to its vectors, published as one scoped overwrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecloom.functions.identity import packed, projection_name, unpacked, vector_id
from vecloom.operators.content_map import live_entries
from vecloom.plans.spec import Spec
from vecloom.sources.catalog import Catalog
from vecloom.sources.schemas import LAYOUT, PROJECTION
from vecloom.sources.versioned import REPLACE, DataFile

SUMMARY = ("rows", "distinct-vectors", "embedding-dim", "config-id", "source-sequence-number", "unresolved-rows")


def distinct_vectors(store: DataFrame, spec: Spec, columns: Sequence[str] = ("embedding_dim", "embedding", "text")) -> DataFrame:
    """One vector for each content of a model and configuration (stores may hold a content twice), with the columns named."""
    return _by_hash(store, spec, columns).withColumn("content_hash", unpacked(F.col("__h"))).select("content_hash", *columns)


def _by_hash(store: DataFrame, spec: Spec, columns: Sequence[str], among: DataFrame | None = None, by_content: bool = False) -> DataFrame:
    """`distinct_vectors` with the packed hash __h (`by_content`: with the hash as it is), of the contents `among` some rows if these are named. One maximum of one struct: no column is shuffled twice."""
    rows, key, hash_ = store.filter((F.col("model_version") == spec.model_version) & (F.col("config_id") == spec.config_id)), "content_hash", F.col("content_hash")
    if not by_content:
        key, hash_ = "__h", packed(hash_)
        rows = rows.withColumn(key, hash_)
    if among is not None:
        rows = rows.join(among.select(hash_.alias(key)), key, "left_semi")
    best = F.max(F.struct("created_at", F.xxhash64("embedding").alias("__x"), *columns))
    return rows.groupBy(key).agg(best.alias("v")).select(key, *(f"v.{c}" for c in columns))


def resolved(live: DataFrame, store: DataFrame, spec: Spec, how: str = "inner", few: bool = False, by_content: bool = False) -> DataFrame:
    """Live entries with their vectors; with how="left", those without one too.

    `few`: they need a small part of the store, and the rest is left out before it is shuffled. `by_content`: the store is spread by content_hash already, and stays where it is.
    """
    if by_content:
        return live.join(_by_hash(store, spec, ("embedding_dim", "embedding", "text"), live if few else None, True), "content_hash", how)
    rows = live.withColumn("__h", packed(F.col("content_hash"))).drop("content_hash")
    return rows.join(_by_hash(store, spec, ("embedding_dim", "embedding", "text"), live if few else None), "__h", how).withColumn("content_hash", unpacked(F.col("__h"))).drop("__h")


def unresolved(live: DataFrame, store: DataFrame, spec: Spec) -> DataFrame:
    """Live entries that have no vector."""
    known = store.filter((F.col("model_version") == spec.model_version) & (F.col("config_id") == spec.config_id)).select("content_hash").distinct()
    return live.join(known, "content_hash", "left_anti")


def projection_rows(live: DataFrame, store: DataFrame, spec: Spec, build_ms: int, seen: Observation | None = None, few: bool = False, by_content: bool = False) -> DataFrame:
    """Rows of the serving table; created_at is one moment for the whole build. `seen` observes what `outlook` tells, but for distinct_vectors; `few` and `by_content` are those of `resolved`."""
    key = vector_id(F.col("source_table"), F.col("source_row_id"), F.col("source_snapshot_id"), F.col("chunk_ordinal"), F.lit(spec.model_name), F.lit(spec.embedding_version), F.col("config_id"))
    joined = resolved(live.drop("created_at", "deleted"), store, spec, "left" if seen else "inner", few, by_content)
    if seen:
        seq, has = F.col("source_sequence_number"), F.col("embedding").isNotNull()
        joined = joined.observe(seen, F.count_if(~has).alias("unresolved_rows"), F.min(F.when(~has, seq)).alias("low"), F.max(seq).alias("top"), F.min("embedding_dim").alias("min_dim"), F.max("embedding_dim").alias("max_dim")).filter(has)
    joined = joined.withColumn("vector_id", key).withColumn("created_at", F.timestamp_millis(F.lit(build_ms)))
    return joined.select(*PROJECTION.names)


def shape(rows: DataFrame) -> DataFrame:
    """n_rows, distinct_vectors, and the least and greatest width, of a projection."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("content_hash").alias("distinct_vectors"), F.min("embedding_dim").alias("min_dim"), F.max("embedding_dim").alias("max_dim"))


def outlook(live: DataFrame, store: DataFrame, spec: Spec) -> dict[str, int | None]:
    """What a projection will hold, from hashes alone: n_rows, distinct_vectors, min_dim and max_dim, unresolved_rows, covered_watermark.

    Live rows are counted by content before they meet the store, so that copies gather in no task.
    """
    seq = F.col("source_sequence_number")
    each = live.groupBy("content_hash").agg(F.count("*").alias("n"), F.min(seq).alias("low"), F.max(seq).alias("top")).join(distinct_vectors(store, spec, ["embedding_dim"]), "content_hash", "left")
    has, n = F.col("embedding_dim").isNotNull(), F.col("n")
    got = each.agg(
        F.coalesce(F.sum(F.when(has, n)), F.lit(0)).alias("n_rows"), F.count_if(has).alias("distinct_vectors"), F.min("embedding_dim").alias("min_dim"), F.max("embedding_dim").alias("max_dim"),
        F.coalesce(F.sum(F.when(~has, n)), F.lit(0)).alias("unresolved_rows"), F.min(F.when(~has, F.col("low"))).alias("low"), F.coalesce(F.max("top"), F.lit(0)).alias("top"),
    ).first().asDict()
    return got | {"covered_watermark": _watermark(got.pop("low"), got.pop("top"))}


def _watermark(low: int | None, top: int | None) -> int:
    """Up to where all is resolved: the newest row's sequence number, or just before the first unresolved one's."""
    return (top or 0) if low is None else max(0, min(top, low - 1))


class Publisher:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.spark = catalog, catalog.spark

    def name(self, spec: Spec) -> str:
        return projection_name(spec.source_table, spec.config_id)

    def current(self, spec: Spec) -> dict[str, str] | None:
        """The summary of the last build if all of its fields are there."""
        table = self.catalog.load(self.name(spec))
        builds = [c.summary for c in table.commits() if c.summary.get("config-id") == spec.config_id] if table else []
        return builds[-1] if builds and all(k in builds[-1] for k in SUMMARY) else None

    def newest(self, spec: Spec) -> int | None:
        """The content map's last version that holds something of this source and configuration; None if the log can't tell."""
        map_ = self.catalog.load("content_map")
        scope = {"source_table": spec.source_table, "config_id": spec.config_id}
        commits = map_.commits() if map_ else []
        own = [c.seq for c in commits if c.operation != REPLACE and any(all(f.partition.get(k) == v for k, v in scope.items()) for f in (*c.added, *c.removed))]
        return own[-1] if own else commits[0].seq - 1 if commits and commits[0].parent is not None else None

    def is_current(self, spec: Spec) -> bool:
        """Whether the published table holds all that the content map has of this source, with nothing unresolved."""
        had, newest = self.current(spec), self.newest(spec)
        if had is None or newest is None or had["unresolved-rows"] != "0":
            return False
        return had.get("map-version", "").isdigit() and int(had["map-version"]) >= newest

    def build(self, spec: Spec, as_of: int | None = None) -> dict[str, str]:
        """Publish the projection (as of a sequence number, if one is named); returns its summary.

        Skips a table that is current. Refuses to publish without Tier 1, to empty a table whose live rows have lost
        their vectors, and to mix widths; the version before stays in place then.
        """
        if as_of is None and self.is_current(spec):
            return self.current(spec) | {"skipped": "true"}
        map_, store = self.catalog.load("content_map"), self.catalog.load("embedding_store")
        if map_ is None or store is None:
            raise LookupError("there is no embedding store or content map to publish from")
        version = map_.version()[1]
        own = {"source_table": spec.source_table, "config_id": spec.config_id}
        history = map_.read(version, partition=own)
        live = live_entries(history, as_of)
        vectors = store.read(partition={"model_version": spec.model_version})
        # a store of one width can't mix widths; one of several is looked at by hashes before anything is written
        widths = vectors.filter(F.col("config_id") == spec.config_id).agg(F.min("embedding_dim").alias("min_dim"), F.max("embedding_dim").alias("max_dim")).first()
        if widths["min_dim"] != widths["max_dim"]:
            self._check(outlook(live, vectors, spec))
        # a source that holds a small part of the store's contents shuffles the vectors of that part alone
        few = 4 * map_.count(own) < store.count({"model_version": spec.model_version})
        scope = {"model_version": spec.model_version}
        by_content = store.buckets(scope) is not None and store.buckets(scope)[0] == "content_hash"
        if by_content:
            vectors = store.read_buckets(scope)
        seen = Observation()
        # the build counts as of the content map's commit, so that equal inputs give equal tables
        rows = projection_rows(live, vectors, spec, map_.current().ts_ms if map_.current() else 0, seen, few, by_content)
        table = self.catalog.load_or_create(self.name(spec), *LAYOUT["projection"])

        def summary(files: list[DataFile]) -> dict[str, object]:
            """Of the files that were written; they are committed if it doesn't refuse."""
            found = dict(seen.get) | {"n_rows": sum(f.rows for f in files)}
            self._check(found)
            distinct = table.read_files(files, ["content_hash"]).groupBy(packed(F.col("content_hash"))).count().count()
            return {
                "rows": found["n_rows"], "distinct-vectors": distinct, "embedding-dim": found["max_dim"] or 0, "config-id": spec.config_id,
                "source-sequence-number": _watermark(found["low"], found["top"]), "unresolved-rows": found["unresolved_rows"], "map-version": version if as_of is None else f"as-of-{as_of}",
            }

        scope = {"source_table": spec.source_table, "model_version": spec.model_version}
        return table.overwrite(rows, scope, summary, validate=False, rebalance=False, order=("content_hash", "source_row_id", "chunk_ordinal")).summary  # one partition, spread by content

    def _check(self, found: dict[str, int | None]) -> None:
        if not found["n_rows"] and found["unresolved_rows"]:
            raise ValueError(f"all {found['unresolved_rows']} live rows lack a vector: the published table is left as it is")
        if found["n_rows"] and found["min_dim"] != found["max_dim"]:
            raise ValueError(f"vectors of widths {found['min_dim']} to {found['max_dim']}: the published table is left as it is")

    def read(self, spec: Spec) -> DataFrame:
        return self.catalog.table(self.name(spec)).read(partition={"source_table": spec.source_table, "model_version": spec.model_version})

    def sample(self, spec: Spec, n: int = 10) -> DataFrame:
        """Up to n rows (1 to 100) of the published table."""
        return self.read(spec).limit(min(max(n, 1), 100))
