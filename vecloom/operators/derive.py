"""Derivation: rows to texts, chunks and content hashes; novel content to vectors; rows to content."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecloom.functions import chunkers
from vecloom.functions.identity import canonical_text, content_hash, hash_prefix, packed, row_id, unpacked
from vecloom.functions.vectors import normalized
from vecloom.operators.content_map import is_invalid, live_ordinals
from vecloom.plans.spec import Spec
from vecloom.sources.embedders import Embedder, embedder_for
from vecloom.sources.schemas import LAYOUT
from vecloom.sources.catalog import Catalog
from vecloom.sources.shared import shared_dir
from vecloom.sources.versioned import APPEND, CODEC

#: Contents whose vectors are packed into few files before they are written; more are written where they are made.
FEW = 10_000
#: Contents in a bucket of the store, about; no fewer buckets than LEAST_BUCKETS. Later writes of less than ENOUGH a bucket go unbucketed.
BUCKET, LEAST_BUCKETS, ENOUGH = 8_192, 16, 100
#: Copies of a content that may pass through one task of an embedder that drops them (sorted, none is held); contents with more are looked up by place.
COPIES = 20_000
PLACE = ["source_row_id", "chunk_ordinal"]
REFUSED = ("array", "map", "struct", "binary", "void", "variant")


@dataclass(frozen=True)
class Counters:
    rows: int = 0
    chunks: int = 0
    distinct: int = 0
    cache_hits: int = 0
    inference_calls: int = 0
    failed: int = 0
    tombstones: int = 0

    @property
    def dedup_rate(self) -> float:
        return self.cache_hits / self.chunks if self.chunks else 0.0

    @property
    def inference_avoided(self) -> float:
        return 1 - self.inference_calls / self.chunks if self.chunks else 0.0

    def __add__(self, other: Counters) -> Counters:
        return Counters(*(getattr(self, f) + getattr(other, f) for f in self.__dataclass_fields__))


def check_columns(rows: DataFrame, spec: Spec) -> None:
    """Key and embedding columns must be there, and be plain values."""
    types = dict(rows.dtypes)
    missing = [c for c in spec.needed if c not in types]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(types)}")
    nested = [c for c in spec.needed if types[c].startswith(REFUSED)]
    if nested:
        raise ValueError(f"columns that cannot take part in an identity: {', '.join(nested)}")


def texted(rows: DataFrame, spec: Spec) -> DataFrame:
    """source_row_id and __text of each row with its stamps; a null source_row_id marks a bad row."""
    check_columns(rows, spec)
    text = canonical_text(spec.embedding_columns, spec.join_separator)
    return rows.select(row_id(spec.key_columns).alias("source_row_id"), text.alias("__text"), "__seq", "__snapshot_id", "__committed_at")


def planned(rows: DataFrame, spec: Spec) -> DataFrame:
    """source_row_id, chunks (ordinal, text) of each row with its stamps; a null source_row_id marks a bad row."""
    return texted(rows, spec).select("source_row_id", chunkers.of_spec(spec)(F.col("__text")).alias("chunks"), "__seq", "__snapshot_id", "__committed_at")


def slim(plan: DataFrame) -> DataFrame:
    """The plan with content hashes in place of texts: small enough to write and read again."""
    return plan.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["ordinal"].alias("ordinal"), content_hash(c["text"]).alias("content_hash"))))


def mapped(plan: DataFrame) -> DataFrame:
    """One row a chunk of a slim plan."""
    return plan.filter("source_row_id is not null").select("source_row_id", F.explode("chunks").alias("c"), "__seq", "__snapshot_id", "__committed_at").select("source_row_id", F.col("c.ordinal").alias("chunk_ordinal"), F.col("c.content_hash").alias("content_hash"), "__seq", "__snapshot_id", "__committed_at")


def exploded(plan: DataFrame) -> DataFrame:
    """One row a chunk, with its content hash."""
    return plan.filter("source_row_id is not null").select("source_row_id", F.explode("chunks").alias("c"), "__seq", "__snapshot_id", "__committed_at").select("source_row_id", F.col("c.ordinal").alias("chunk_ordinal"), F.col("c.text").alias("text"), content_hash(F.col("c.text")).alias("content_hash"), "__seq", "__snapshot_id", "__committed_at")


def distinct_content(chunks: DataFrame) -> DataFrame:
    """One text for each content hash; equal hashes have equal texts."""
    return chunks.select("content_hash", "text").dropDuplicates(["content_hash"])


def novel_content(contents: DataFrame, store: DataFrame, spec: Spec) -> DataFrame:
    """Contents that the store has no vector for, under this model and configuration."""
    known = store.filter((F.col("model_version") == spec.model_version) & (F.col("config_id") == spec.config_id)).select("content_hash").distinct()
    return contents.join(known, "content_hash", "left_anti")


def store_rows(embedded: DataFrame, spec: Spec) -> DataFrame:
    """Rows of the embedding store; vectors that are missing, empty or not finite stay out."""
    v = normalized(F.col("embedding")) if spec.normalize else F.col("embedding").cast("array<float>")
    good = embedded.filter("error is null and embedding is not null and size(embedding) > 0").filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.trim("content_hash") != "")
    return good.select(
        "content_hash", F.lit(spec.model_version).alias("model_version"), F.lit(spec.config_id).alias("config_id"), hash_prefix(F.col("content_hash")).alias("hash_prefix"),
        F.size("embedding").alias("embedding_dim"), v.alias("embedding"), "text", F.current_timestamp().alias("created_at"),
    )


def superseding(plan: DataFrame, live: DataFrame) -> DataFrame:
    """Tombstones for live chunks past a row's new count of chunks (the largest, if a row id repeats).

    A row without any chunk always gets one at ordinal 0, so that an older insert that comes late cannot revive it.
    """
    counts = plan.filter("source_row_id is not null").groupBy("source_row_id").agg(F.max(F.size("chunks")).alias("n"), F.max(F.struct("__seq", "__snapshot_id", "__committed_at")).alias("at"))
    beyond = counts.join(live, "source_row_id").filter(F.col("chunk_ordinal") >= F.col("n")).select("source_row_id", "chunk_ordinal", "at.*")
    empty = counts.filter("n = 0").select("source_row_id", F.lit(0).alias("chunk_ordinal"), "at.*")
    return beyond.union(empty).dropDuplicates(["source_row_id", "chunk_ordinal"])


def tombstones(rows: DataFrame, live: DataFrame) -> DataFrame:
    """A tombstone for every live chunk of rows (source_row_id and stamps); for ordinal 0 if none is known."""
    return rows.join(live, "source_row_id", "left").select("source_row_id", F.coalesce("chunk_ordinal", F.lit(0)).alias("chunk_ordinal"), "__seq", "__snapshot_id", "__committed_at")


def map_rows(chunks: DataFrame, spec: Spec, deleted: bool) -> DataFrame:
    """Rows of the content map from chunks, or from tombstones."""
    content = F.lit(None).cast("string") if deleted else F.col("content_hash")
    return chunks.select(
        F.lit(spec.source_table).alias("source_table"), "source_row_id", "chunk_ordinal", content.alias("content_hash"), F.lit(spec.config_id).alias("config_id"), F.lit(spec.model_version).alias("model_version"),
        F.col("__snapshot_id").alias("source_snapshot_id"), F.col("__seq").alias("source_sequence_number"), F.col("__committed_at").alias("source_committed_at"), F.lit(deleted).alias("deleted"), F.current_timestamp().alias("created_at"),
    )


class Deriver:
    """Derives rows into the catalog's embedding store and content map.

    Commits come in the order vectors, then pointers: a failure between them leaves vectors that nothing points at, and
    the next run finds them as known content. Intermediate results are written once to the shared folder.
    """

    def __init__(self, catalog: Catalog, embedders: Embedder | Mapping[str, Embedder]) -> None:
        """embedders: one, or one by model name."""
        self.catalog, self.embedders, self.spark = catalog, embedders, catalog.spark
        self.store = catalog.load_or_create("embedding_store", *LAYOUT["embedding_store"])
        self.map = catalog.load_or_create("content_map", *LAYOUT["content_map"])

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        import uuid

        path = f"{shared_dir(self.spark)}/derive/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def history(self, spec: Spec) -> DataFrame:
        return self.map.read(partition={"source_table": spec.source_table, "config_id": spec.config_id})

    def derive(self, rows: DataFrame, spec: Spec, batch_key: str | None = None) -> Counters:
        """Derive stamped rows; with a batch_key, at most once."""
        if batch_key and any(c.summary.get("batch-key") == batch_key for c in self.map.commits()):
            return Counters()
        source = planned(rows, spec)
        # counters are observed where rows are written, so that nothing is read again for them
        seen = Observation()
        size = F.when(F.col("source_row_id").isNotNull(), F.size("chunks")).otherwise(0)
        plan = self._kept(slim(source).observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("chunks"), F.count_if(F.col("source_row_id").isNull()).alias("bad")), "plan")
        sums = seen.get
        chunks = mapped(plan)
        store = self.store.read(partition={"model_version": spec.model_version})
        known = store.filter(F.col("config_id") == spec.config_id).select(packed(F.col("content_hash")).alias("__known")).distinct()
        contents = chunks.groupBy(packed(F.col("content_hash")).alias("__h")).agg(F.min(F.struct(*PLACE)).alias("at"), F.count("*").alias("n")).join(known, F.col("__h") == F.col("__known"), "left")
        found = Observation()
        contents = self._kept(contents.select(unpacked(F.col("__h")).alias("content_hash"), "at", "n", F.col("__known").isNull().alias("novel")).observe(found, F.count(F.lit(1)).alias("all"), F.count_if("novel").alias("novel"), F.count_if(~F.col("novel") | (F.col("n") > COPIES)).alias("awkward"), F.count_if(F.col("n") > COPIES).alias("crowded")), "contents")
        n_distinct, n_novel = found.get["all"], found.get["novel"]
        embedder = embedder_for(self.embedders, spec)
        copies = getattr(embedder, "drops_copies", False)
        novel = contents.filter("novel").select("content_hash")
        good, kept_plan, n_held = chunks, plan, 0
        if n_novel:  # texts are read again for novel content alone, and never written but with their vectors
            made = Observation()
            buckets = self._buckets(spec, embedder, n_novel)
            if buckets and sums["chunks"] - n_novel <= n_novel and not found.get["crowded"]:  # vectors go to the texts, in the bucket that they are written to
                texts = exploded(planned(rows, spec)).select("content_hash", "text").repartition(buckets[1], "content_hash").dropDuplicates(["content_hash"])
                embedded = texts.join(embedder.vectors_of(novel).withColumn("content_hash", unpacked(F.col("__h"))).drop("__h"), "content_hash")
            else:
                embedded = embedder.embed(self._texts(rows, spec, plan, contents, n_novel, sums["chunks"], COPIES if copies else 1, copies and not found.get["awkward"]))
            vectors = store_rows(embedded, spec).observe(made, F.min("embedding_dim").alias("least"), F.max("embedding_dim").alias("most"))
            files = self.store.stage(vectors, n_novel <= FEW, buckets=buckets)
            if made.get["least"] != made.get["most"]:
                raise ValueError(f"vectors of different widths: {made.get['least']} to {made.get['most']}")
            if files:
                self.store.commit(APPEND, files)
            if sum(f.rows for f in files) < n_novel:
                lost = novel.join(self.store.read_files(files), "content_hash", "left_anti")
                held = self._kept(chunks.join(lost, "content_hash", "left_semi").select("source_row_id").distinct(), "held")
                n_held = held.count()
                good, kept_plan = chunks.join(held, "source_row_id", "left_anti"), plan.join(held, "source_row_id", "left_anti")
        gone = superseding(kept_plan, live_ordinals(self.history(spec), kept_plan))
        n_gone = self._append(map_rows(gone, spec, True), {"batch-key": batch_key} if batch_key else {}, map_rows(good, spec, False))
        return Counters(sums["rows"], sums["chunks"], n_distinct, sums["chunks"] - n_novel, n_novel, sums["bad"] + n_held, n_gone)

    def _buckets(self, spec: Spec, embedder: Embedder, n: int) -> tuple[str, int] | None:
        """The buckets by content that n new rows of the store go to, so that no publish shuffles the store; None if they go unbucketed.

        For whole texts, which are larger than vectors, and embedders that know vectors by hash: then it costs no shuffle more.
        """
        if (spec.chunker or "").strip().lower() not in ("", "whole") or not hasattr(embedder, "vectors_of"):
            return None
        scope = {"model_version": spec.model_version}
        if self.store.count(scope):
            had = self.store.buckets(scope)
            return had if had and n >= ENOUGH * had[1] else None
        return ("content_hash", max(LEAST_BUCKETS, 1 << (n // BUCKET).bit_length())) if n > FEW else None

    def _texts(self, rows: DataFrame, spec: Spec, plan: DataFrame, contents: DataFrame, n_novel: int, n_chunks: int, copies: int, whole: bool) -> DataFrame:
        """content_hash, text: one row for each novel content; up to so many `copies`, if the embedder drops them. `whole`: no content is known or has more.

        By hashes alone each content has a chunk (`at`) that gives it its text. The chunks to leave out, or to take, are
        named by row and ordinal, whichever are fewer: while these are few, no text is shuffled; else rows are, each text
        once, and chunked where they arrive. Rows whose id repeats can't be told apart by it; then texts are gathered
        by content.
        """
        chunks = exploded(planned(rows, spec))
        if whole and n_chunks - n_novel <= n_novel:
            return chunks.select("content_hash", "text")
        if not plan.filter("source_row_id is not null").groupBy("source_row_id").count().filter("count > 1").isEmpty():
            return distinct_content(chunks.join(contents.filter("novel").select("content_hash"), "content_hash", "left_semi"))
        if n_chunks == n_novel:
            return chunks.select("content_hash", "text")
        if n_chunks - n_novel > n_novel:
            places, how, chosen = contents.filter("novel").select("at.*"), "inner", lambda c: F.array_contains("__ordinals", c["ordinal"])
        else:
            shared = contents.filter(f"n > {copies} or not novel").select(packed(F.col("content_hash")).alias("__h"), "at", "novel")
            each = mapped(plan).select(packed(F.col("content_hash")).alias("__h"), *PLACE)
            places = self._kept(each.join(shared, "__h").filter(~F.col("novel") | (F.struct(*PLACE) != F.col("at"))).select(*PLACE), "others")
            how, chosen = "left", lambda c: F.col("__ordinals").isNull() | ~F.array_contains("__ordinals", c["ordinal"])
        ordinals = places.groupBy("source_row_id").agg(F.collect_list("chunk_ordinal").alias("__ordinals"))  # no more than the row has chunks
        picked = texted(rows, spec).filter("source_row_id is not null").select("source_row_id", "__text").join(ordinals, "source_row_id", how)
        return picked.select(F.explode(F.filter(chunkers.of_spec(spec)(F.col("__text")), chosen)).alias("c")).select(content_hash(F.col("c.text")).alias("content_hash"), F.col("c.text").alias("text"))

    def embedded(self, spec: Spec) -> DataFrame:
        """content_hash of all that has a vector under a spec's model and configuration; the store itself is the record."""
        rows = self.store.read(partition={"model_version": spec.model_version})
        return rows.filter(F.col("config_id") == spec.config_id).select("content_hash").distinct()

    def delete(self, rows: DataFrame, spec: Spec) -> int:
        """Tombstones for rows (source_row_id, __seq, __snapshot_id, __committed_at)."""
        return self._append(map_rows(tombstones(rows, live_ordinals(self.history(spec), rows)), spec, True), {})

    def _append(self, gone: DataFrame, summary: dict[str, str], entries: DataFrame | None = None) -> int:
        """Commit tombstones, and entries if there are any; says how many tombstones. A bad one fails the write before the commit.

        Entries are of one partition, and written where they are made: no shuffle spreads them again.
        """
        refuse = F.raise_error(F.lit("a content map entry without content, table, row or configuration")).cast("boolean")
        checked = F.when(is_invalid(), refuse).otherwise(True)
        dead = self.map.stage(gone.filter(checked))
        files = dead + (self.map.stage(entries.filter(checked), rebalance=False) if entries is not None else [])
        if summary or files:
            self.map.commit(APPEND, files, summary=summary)
        return sum(f.rows for f in dead)
