"""A catalog of versioned tables below one root, discovery of tables, and settings for external catalogs."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecloom.sources.versioned import Store, VersionedTable

KINDS = ("hadoop", "hive", "rest", "glue", "nessie", "jdbc")


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def create_namespace(self, name: str) -> bool:
        """Idempotent; whether the folder is there."""
        store = Store(self.spark, self.path(name))
        return bool(store.fs.mkdirs(store.path("")))

    def load(self, name: str) -> VersionedTable | None:
        return VersionedTable(self.spark, self.path(name)) if VersionedTable.exists(self.spark, self.path(name)) else None

    def load_or_create(self, name: str, schema: StructType, partition_by: Iterable[str] = ()) -> VersionedTable:
        return self.load(name) or VersionedTable.create(self.spark, self.path(name), schema, partition_by, name)

    def table(self, name: str) -> VersionedTable:
        found = self.load(name)
        if found is None:
            raise LookupError(f"there is no table {name} below {self.root}")
        return found

    def drop(self, name: str) -> bool:
        found = self.load(name)
        if found is not None:
            found.drop()
        return found is not None


def discover(spark: SparkSession, root: str) -> DataFrame:
    """uuid, name, location, columns, partition_by, format_version, snapshots, last_seq of every table below root.

    Table files are listed and parsed by Spark tasks; only metadata is read.
    """
    # one folder a table; they are named one by one because Spark's listing leaves out names that begin with an underscore
    logs = [f"{root.rstrip('/')}/{p.removesuffix('/table.json')}" for p, _ in Store(spark, root).files("") if p.endswith("_log/table.json")]  # every table has its first description
    if not logs:
        return spark.createDataFrame([], "uuid string, name string, location string, columns string, partition_by array<string>, format_version int, snapshots long, last_seq long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(logs).filter(F.col("path").rlike("/_log/[^/]+\\.json$"))
    parts = files.select(F.regexp_extract("path", "^(.*)/_log/([^/]+)\\.json$", 1).alias("location"), F.regexp_extract("path", "/_log/([^/]+)\\.json$", 1).alias("entry"), F.decode("content", "UTF-8").alias("text"))
    log = parts.filter("entry rlike '^[0-9]+$'").groupBy("location").agg(F.count("*").alias("snapshots"), F.max(F.col("entry").cast("long")).alias("last_seq"))
    newest = parts.filter("entry rlike '^table'").groupBy("location").agg(F.max_by("text", "entry").alias("text"))
    meta = newest.select(
        "location", F.get_json_object("text", "$.uuid").alias("uuid"), F.get_json_object("text", "$.name").alias("name"), F.get_json_object("text", "$.schema").alias("columns"),
        F.element_at(F.from_json(F.get_json_object("text", "$.specs"), "array<array<string>>"), -1).alias("partition_by"), F.get_json_object("text", "$.format-version").cast("int").alias("format_version"),
    )
    return meta.join(log, "location", "left").select("uuid", "name", "location", "columns", "partition_by", "format_version", F.coalesce("snapshots", F.lit(0)).cast("long").alias("snapshots"), F.coalesce("last_seq", F.lit(0)).cast("long").alias("last_seq"))


def upsert_discovered(known: DataFrame, found: DataFrame) -> DataFrame:
    """known tables with what was found laid over them, by uuid."""
    fresh = found.select(F.col("uuid").alias("u"), *(F.col(c).alias(f"new_{c}") for c in found.columns if c != "uuid"))
    both = known.join(fresh, F.col("uuid") == F.col("u"), "full")
    return both.select(F.coalesce("u", "uuid").alias("uuid"), *(F.coalesce(f"new_{c}", c).alias(c) for c in known.columns if c != "uuid"))


def external_catalog(name: str, kind: str, warehouse: str, uri: str | None = None, options: dict[str, str] | None = None) -> dict[str, str]:
    """Spark settings for an external table catalog, where its runtime is on the class path; caching is off."""
    key = f"spark.sql.catalog.{name}"
    out = {key: "org.apache.iceberg.spark.SparkCatalog", f"{key}.warehouse": warehouse, f"{key}.cache-enabled": "false"}
    if kind in KINDS:
        if kind == "hadoop" and warehouse.split("://")[0] in ("s3", "s3a", "s3n", "gs", "abfs", "abfss"):
            raise ValueError("a hadoop catalog on an object store has no atomic rename; choose another kind")
        if kind in ("hadoop", "hive", "rest"):
            out[f"{key}.type"] = kind
        else:
            out[f"{key}.catalog-impl"] = {"glue": "org.apache.iceberg.aws.glue.GlueCatalog", "nessie": "org.apache.iceberg.nessie.NessieCatalog", "jdbc": "org.apache.iceberg.jdbc.JdbcCatalog"}[kind]
    elif "." in kind:
        out[f"{key}.catalog-impl"] = kind
    else:
        raise ValueError(f"unknown catalog: {kind!r}; known are {', '.join(KINDS)} or a class name")
    if kind in ("hive", "rest", "nessie", "jdbc") and not uri:
        raise ValueError(f"a {kind} catalog needs a uri")
    if uri:
        out[f"{key}.uri"] = uri
    if warehouse.startswith("s3://"):
        out[f"{key}.io-impl"] = "org.apache.iceberg.aws.s3.S3FileIO"
    elif "://" in warehouse:
        out[f"{key}.io-impl"] = "org.apache.iceberg.hadoop.HadoopFileIO"
    return out | {f"{key}.{k}": v for k, v in (options or {}).items()}


def describe(table: VersionedTable) -> str:
    return json.dumps({"name": table.name, "uuid": table.uuid, "columns": table.schema.names, "partition_by": table.partition_by} | table.status())
