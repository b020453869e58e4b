"""What derivation and publishing send through shuffles."""

import pytest
from conftest import DATA

from vecloom.operators import derive
from vecloom.plans.control import Control
from vecloom.plans.runner import Engine
from vecloom.plans.spec import Spec
from vecloom.registry import CHUNKED, SPEC, _stamped
from vecloom.sources.embedders import StoredVectors

SF = DATA / "sf0.001"


@pytest.fixture
def engine(spark, catalog):
    """An engine whose catalog holds documents and benchmark; joins are by shuffle, as they are on large tables."""
    if not SF.is_dir():
        pytest.skip("the driver's tables are not here")
    for name, columns in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").select(*columns)
        catalog.load_or_create(name, rows.schema).append(rows)
    return Engine(catalog, StoredVectors(spark.read.parquet(f"{SF}/embeddings.parquet")), Control(catalog, ":memory:"))


def _written(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _shuffled(spark, action) -> int:
    before = _written(spark)
    action()
    return _written(spark) - before


def test_chunks_and_vectors_are_shuffled_once_a_step(spark, engine):
    """chunked texts went through three shuffles with their hashes as text, and each publish shuffled the hashes twice more."""
    id_ = engine.control.admit(CHUNKED).id
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved = _shuffled(spark, lambda: engine.run_one(id_))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = engine.publisher.read(CHUNKED)
    assert rows.count() == int(engine.publisher.current(CHUNKED)["rows"]) > 1000
    assert moved / rows.count() < 1600


def test_a_small_source_shuffles_its_own_vectors(spark, engine):
    """publishing one source shuffled the vectors of all sources that share the store."""
    engine.run_one(engine.control.admit(SPEC).id)
    items, table = engine.catalog.table("benchmark").read().limit(3).collect(), engine.catalog.load_or_create("three", engine.catalog.table("benchmark").schema)
    table.append(spark.createDataFrame(items, table.schema))
    spec = Spec("three", ("item_id",), ("text",), "stored-vectors")
    engine.run_one(engine.control.admit(spec).id)
    table.append(spark.createDataFrame(items[:1], table.schema))
    moved = _shuffled(spark, lambda: engine.publisher.build(spec, as_of=9))
    assert engine.publisher.read(spec).count() == 3
    assert moved < 20_000


def test_a_source_that_lost_all_vectors_is_refused(spark, engine):
    """The refusal failed itself, for a name that wasn't there; what is published stays."""
    engine.run_one(engine.control.admit(SPEC).id)
    n = engine.publisher.read(SPEC).count()
    engine.deriver.store.delete_partition({"model_version": SPEC.model_version})
    with pytest.raises(ValueError, match=f"all {n} live rows lack a vector"):
        engine.publisher.build(SPEC, as_of=9)
    assert engine.publisher.read(SPEC).count() == n


def test_texts_with_copies_are_shuffled_once_to_their_vectors(spark, engine):
    """where some contents repeat, rows were shuffled to be told which chunks to leave out, and chunks once more to their vectors."""
    docs = engine.catalog.table("documents").read()
    rows = _stamped(docs.union(docs.withColumn("doc_id", docs.doc_id + 10_000).filter("doc_id % 4 = 0")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        moved = _shuffled(spark, lambda: engine.deriver.derive(rows, SPEC))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store = engine.deriver.store.read()
    assert store.count() == store.select("content_hash").distinct().count() == rows.filter("trim(text) != ''").select("text").distinct().count()
    assert moved < 1.9 * sum(len(r.text or "") for r in rows.collect())


def test_a_publish_leaves_the_store_where_it_is(spark, engine, monkeypatch):
    """each publish shuffled all texts and vectors of the store by content."""
    monkeypatch.setattr(derive, "FEW", 50)
    monkeypatch.setattr(derive, "ENOUGH", 1)
    id_, table, scope = engine.control.admit(SPEC).id, engine.catalog.table("documents"), {"model_version": SPEC.model_version}
    docs = table.read()

    def published() -> list:
        return sorted((int(r["source_row_id"]), r["text"], r["content_hash"], tuple(r["embedding"])) for r in engine.publisher.read(SPEC).collect())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        engine.run_one(id_)
        first = published()
        moved = _shuffled(spark, lambda: engine.publisher.build(SPEC, as_of=9))
        assert published() == first and len(first) == docs.filter("trim(text) != ''").count()
        assert moved < sum(len(r[1]) for r in first) / 5
        for n, kept in ((100, True), (2, False)):  # enough for the buckets, then too few: the store is read as any other
            table.append(docs.filter(docs.doc_id < n).select((docs.doc_id + 1000 * n).alias("doc_id"), docs.text.substr(5, 60 + n).alias("text")))
            engine.run_one(id_)
            assert (engine.deriver.store.buckets(scope) is not None) == kept
        last = published()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert last[: len(first)] == sorted(first) and len(last) > len(first)
    assert engine.publisher.current(SPEC)["unresolved-rows"] == "0" and not spark.catalog.listTables()
