import pytest
from pyspark.sql import functions as F

from vecloom.operators.content_map import live_entries
from vecloom.operators.derive import Deriver, store_rows
from vecloom.operators.ivf import BEHIND, FRESH, UNKNOWN
from vecloom.plans import control as K
from vecloom.plans.runner import Engine
from vecloom.plans.spec import Spec
from vecloom.sources.catalog import Catalog
from vecloom.sources.embedders import Batched, external, gaussian, resolve
from vecloom.streaming.micro import derive_stream

SPEC = Spec("src", ("id",), ("name", "description"), "gaussian")
SCHEMA = "id string, name string, description string"


class Counting:
    """An embedder that counts texts on the driver."""

    model = None

    def __init__(self):
        self.inner, self.asked = gaussian(8), 0

    def embed(self, texts):
        self.asked += texts.count()
        return self.inner.embed(texts)

    def embed_query(self, text):
        return self.inner.embed_query(text)


@pytest.fixture
def engine(spark, catalog):
    return Engine(catalog, Counting())


def put(engine, *items):
    rows = engine.spark.createDataFrame(list(items), SCHEMA)
    table = engine.catalog.load_or_create("src", rows.schema)
    table.append(rows)
    return table


def items(lo, hi, texts):
    return [(f"r{i}", "n", f"text {i % texts}") for i in range(lo, hi)]


def published(engine, spec=SPEC):
    return sorted((r["source_row_id"], r["text"]) for r in engine.publisher.read(spec).collect())


def test_cost_follows_novel_content(engine):
    put(engine, *items(0, 500, 50))
    id_ = engine.control.admit(SPEC).id
    first = engine.run_one(id_)
    assert first["mode"] == "backfill" and first["counters"].inference_calls == 50 and first["counters"].rows == 500
    put(engine, *[(f"s{i}", "n", f"new {i % 50}") for i in range(300)])
    assert engine.run_one(id_)["counters"].inference_calls == 50
    put(engine, *[(f"d{i}", "n", f"text {i % 50}") for i in range(300)])
    third = engine.run_one(id_)["counters"]
    assert third.inference_calls == 0 and third.cache_hits == 300 and third.inference_avoided == 1.0
    assert engine.run_one(id_)["mode"] == "current" and engine.embedders.asked == 100
    assert len(published(engine)) == 1100
    assert engine.control.metrics()["src", SPEC.config_id]["rows"] == 1100
    best = engine.search(SPEC, "n text 7", 3).collect()
    assert best[0]["text"] == "n text 7" and best[0]["similarity"] == pytest.approx(1.0, abs=1e-5)


def test_update_delete_reconcile_and_provenance(engine):
    table = put(engine, ("a", "x", "one"), ("b", "y", "two"), ("c", "z", None))
    id_ = engine.control.admit(SPEC).id
    engine.run_one(id_)
    assert published(engine) == [("a", "x one"), ("b", "y two"), ("c", "z ")]
    put(engine, ("a", "x", "three"))
    engine.run_one(id_)
    assert dict(published(engine))["a"] == "x three"
    table.delete_where(F.col("id") == "b")
    got = engine.run_one(id_)
    assert got["mode"] == "reconcile" and [r[0] for r in published(engine)] == ["a", "c"]
    seen = engine.provenance(SPEC, "b")
    assert seen["note"] == "deleted" and [h["superseded"] for h in seen["history"]] == [True, False]
    assert engine.provenance(SPEC, "a")["note"] == "resolved" and engine.provenance(SPEC, "nobody")["note"] == "never derived"
    table.delete_where(F.lit(True))
    with pytest.raises(ValueError, match="refused"):
        engine.run_one(id_)
    assert engine.control.get(id_)["state"] == "DEGRADED" and len(published(engine)) == 2


def test_one_pass_equals_five(engine, spark, tmp_path):
    from vecloom.sources.catalog import Catalog

    rows = items(0, 50, 17)
    put(engine, *rows)
    engine.run_one(engine.control.admit(SPEC).id)
    other = Engine(Catalog(spark, f"file://{tmp_path}/second"), Counting())
    put(other, *rows[:10])
    id_ = other.control.admit(SPEC).id
    for lo in range(0, 50, 10):
        if lo:
            put(other, *rows[lo : lo + 10])
        other.run_one(id_)
    assert published(engine) == published(other) and engine.embedders.asked == other.embedders.asked == 17


@pytest.mark.parametrize("names", [["a", "b", "c"], ["a", "b", "c", "d", "a"], ["a", "a", "a", "b", "a"], ["a", "b", "known", "c"], ["known", "known", "a"]])
@pytest.mark.parametrize("repeated", [False, True])
def test_each_novel_content_is_embedded_once(engine, names, repeated):
    def stamped(pairs):
        return engine.spark.createDataFrame([(i, "n", t) for i, t in pairs], SCHEMA).withColumns({c: F.lit(1).cast("long") for c in ("__seq", "__snapshot_id", "__committed_at")})

    engine.deriver.derive(stamped([("k", "known")]), SPEC)
    rows = [(f"r{i}", t) for i, t in enumerate(names)]
    engine.embedders.asked = 0
    got = engine.deriver.derive(stamped(rows + (rows[:1] + [("r1", "other")] if repeated else [])), SPEC)
    novel = ({*names} | ({"other"} if repeated else set())) - {"known"}
    assert engine.embedders.asked == got.inference_calls == len(novel)
    assert sorted(r["text"] for r in engine.deriver.store.read().collect()) == sorted(f"n {t}" for t in novel | {"known"})


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))


def test_texts_are_shuffled_once_from_source_to_serving_table(engine, spark, monkeypatch):
    import base64
    import os

    from vecloom.operators import derive

    monkeypatch.setattr(derive, "FEW", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        texts = [(f"r{i}", "n", base64.b64encode(os.urandom(15_000)).decode()) for i in range(200)]
        put(engine, *texts)
        id_ = engine.control.admit(SPEC).id
        before = shuffled(spark)
        engine.run_one(id_)
        assert shuffled(spark) - before < 1.5 * sum(len(t) for *_, t in texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert published(engine) == sorted((i, f"n {t}") for i, _, t in texts)


def test_an_index_that_is_current_moves_no_texts(engine, spark):
    import base64
    import os

    texts = [(f"r{i}", "n", base64.b64encode(os.urandom(15_000)).decode()) for i in range(100)]
    put(engine, *texts)
    engine.run_one(engine.control.admit(SPEC).id)
    assert engine.index.build(SPEC, 2).action == "refitted"
    before = shuffled(spark)
    assert engine.index.build(SPEC).action == "reused"
    assert shuffled(spark) - before < 0.2 * sum(len(t) for *_, t in texts)


def test_a_refused_build_writes_nothing(engine, spark):
    put(engine, *items(0, 4, 2))
    engine.run_one(engine.control.admit(SPEC).id)
    table = engine.catalog.table(engine.publisher.name(SPEC))
    files = len(table.store.files("data"))
    narrow = spark.createDataFrame([("c" * 64, "", [1.0], None)], "content_hash string, text string, embedding array<double>, error string")
    engine.deriver.store.append(store_rows(narrow, SPEC))
    entry = engine.deriver.history(SPEC).limit(1).withColumns({"source_row_id": F.lit("new"), "content_hash": F.lit("c" * 64)})
    engine.deriver.map.append(entry)
    with pytest.raises(ValueError, match="widths 1 to 8"):
        engine.publisher.build(SPEC)
    assert len(table.store.files("data")) == files and engine.publisher.read(SPEC).count() == 4


def test_fewer_chunks_leave_tombstones(engine):
    spec = Spec("src", ("id",), ("description",), "gaussian", chunker="fixed", chunk_size=10, chunk_overlap=5)
    put(engine, ("a", "n", "0123456789abcdefghij"))
    id_ = engine.control.admit(spec).id
    engine.run_one(id_)
    assert len(published(engine, spec)) == 3
    put(engine, ("a", "n", "0123456789"))
    assert engine.run_one(id_)["counters"].tombstones == 2
    assert published(engine, spec) == [("a", "0123456789")]
    put(engine, ("a", "n", "  "))
    engine.run_one(id_)
    assert published(engine, spec) == []


def test_failed_texts_hold_their_rows_back(spark, catalog):
    def client(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0]] * len(texts)

    deriver = Deriver(catalog, Batched(client, batch=1, attempts=1))
    stamp = [F.lit(1).cast("long").alias(c) for c in ("__seq", "__snapshot_id", "__committed_at")]
    rows = spark.createDataFrame([("a", "n", "fine"), ("b", "n", "bad"), (None, "n", "x")], SCHEMA).select("*", *stamp)
    got = deriver.derive(rows, SPEC, "k")
    assert (got.rows, got.failed) == (3, 2) and [r["source_row_id"] for r in live_entries(deriver.history(SPEC)).collect()] == ["a"]
    assert deriver.derive(rows, SPEC, "k").rows == 0
    with pytest.raises(ValueError, match="no column"):
        deriver.derive(rows.drop("name"), SPEC)
    with pytest.raises(ValueError, match="identity"):
        deriver.derive(rows.withColumn("name", F.array("name")), SPEC)


def test_index_life(engine):
    put(engine, *items(0, 40, 40))
    id_ = engine.control.admit(SPEC).id
    engine.run_one(id_)
    index = engine.index
    assert index.freshness(SPEC) == UNKNOWN
    built = index.build(SPEC, clusters=4)
    assert (built.action, built.contents, built.clusters) == ("refitted", 40, 4) and index.freshness(SPEC) == FRESH
    assert index.build(SPEC).action == "reused"
    assert sum(r["count"] for r in index.cluster_sizes(SPEC).collect()) == 40 and index.status().first()["clusters"] == 4
    put(engine, ("new", "n", "a new text"))
    engine.run_one(id_)
    assert index.freshness(SPEC) == BEHIND
    with pytest.raises(RuntimeError, match="BEHIND"):
        engine.probe(SPEC, "n text 1", require_fresh=True)
    assert index.build(SPEC).action == "extended"
    got = engine.probe(SPEC, "n text 1", 5, probes=4, include_exact=True)
    assert got["recall"] == 1.0 and got["fraction_scanned"] == 1.0 and got["total_rows"] == 41
    one = engine.probe(SPEC, "n text 1", 5, probes=1)
    assert one["rows_scanned"] < 41 and one["hits"].first()["text"] == "n text 1"
    engine.catalog.table("src").delete_where(F.col("id") == "new")
    engine.run_one(id_)
    assert index.build(SPEC, clusters=4).action == "refitted"


def test_publisher_skips_and_refuses(engine):
    put(engine, *items(0, 5, 5))
    engine.run_one(engine.control.admit(SPEC).id)
    p = engine.publisher
    assert p.is_current(SPEC) and p.build(SPEC)["skipped"] == "true"
    assert p.build(SPEC, as_of=0)["rows"] == "0" and not p.is_current(SPEC)
    assert p.build(SPEC)["rows"] == "5" and p.sample(SPEC, 1000).count() == 5


# -- control

def test_admission(engine):
    put(engine, ("a", "n", "d"))
    bad = engine.control.admit(Spec("src", ("id", "no,pe"), ("name", "zz"), "", chunker="fixed", chunk_size=5, chunk_overlap=5), dry_run=True)
    assert len(bad.problems) >= 5
    with pytest.raises(K.Rejected):
        engine.control.admit(Spec("nowhere", ("id",), ("name",), "m"))
    assert engine.control.admit(SPEC, dry_run=True).id is None
    engine.control.admit(SPEC)
    with pytest.raises(K.AlreadyExists):
        engine.control.admit(SPEC)
    engine.catalog.table("src").append(engine.spark.createDataFrame([(None, "n", "d")], SCHEMA))
    assert any("nulls" in p for p in engine.control.admit(SPEC, dry_run=True).problems)


def test_states_and_promotion(engine):
    put(engine, ("a", "n", "d"))
    c = engine.control
    id_ = c.admit(SPEC, freshness_s=0).id
    with pytest.raises(K.IllegalTransition):
        c.live(id_, 1)
    with pytest.raises(K.IllegalTransition):
        c.promote(id_)
    engine.run_one(id_)
    assert c.promote(id_)["serving"] == 1 and c.blockers(id_) == []
    assert c.live(id_, 0)["watermark"] == 1
    c.pause(id_)
    c.pause(id_)
    assert c.resume(id_)["state"] == "LIVE"
    c.degraded(id_, "why")
    again = c.resume(id_)
    assert (again["state"], again["watermark"], again["last_error"]) == ("BACKFILLING", 0, "why")
    engine.run_one(id_)
    put(engine, ("b", "n", "d"))
    c.clock = lambda: 1e12
    assert c.progress(id_)["lag"] == 1 and c.progress(id_)["sla_breached"]
    assert c.retire(id_)["state"] == "RETIRING" and c.complete_retire(id_)["state"] == "RETIRED"
    for to in K.TRANSITIONS:
        assert to not in K.TRANSITIONS["RETIRED"]


def test_queue(catalog):
    now = [1000.0]
    c = K.Control(catalog, clock=lambda: now[0])
    assert c.enqueue("m", [("f1", 1, 1, 10), ("f2", 1, 2, 10)], "BACKFILL") == 2 and c.enqueue("m", [("f1", 1, 1, 10)]) == 0
    c.enqueue("m", [("f3", 2, 3, 10)])
    leased = c.lease("w1", 2, 10)
    assert [x["path"] for x in leased] == ["f3", "f1"] and [x["path"] for x in c.lease("w2")] == ["f2"]
    first = leased[0]["dedup"]
    assert not c.complete(first, "w2") and not c.fail(first, "w2", "e")
    assert c.complete(first, "w1", [("m:v1", "c", "h")]) and c.complete(first, "w1", [("m:v1", "c", "h")])
    assert c.embedded_probe("m:v1", "c", ["h", "x"]) == {"h"} and c.embedded_count("m:v1", "c") == 1
    now[0] += 400
    assert c.reclaim() == 2 and c.queue_depth() == {"DONE": 1, "PENDING": 2}
    for _ in range(2):
        for x in c.lease("w1"):
            c.fail(x["dedup"], "w1", "e")
    assert c.queue_depth() == {"DONE": 1, "FAILED": 2} and c.lease("w1") == []


def test_cycle_isolates_failures(engine):
    put(engine, ("a", "n", "d"))
    good = engine.control.admit(SPEC).id
    rows = engine.spark.createDataFrame([("x", "n", "d")], SCHEMA)
    engine.catalog.load_or_create("gone", rows.schema).append(rows)
    lost = engine.control.admit(Spec("gone", ("id",), ("name",), "gaussian")).id
    engine.catalog.drop("gone")
    out = {r["id"]: r for r in engine.cycle(2)}
    assert "error" in out[lost] and out[good]["mode"] == "backfill"


def test_stream(spark, catalog, tmp_path):
    deriver = Deriver(catalog, gaussian(8))
    for i in range(2):
        spark.createDataFrame([(f"r{i}", "n", f"t{i}"), ("same", "n", f"v{i}")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        derive_stream(rows, SPEC, deriver, f"{tmp_path}/ck").awaitTermination()
    live = {r["source_row_id"]: r["source_sequence_number"] for r in live_entries(deriver.history(SPEC)).collect()}
    assert live == {"r0": 1, "r1": 2, "same": 2}
    rows = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    derive_stream(rows, SPEC, deriver, f"{tmp_path}/ck").awaitTermination()
    assert len(deriver.map.commits()) == 2


# -- embedders

def test_embedders(spark):
    assert resolve({"data": [{"e": [1]}, {"e": [2]}]}, "/data/*/e") == [[1], [2]]
    with pytest.raises(ValueError):
        external("what", "http://h")
    with pytest.raises(ValueError):
        gaussian().embed_query("  ")
    g = gaussian(16)
    rows = spark.createDataFrame([("h1", "a"), ("h2", "b")], "content_hash string, text string")
    got = {r["content_hash"]: r for r in g.embed(rows).collect()}
    assert got["h1"]["embedding"] == g.embed_query("a") != g.embed_query("b") and got["h1"]["error"] is None
    short = Batched(lambda texts: [[1.0]], batch=2, attempts=1).embed(rows.coalesce(1)).collect()
    assert all(r["embedding"] is None and "1 vectors for 2 texts" in r["error"] for r in short)


# -- units of work, leases, schedules

def test_backfill_in_units_equals_one_unit(spark, catalog, tmp_path):
    from vecloom.operators import changes

    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("description"))
    spec = Spec("docs", ("id",), ("description",), "m")
    out = []
    for i, size in enumerate((1, 1 << 40)):
        engine = Engine(Catalog(spark, f"file://{tmp_path}/units{i}"), Counting(), unit_bytes=size)
        table = engine.catalog.load_or_create("docs", rows.schema)
        table.append(rows.repartition(4))
        units = changes.backfill_work(table, 1, unit_bytes=size)
        assert len(units) == (4 if size == 1 else 1) and len({u.name for u in units}) == len(units)
        id_ = engine.control.admit(spec).id
        got = engine.run_one(id_)
        assert engine.control.queue_depth() == {"DONE": len(units)} and got["counters"].rows == 60
        out.append(sorted(tuple(r) for r in engine.publisher.read(spec).select("source_row_id", "content_hash").collect()))
    assert out[0] == out[1]


def test_a_unit_with_another_owner_is_not_published_over(spark, catalog):
    engine = Engine(catalog, Counting())
    rows = spark.createDataFrame([("1", "a")], "id string, description string")
    table = catalog.load_or_create("docs", rows.schema)
    table.append(rows)
    spec = Spec("docs", ("id",), ("description",), "m")
    id_ = engine.control.admit(spec).id
    from vecloom.operators import changes

    unit = changes.backfill_work(table, 1)[0]
    engine.control.enqueue(id_, [(unit.name, unit.snapshot_id, unit.seq, unit.rows)], "BACKFILL")
    engine.control.lease("somebody", 1, 300, id_)
    with pytest.raises(RuntimeError, match="another owner"):
        engine.run_one(id_)
    assert engine.publisher.current(spec) is None


def test_leases_are_renewed_while_work_goes_on(catalog):
    import time

    c = K.Control(catalog, ":memory:")
    c.enqueue("m", [("p", 1, 1, 1)])
    unit = c.lease("a", 1, 1)[0]["dedup"]
    with c.holding(unit, "a", 1):
        time.sleep(2.5)
        assert c.reclaim() == 0
    time.sleep(1.5)
    assert c.reclaim() == 1 and not c.renew(unit, "a")


def test_control_state_outlives_its_process(spark, catalog):
    rows = spark.createDataFrame([("1", "a")], "id string, description string")
    catalog.load_or_create("docs", rows.schema).append(rows)
    id_ = K.Control(catalog).admit(Spec("docs", ("id",), ("description",), "m")).id
    assert K.Control(catalog).get(id_)["state"] == "VALIDATED"
    with pytest.raises(ValueError, match="name a path"):
        K.Control(type("Far", (), {"root": "hdfs://host/x"})())


def test_schedule_runs_until_it_is_stopped(spark, tmp_path):
    import time

    from vecloom.streaming.micro import schedule

    ran = []
    q = schedule(spark, 1, lambda: ran.append(1), f"file://{tmp_path}/ticks")
    until = time.time() + 60
    while len(ran) < 2 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert len(ran) >= 2
