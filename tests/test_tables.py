import pytest
from pyspark.sql import functions as F

from vecloom.operators import changes, maintenance
from vecloom.operators import content_map as cm
from vecloom.plans.spec import Spec
from vecloom.sources import catalog as C
from vecloom.sources.versioned import CommitConflict, FormatMismatch, SnapshotGone, VersionedTable

SCHEMA = "id string, part string, n long"


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def content(table, seq=None):
    return sorted((r["id"], r["n"]) for r in table.read(seq).collect())


@pytest.fixture
def table(spark, catalog):
    return catalog.load_or_create("db.t", rows(spark, ("a", "x", 1)).schema, ["part"])


def test_versions_and_time_travel(spark, table):
    assert table.version() == (0, 0)
    table.append(rows(spark, ("a", "x", 1), ("b", "y", 2)))
    table.append(rows(spark, ("c", None, 3)))
    table.overwrite(rows(spark, ("d", "x", 4)), {"part": "x"})
    table.delete_where(F.col("id") == "b")
    assert [content(table, s) for s in (1, 2, 3, 4)] == [[("a", 1), ("b", 2)], [("a", 1), ("b", 2), ("c", 3)], [("b", 2), ("c", 3), ("d", 4)], [("c", 3), ("d", 4)]]
    assert [c.operation for c in table.commits()] == ["append", "append", "overwrite", "delete"]
    assert table.delete_where(F.col("id") == "nobody") is None
    with pytest.raises(SnapshotGone):
        table.read(9)
    assert table.read(partition={"part": "x"}).count() == 1 and table.read(columns=["n"]).columns == ["n"]
    with pytest.raises(ValueError, match="no column zz"):
        table.read(columns=["zz"])
    assert table.status()["records"] == 2


def test_overwrite_guards(spark, table):
    table.append(rows(spark, ("a", "x", 1)))
    with pytest.raises(Exception, match="outside of the scope"):
        table.overwrite(rows(spark, ("d", "y", 4)), {"part": "x"})
    other = VersionedTable(spark, table.root)
    base = table.version()[1]
    other.append(rows(spark, ("e", "x", 5)))

    def check(since):
        raise CommitConflict("seen")

    with pytest.raises(CommitConflict):
        table.commit("overwrite", [], [], check=check, base=base)
    with pytest.raises(CommitConflict):
        table.commit("append", [], expect=base)
    assert len(table.commits()) == 2


def test_format_guard_and_evolution(spark, catalog, table):
    table.append(rows(spark, ("a", "x", 1)))
    table.evolve_spec([])
    table.append(rows(spark, ("b", "y", 2)))
    assert content(catalog.table("db.t")) == [("a", 1), ("b", 2)] and [f.spec_id for f in table.live_files()] == [0, 1]
    text = table.store.read("_log/table.000001.json").replace('"format-version": 3', '"format-version": 2')
    assert table.store.create("_log/table.000002.json", text)
    with pytest.raises(FormatMismatch):
        catalog.table("db.t")


def test_catalog_and_discovery(spark, catalog, table):
    assert catalog.create_namespace("other") and catalog.create_namespace("other")
    assert C.discover(spark, f"{catalog.root}/other").count() == 0
    table.append(rows(spark, ("a", "x", 1)))
    found = C.discover(spark, catalog.root)
    got = found.first()
    assert (got["name"], got["snapshots"], got["last_seq"], got["partition_by"]) == ("db.t", 1, 1, ["part"])
    known = spark.createDataFrame([(got["uuid"], "old", 0), ("u2", "gone", 4)], "uuid string, name string, last_seq long")
    merged = {r["uuid"]: (r["name"], r["last_seq"]) for r in C.upsert_discovered(known, found.select("uuid", "name", "last_seq")).collect()}
    assert merged == {got["uuid"]: ("db.t", 1), "u2": ("gone", 4)}
    assert catalog.drop("db.t") and not catalog.drop("db.t")
    with pytest.raises(LookupError):
        catalog.table("db.t")


def test_external_catalog_settings():
    got = C.external_catalog("c", "rest", "s3://b/w", "http://h")
    assert got["spark.sql.catalog.c.type"] == "rest" and got["spark.sql.catalog.c.io-impl"].endswith("S3FileIO") and got["spark.sql.catalog.c.cache-enabled"] == "false"
    assert C.external_catalog("c", "org.example.Own", "/w")["spark.sql.catalog.c.catalog-impl"] == "org.example.Own"
    for kind, warehouse in (("hadoop", "s3a://b"), ("rest", "/w"), ("what", "/w")):
        with pytest.raises(ValueError):
            C.external_catalog("c", kind, warehouse)


# -- changes

def test_assessment(spark, table):
    table.append(rows(spark, ("a", "x", 1), ("b", "y", 2)))
    table.append(rows(spark, ("c", "x", 3)))
    assert changes.assess(table, 1, 2).verdict == changes.SAFE
    assert [w.seq for w in changes.incremental_work(table, 0, 2)] == [1, 2] and changes.incremental_work(table, 2, 2) == []
    table.delete_where(F.col("id") == "b")
    found = changes.assess(table, 1, 3)
    assert found.verdict == changes.RECONCILE and found.destructive == [3] and found.affected == [{"part": "y"}]
    with pytest.raises(ValueError, match="append-only"):
        changes.incremental_work(table, 1, 3)
    assert changes.assess(table, 1, 9).verdict == changes.REANCHOR and changes.assess(table, 3, 2).verdict == changes.REANCHOR
    with pytest.raises(SnapshotGone):
        changes.backfill_work(table, 9)
    only = changes.backfill_work(table, 3, [{"part": "x"}])
    read = changes.read_work(table, only, ["id"]).collect()
    assert sorted(r["id"] for r in read) == ["a", "c"] and {r["__seq"] for r in read} == {3}


def test_a_full_pass_packs_by_bytes_alone(spark, catalog):
    ids = spark.range(60_000)
    table = catalog.load_or_create("many", ids.schema)
    for i in range(6):
        table.append(ids.filter(F.col("id") % 6 == i).coalesce(1))
    got = maintenance.full_pass(table, force=True)
    assert (got["after"]["files"], got["after"]["records"]) == (1, 60_000) and table.read().distinct().count() == 60_000


def test_packing_is_a_safe_change_and_loses_nothing(spark, table):
    for i in range(7):
        table.append(rows(spark, (f"r{i}", "x", i)).coalesce(1))
    before = content(table)
    made = maintenance.compact(table)
    assert made.operation == "replace" and content(table) == before and table.status()["files"] == 1
    assert changes.assess(table, 7, 8).verdict == changes.SAFE and changes.incremental_work(table, 7, 8) == []
    assert maintenance.compact(table) is None
    assert maintenance.busy(table) and maintenance.full_pass(table)["skipped"] == "busy"
    got = maintenance.full_pass(table, retain_ms=-1000, force=True)
    assert got["expired"] == 7 and content(table) == before == content(VersionedTable(spark, table.root))
    assert changes.assess(table, 3, 8).verdict == changes.REANCHOR
    with pytest.raises(SnapshotGone):
        table.read(3)
    table.stage(rows(spark, ("lost", "x", 0)))
    assert maintenance.sweep(table, 1 << 50) == 1 and content(table) == before


def test_sweep_is_refused_on_an_empty_source(spark):
    keys = spark.createDataFrame([("a",), (None,)], "source_row_id string")
    changes.check_sweep(keys)
    with pytest.raises(ValueError, match="refused"):
        changes.check_sweep(keys.filter("source_row_id is null"))


# -- content map

def assertion(row, seq, content=None, at=0, created=None, ordinal=0):
    return ("t", row, ordinal, content, "c", seq, at, content is None, created)


MAP = "source_table string, source_row_id string, chunk_ordinal int, content_hash string, config_id string, source_sequence_number long, source_committed_at long, deleted boolean, created_at timestamp"


def naive(history, as_of=None):
    best = {}
    for r in history:
        if as_of is None or r[5] <= as_of:
            key, rank = r[:3], (r[5], r[6], r[3] is not None and not r[7], r[3] or "")
            if key not in best or rank > best[key][0]:
                best[key] = (rank, r)
    return sorted((k[1], k[2], r[3]) for k, (_, r) in best.items() if not r[7])


def test_newest_wins(spark):
    history = [assertion("r1", 10, "v1"), assertion("r1", 30, "v3"), assertion("r1", 20, "v2"), assertion("r2", 40), assertion("r2", 10, "x"), assertion("r3", 10, "a"), assertion("r3", 20), assertion("r3", 30, "b"), assertion("r4", 5, "p", 1), assertion("r4", 5, "q", 2)]
    for order in (history, history[::-1]):
        frame = spark.createDataFrame(order, MAP).repartition(3)
        for as_of in (None, 5, 10, 20, 29, 30):
            got = sorted((r["source_row_id"], r["chunk_ordinal"], r["content_hash"]) for r in cm.live_entries(frame, as_of).collect())
            assert got == naive(history, as_of), as_of


def test_history_and_watermark(spark):
    frame = spark.createDataFrame([assertion("r1", 10, "v1"), assertion("r1", 20), assertion("r1", 30, "v3"), assertion("r2", 100, "z")], MAP)
    got = [(r["source_sequence_number"], r["superseded"]) for r in cm.chunk_history(frame, "t", "r1", 0, "c").collect()]
    assert got == [(10, True), (20, True), (30, False)]
    assert cm.latest_sequence(frame).first()[0] == 100 and cm.latest_sequence(frame.limit(0)).first()[0] == 0
    live = cm.live_entries(frame)
    assert cm.covered_watermark(live, live.filter("source_row_id = 'r1'")).first().asDict() == {"covered_watermark": 29, "unresolved_rows": 1}
    assert cm.covered_watermark(live, live.limit(0)).first()[0] == 100
    bad = spark.createDataFrame([("t", "r", 0, " ", "c", 1, 0, False, None), ("", "r", 0, "h", "c", 1, 0, False, None), ("t", "r", 0, None, "c", 1, 0, True, None)], MAP)
    assert cm.invalid(bad).count() == 2


def test_present_keys(spark, table):
    table.append(rows(spark, ("a", "x", 1), ("a", "y", 2), ("b", "x", 3)))
    spec = Spec("db.t", ("id",), ("part",), "m")
    assert sorted(r[0] for r in changes.present_keys(table, spec, 1).collect()) == ["a", "b"]


def test_many_commits_are_one_read(spark, catalog):
    from vecloom.operators import changes

    rows = spark.range(300).withColumn("k", F.col("id") % 3)
    table = catalog.load_or_create("many", rows.schema, ("k",))
    files = table.stage(rows.repartition(100, "id"))
    for f in files:
        table.commit("append", [f])
    got = changes.read_work(table, changes.incremental_work(table, 0, len(files)), ["id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and got.count() == 300 and got.select("__seq").distinct().count() == len(files)
    by = {c.seq: c.added[0].rows for c in table.commits()}
    assert {r["__seq"]: r["count"] for r in got.groupBy("__seq").count().collect()} == by


def test_a_layout_change_never_leaves_a_table_without_a_description(spark, catalog):
    rows = spark.range(4).withColumn("k", F.col("id") % 2)
    table = catalog.load_or_create("t", rows.schema)
    other = catalog.table("t")
    table.evolve_spec(["k"])
    other.evolve_spec([])  # by a writer that has not seen the first change
    assert catalog.table("t").specs == [[], ["k"], []] and table.store.exists("_log/table.json")
