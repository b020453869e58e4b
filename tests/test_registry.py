import pytest
from conftest import DATA, same_rows

from vecloom import lifecycle, registry

SF = str(DATA / "sf0.001")
QUERIES, ORACLES = registry.QUERIES | lifecycle.QUERIES, registry.ORACLES | lifecycle.ORACLES


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and not set(registry.QUERIES) & set(lifecycle.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLES[name]).to_arrow_table())


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The tables of sf0.001 in which some documents are blank and some have no text, and DuckDB over them."""
    duckdb = pytest.importorskip("duckdb")
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    text = "case doc_id % 20 when 3 then '' when 6 then ' ' || chr(10) when 7 then '  ' when 9 then null else case when doc_id = 8 then '   ' else text end end as text"
    for p in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"copy (select * {f'replace ({text})' if p.stem == 'documents' else ''} from '{p}') to '{folder / p.name}'")
        con.execute(f"create view {p.stem} as select * from '{folder / p.name}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["novel_content", "projection_rows", "derive_publish"])
def test_blank_texts_count_as_in_the_sql(spark, odd, name):
    same_rows(QUERIES[name](spark, odd[0]).toArrow(), odd[1].sql(ORACLES[name]).to_arrow_table())


def _made(spark, query, folder):
    """The folders that a query makes for its catalogs."""
    from pathlib import Path

    from vecloom.sources.shared import shared_dir

    life = Path(shared_dir(spark).removeprefix("file://")) / "life"
    before = set(life.glob("*"))
    got = query(spark, folder).toArrow()
    return got, set(life.glob("*")) - before


def test_the_stream_has_as_many_files_as_the_scan(spark, duck, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:
        got, (life,) = _made(spark, QUERIES["streaming_derivation"], str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    same_rows(got, duck.sql(ORACLES["streaming_derivation"]).to_arrow_table())
    assert len(list((life / "inbox").glob("*.parquet"))) == 5


def test_conflicts_take_two_tables(spark, duck):
    got, made = _made(spark, QUERIES["conflict_detection"], SF)
    same_rows(got, duck.sql(ORACLES["conflict_detection"]).to_arrow_table())
    assert len(made) == 2


def test_entry_point_works_without_the_corpus_operators(spark, duck, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("vecloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Without:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("vecloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Without(), *sys.meta_path])
    monkeypatch.delattr(sys.modules["vecloom"], "llm", raising=False)
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLES)
    assert bare.entry(spark).count() == 10
