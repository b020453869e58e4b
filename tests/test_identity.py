import hashlib

import pytest
from pyspark.sql import functions as F

from vecloom.functions import chunkers
from vecloom.functions import identity as I
from vecloom.plans.spec import Spec


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_canonical_text_keeps_separators_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, "c"), (None, None, None), ("", "b", "")], "x string, y string, z string")
    got = [r[0] for r in rows.select(I.canonical_text(["x", "y", "z"], "|")).collect()]
    assert got == ["a||c", "||", "|b|"]


def test_row_id_and_content_hash(spark):
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "k string, n int")
    got = rows.select(I.row_id(["k", "n"]), I.content_hash(F.coalesce("k", F.lit("")))).collect()
    assert [r[0] for r in got] == ["a\x1f1", None, None]
    assert [r[1] for r in got] == [sha("a"), sha(""), sha("")]


def test_hash_prefix(spark):
    got = spark.createDataFrame([("abc",), ("a",), ("",)], "h string").select(I.hash_prefix(F.col("h"))).collect()
    assert [r[0] for r in got] == ["ab", "00", "00"]


def test_config_id_leaves_out_source_and_keys():
    a = Spec("t1", ("id",), ("name",), "m")
    assert a.config_id == Spec("t2", ("other",), ("name",), "m").config_id
    parts = ["cols=name", "sep= ", "chunker=whole", "chunkSize=0", "chunkOverlap=0", "model=m", "revision=", "version=v1", "normalize=false"]
    assert a.config_id == sha("\x1f".join(parts))[:16]
    others = [Spec("t1", ("id",), ("name",), "m", **x) for x in ({"normalize": True}, {"chunker": "fixed"}, {"embedding_version": "v2"}, {"model_revision": "r"}, {"join_separator": ","})]
    assert len({a.config_id, *(x.config_id for x in others)}) == 6


def test_vector_id_joins_parts(spark):
    row = spark.range(1).select(I.vector_id(F.lit("t"), F.lit("r"), F.lit(7), F.lit(0), F.lit("m"), F.lit("v1"), F.lit("c"))).first()
    assert row[0] == sha("\x1f".join(["t", "r", "7", "0", "m", "v1", "c"]))


def test_coverage_digests(spark):
    hashes = [sha(str(i)) for i in range(50)]
    rows = spark.createDataFrame([(h,) for h in hashes * 2], "content_hash string").repartition(3)
    want = hashlib.sha256("".join(h + "\x1f" for h in sorted(hashes)).encode()).hexdigest()
    assert I.coverage_digest(rows) == want
    assert I.coverage_digest(rows.limit(0)) == I.EMPTY_COVERAGE
    tree = I.tree_digest(rows).first()
    assert tree["n_contents"] == 50 and tree["digest"] == I.tree_digest(rows.orderBy(F.desc("content_hash"))).first()["digest"]
    assert I.tree_digest(rows.filter(F.col("content_hash") != hashes[0])).first()["digest"] != tree["digest"]
    assert I.tree_digest(rows.limit(0)).first() is None


def test_names():
    assert I.projection_name("Sales/Q 1", "c" * 16).startswith("vectors_sales_q_1_") and I.projection_name("Sales/Q 1", "c").endswith("_c")
    assert I.projection_name("***", "c").startswith("vectors_source_")
    assert len({I.projection_name("x" * 90 + t, "c") for t in "ab"}) == 2
    assert I.clustered_name("A.b-C") == "clustered_a_b_c"


def naive_chunks(t, size, overlap):
    out, at = [], 0
    while True:
        out.append(t[at : at + size])
        if at + size >= len(t):
            return out
        at += size - overlap


def test_fixed_chunks_match_a_loop(spark):
    texts = ["x" * n for n in (1, 9, 10, 11, 12, 15, 16, 100)] + ["a😀b" * 7, "no break"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((10, 5), (10, 0), (7, 6), (200, 50)):
        got = rows.select("t", chunkers.fixed(F.col("t"), size, overlap).alias("c")).collect()
        for r in got:
            assert [c["text"] for c in r["c"]] == naive_chunks(r["t"], size, overlap)
            assert [c["ordinal"] for c in r["c"]] == list(range(len(r["c"])))


def test_blank_texts_have_no_chunks(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \t\n",), ("\u2003",), ("\u00a0",), ("a",)], "t string")
    got = [(len(r[0]), len(r[1])) for r in rows.select(chunkers.whole(F.col("t")), chunkers.fixed(F.col("t"), 5, 1)).collect()]
    assert got == [(0, 0)] * 4 + [(1, 1)] * 2


def test_chunker_lookup():
    assert chunkers.chunker(" Whole ") is chunkers.whole and chunkers.chunker(None) is chunkers.whole
    for name, size, overlap in (("words", 0, 0), ("fixed", 0, 0), ("fixed", 5, 5), ("fixed", 5, -1)):
        with pytest.raises(ValueError):
            chunkers.chunker(name, size, overlap)
