import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import ivf
from vecloom.operators.search import probe, recall, top_k
from vecloom.plans import sqlview


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>")


@pytest.mark.parametrize(("a", "b", "null", "zero", "search"), [
    ([1.0, 0.0], [1.0, 0.0], 1.0, 1.0, 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0, -1.0, -1.0), ([1.0, 0.0], [0.0, 3.0], 0.0, 0.0, 0.0),
    ([1.0], [1.0, 2.0], None, 0.0, None), ([0.0, 0.0], [1.0, 1.0], None, 0.0, 0.0), (None, [1.0], None, 0.0, None),
])
def test_cosine_policies(spark, a, b, null, zero, search):
    row = pair(spark, a, b).select(*(V.cosine(F.col("a"), F.col("b"), p).alias(p) for p in ("null", "zero", "search"))).first()
    for got, want in zip(row, (null, zero, search), strict=True):
        assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_cosine_raises_on_other_widths(spark):
    with pytest.raises(Exception, match="lengths 1 and 2"):
        pair(spark, [1.0], [1.0, 2.0]).select(V.cosine(F.col("a"), F.col("b"), "raise")).collect()
    with pytest.raises(ValueError):
        V.cosine(F.col("a"), F.col("b"), "other")
    for bad in ([], [math.nan], [math.inf]):
        with pytest.raises(ValueError):
            V.literal(bad)


def test_normalized_and_metrics(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    got = rows.select(V.normalized(F.col("v")), V.unit_or_null(F.col("v"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0.0, 0.0] and [r[1] is None for r in got] == [False, True, True, True]
    assert V.ndcg([3, 2, 1], [1, 2, 3], 3) == pytest.approx(1.0) and V.ndcg([], [], 3) == 0.0
    assert V.nearest_rank([5.0, 1.0, 3.0], 0.5) == 3.0 and V.nearest_rank([], 0.5) == 0.0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.1 * rng.standard_normal((40, 6)) for c in np.eye(6)[:4]])
    return spark.createDataFrame([(f"{i:04x}", [float(v) for v in r]) for i, r in enumerate(x)], "content_hash string, embedding array<float>"), x.astype(np.float32)


def test_top_k_and_probe(points, monkeypatch):
    rows, x = points
    q = [float(v) for v in x[3]]
    sims = (x @ x[3]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[3])
    want = [f"{i:04x}" for i in np.lexsort((np.arange(len(x)), -sims))[:7]]
    assert [r["content_hash"] for r in top_k(rows, q, 7).collect()] == want
    assert top_k(rows, [1.0], 7).count() == 0
    centroids, rounds = ivf.fit(rows, 4)
    assert 1 <= rounds <= ivf.MAX_ROUNDS and centroids.shape == (4, 6)
    clustered = ivf.assign(rows, centroids)
    assert sorted(r["count"] for r in clustered.groupBy("cluster_id").count().collect()) == [40] * 4
    near = probe(clustered, ivf.rank_clusters(q, centroids)[:1], q, 7)
    assert [r["content_hash"] for r in near.collect()] == want
    assert recall(near, top_k(rows, q, 7)).first()["recall"] == 1.0
    monkeypatch.setattr(ivf, "FEW_BYTES", 0)  # sums of a cluster end in one task
    again, _ = ivf.fit(rows.repartition(3), 4)
    assert np.allclose(again, centroids, atol=1e-6)


def test_suggested_clusters():
    assert [ivf.suggested_clusters(n) for n in (1, 4, 5, 100, 10**9)] == [1, 1, 2, 10, 4096]


def test_generated_sql(spark, monkeypatch, points):
    rows, x = points
    rows.select("content_hash", F.lit("r").alias("source_row_id"), F.lit(0).alias("chunk_ordinal"), F.lit("t").alias("text"), "embedding").createOrReplaceTempView("gen_view")
    q = [float(v) for v in x[3]]
    body = sqlview.spark_search("gen_view", 6)
    bound = [r["content_hash"] for r in sqlview.run(spark, body, q, 5).collect()]
    assert bound == [r["content_hash"] for r in spark.sql(sqlview.bind(body, q, 5)).collect()] == [r["content_hash"] for r in top_k(rows, q, 5).collect()]
    assert spark.sql(sqlview.bind(body, [1.0, 2.0], 5)).count() == 0
    assert "cardinality" in sqlview.search_sql("a.b", 6, "trino")
    for bad in (lambda: sqlview.spark_search("a;b", 6), lambda: sqlview.spark_search("a", 0), lambda: sqlview.search_sql("a", 6, "other"), lambda: sqlview.bind("select 1", q, 5), lambda: sqlview.bind(body, [], 5), lambda: sqlview.bind(body, [math.nan], 5)):
        with pytest.raises(ValueError):
            bad()
