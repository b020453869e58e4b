"""Operators over whole tables: search, near duplicates, mixing, licenses, the pipeline."""

import numpy as np
import pytest
import xxhash
from conftest import same_rows
from pyspark.sql import functions as F

from vecloom.llm import bitslice, licenses, mixing, pieces, quality, simhash
from vecloom.llm.components import components

rng = np.random.default_rng(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, f long, target string, __h string, n string, s string, row string, whole string, most string, i string, root string, k string, d string"


def frame(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, None, s, 0, 1, 2, 3, *["clash"] * 11) for i, t, s in rows], DOCS)


def words(n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


# -- op3

def brute(vectors, k, every):
    """(query id, rank, row's id, score) of every distinct query vector."""
    ok = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in ok]).reshape(len(ok), width)
    ids = np.array([i for i, _ in ok])
    out = []
    for q, v in sorted({(i, tuple(v.tolist())) for i, v in ok if i % every == 0}):
        s = x @ np.pad(np.array(v, np.int64), (0, width - len(v)))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(q, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_bit_sliced_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK", 64)
    x = rng.normal(0, 0.5, (400, 70)).astype(np.float32)
    x[10:40] = x[9]  # ties
    vectors = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors += [(1000, None), (1050, [float("nan")] * 70), (1100, [None] * 70), (1150, [float("inf")] * 70), (1200, []), (1250, [1.0, -1.0]), (None, [1.0] * 70), (3, vectors[3][1])]
    table = spark.createDataFrame([(i, v, 0, "c") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string")
    for group in (bitslice.QUERY_BYTES, 2000):
        got = sorted(tuple(r)[:4] for r in bitslice.search(table, group_bytes=group).collect())
        assert got == brute(vectors, 5, 50)
    few = table.filter("vec_id in (50, 51, 52)")
    assert bitslice.search(few).count() == 2 and bitslice.search(table.limit(0)).count() == 0


@pytest.mark.parametrize("own", [1, 2, 6, 7, 20])
def test_search_finds_k_others_however_many_rows_share_the_query_id(spark, own):
    x = rng.normal(0, 0.5, (100, 16)).astype(np.float32)
    vectors = [(i + 1, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = [(i, v) for i, v in vectors if i % 50] + [(50, vectors[0][1])] * own + [(100, [float(v) for v in rng.normal(0, 2, 16)]) for _ in range(own)]
    got = bitslice.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute(vectors, 5, 50) and len({r["query_digest"] for r in got}) == own + 1 and len(got) == 5 * (own + 1)


# -- op4

def naive_print(t, n=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprints_match_a_loop():
    texts = [None, "", "a", "A b", "a b c", "a b c " * 5, "Über ÄB x y z", words(300), "x\x0by\x1fz\x85w"]
    got = simhash.fingerprints(texts, 3).view(np.uint64).tolist()
    assert got == [naive_print(t) for t in texts]


def groups(prints):
    """Component of each fingerprint by comparing all pairs."""
    f = np.array(sorted(set(prints)), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    root = np.arange(len(f))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(f))])
        if (new == root).all():
            return dict(zip(f.tolist(), root.tolist(), strict=True))
        root = new


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
def test_links_connect_what_all_pairs_connect(spark, hot):
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base for _ in range(3)]
    chain, at = [], int(base[0])
    for _ in range(40):  # a long chain of small steps
        at ^= sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        chain.append(at)
    low = [int(x) for x in rng.integers(0, 1 << 14, 200)]  # crowds a few anchors
    f = sorted({int(x) for x in base} | set(near) | set(chain) | set(low))
    signed = np.array(f, np.uint64).view(np.int64)
    prints = spark.createDataFrame([(int(x),) for x in signed] * 2 + [(None,)], "f long")
    found = {r["v"]: r["root"] for r in components(simhash.links(prints, hot)).collect()}
    want, own = groups(f), {}
    for x, s in zip(f, signed.tolist(), strict=True):
        own.setdefault(found.get(s, s), set()).add(want[x])
    assert all(len(v) == 1 for v in own.values()) and len(own) == len(set(want.values()))


def test_near_duplicates(spark):
    long = words(400)
    rows = [(1, long, "s"), (2, long + " tail", "s"), (3, long.upper(), "s"), (4, words(50), "s"), (5, None, "s"), (6, "", "s"), (7, long, "s"), (None, words(40), "s"), (4, rng.choice(["zz"]).item(), "s"), (9, words(30_000), "s")]
    docs = frame(spark, rows)
    got = simhash.near_duplicates(docs).collect()
    want = groups([naive_print(t) for _, t, _ in rows])
    least = {}
    for i, t, _ in rows:
        least.setdefault(want[naive_print(t)], []).append(i)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(map(str, ((i, f"{naive_print(t):016x}", first[want[naive_print(t)]]) for i, t, _ in rows)))
    kept = simhash.keep_one(docs.union(docs))
    assert kept.schema == docs.schema and kept.count() == len(first) and kept.filter("__h = 'clash' and i = 'clash' and h = 2").count() == len(first)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (7, None), (3, 1), *((i, i + 1) for i in range(10, 60))], "a long, b long")
    got = {r["v"]: r["root"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 10 for i in range(10, 61)}}
    assert components(edges.limit(0)).count() == 0


# -- op5

def test_mixing_agrees_with_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, words(int(rng.integers(0, 40))), ["a", "b", "c", None, "d"][min(4, int(rng.integers(0, 12)) // 2)]) for i in range(300)]
    rows += [(400, None, "a"), (401, "", "e"), (402, words(5000), "b"), (7, "same", "c"), (7, "same", "c"), (None, "x y", "d")]
    docs = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    plan = mixing.plan(docs)
    same_rows(plan.toArrow(), con.sql(mixing.ORACLE).to_arrow_table())
    sums = plan.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(r["most"], 1) for r in sums) and plan.filter("taken > 2 * size").count() == 0
    copies = mixing.mixed(docs)
    assert copies.schema == docs.schema and copies.filter("__h != 'clash' or n != 'clash' or h != 2 or s != 'clash' or most != 'clash'").count() == 0
    assert sum(len((r["text"] or "").split()) for r in copies.collect()) == plan.agg(F.sum("taken")).first()[0]
    assert mixing.plan(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()


def test_targets_stop_at_twice_a_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["d"] == 0 and sum(got.values()) == pytest.approx(1.5 * 2510)
    assert all(got[s] <= 2 * n for s, n in (("b", 1000), ("c", 1000), (None, 500)))


# -- op7

def test_license_scan_agrees_with_sql(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    notices = [t for v in licenses.TEMPLATES.values() for t in v]
    rows = [(i, " ".join([words(int(rng.integers(0, 60))), t.upper() if i % 2 else t, words(20)]), "s") for i, t in enumerate(notices)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "one two", "s"), (103, words(20_000) + " " + notices[0] + " " + words(30), "s"), (0, rows[0][1], "s"), (104, words(300), "s"), (105, " ".join(notices), "s")]
    docs = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = licenses.scan(docs, licenses.templates(spark))
    same_rows(got.toArrow(), con.sql(licenses.oracle()).to_arrow_table())
    found = {r["doc_id"] for r in got.collect()}
    assert set(range(len(notices))) | {103, 105} == found
    monkeypatch.setattr(licenses, "MAX_SHINGLES", 10)  # a set of templates that is too large for literals
    same_rows(licenses.scan(docs, licenses.templates(spark)).toArrow(), got.toArrow())
    assert licenses.scan(docs.limit(0), licenses.templates(spark)).count() == 0
    assert licenses.scan(docs, licenses.templates(spark).limit(0)).count() == 0


def test_parts_and_reflowed_licenses_are_found(spark, tmp_path):
    mit = licenses._MIT
    reflowed = "\n * ".join(" ".join(mit).lower().split(" ")[i : i + 9][0:9] and " ".join(" ".join(mit).lower().split(" ")[i : i + 9]) for i in range(0, len(" ".join(mit).split(" ")), 9))
    rows = [(1, f"{words(30)}\n/* {reflowed} */ {words(10)}", "s"), (2, mit[0] + " " + words(50), "s"), (3, " ".join(licenses._BSD).replace("COPYRIGHT HOLDER OR", "AUTHOR OR"), "s"), (4, licenses._gnu("3", "GNU Affero General Public License"), "s"), (5, " ".join(mit).replace("software", "thing"), "s"), (6, words(200), "s")]
    got = {}
    for r in licenses.scan(frame(spark, rows), licenses.templates(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got[1] == {"MIT"} and "MIT" in got[2] and "BSD-3-Clause" in got[3] and got[4] == {"AGPL-3.0"} and 6 not in got
    (tmp_path / "Own-1.0.txt").write_text("A license of one\nsentence that nobody else has written before us, we hope.")
    own = licenses.templates_from(spark, f"file://{tmp_path}")
    found = licenses.scan(frame(spark, [(1, "x y z a license of one sentence that nobody else has written before us we hope", "s")]), own).collect()
    assert [(r["license"], r["containment"]) for r in found] == [("Own-1.0", 1.0)]


# -- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    prose = [f"In the year {1900 + i} the town {words(1)} built a bridge over the river, and people from {words(2)} came to see how the engineers had solved a difficult problem with very simple tools. " + " ".join(rng.permutation("many visitors wrote letters about the journey and kept drawings of towers gates gardens markets boats mills roads fields forests hills".split())) + f" and ended after {i} days" for i in range(150)]
    rows = [(i, t + (" vile scum rotten" if i % 3 == 0 else ""), ["a", "b", None][i % 7 % 3]) for i, t in enumerate(prose)]
    rows += [(1000 + i, rows[i][1], "a") for i in range(0, 150, 5)] + [(2000, None, "a"), (2001, "", "b"), (2002, "a b c " * 40, "b")]
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = P.read(spark, str(tmp_path), "documents"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), "t")
        seen[name] = docs.collect()
        assert name == "sentencepiece" or docs.columns == columns
    with open(pieces.MODEL, "rb") as f:
        model = pieces.PieceModel(f.read())
    kept = quality.judge([t for _, t, _ in rows], model)["kept"].tolist()
    assert sorted(r["doc_id"] for r in seen["quality_rules"]) == sorted(r[0] for r, k in zip(rows, kept, strict=True) if k)
    clean = {r["doc_id"] for r in seen["toxicity"]}
    assert not any(r["doc_id"] in clean for r in seen["quality_rules"] if "vile" in r["text"]) and clean == {r["doc_id"] for r in seen["quality_rules"] if "vile" not in r["text"]}
    part = groups([naive_print(r["text"]) for r in seen["toxicity"]])
    assert len(seen["near_dedup"]) == len(set(part.values())) == len({part[naive_print(r["text"])] for r in seen["near_dedup"]})
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["near_dedup"]}
    text = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert len(seen["sentencepiece"]) == len(seen["mixing"]) and all(model.decode(np.array(r["ids"])) == model.plain(text[r["doc_id"]]) for r in seen["sentencepiece"])
    assert sorted(r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] for r in seen["sentencepiece"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_scratch_files_go_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from vecloom.llm import base
    from vecloom.sources import shared

    with base.scratch(spark) as paths:
        kept = base.materialize(spark.range(3).toDF("x"), "kept")
        paths.pop()
        gone = base.materialize(spark.range(3).toDF("x"), "gone")
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception, match="gone|FAILED_READ_FILE|not exist"):
        gone.count()

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("Context", (), {"master": "yarn", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)
