"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Terms are lower-cased words (`\\w+`), known by their XXH64. A term's weight in a vector is (1 + ln tf) * idf * evidence:
`evidence` is how far, in log odds, the bound of the Wilson interval (Z) of its share of toxic rows lies from the base
rate, on either side. No word list is learned and none is cut: every term of the labelled rows gets a weight, and those
that tell nothing with confidence get zero, so they add nothing to a cosine. (With tf-idf alone the random prose around
a few bad words decides which examples are near; README has figures.) Rows of one family (equal smallest hash of their
five-word shingles) count once in idf and evidence, so that copies cannot promote their own rare words.

Index: examples with equal vectors are one prototype, which keeps its toxic and clean weight and its least doc_id.
Prototypes stand in blocks, each term keeps its largest weight in every block; a query scores blocks by falling upper
bound and stops when the next bound cannot reach the k-th best cosine: the result is that of a full scan.

Score: votes of the K nearest prototypes, weighted by cosine squared (and undoing the sampling of the classes), drawn to
the base rate with weight PRIOR. A text without a weighted term scores the toxic share of such labelled rows. Evidence:
the neighbours' ids, labels and cosines.

Bounds: about TRAIN_PER_CLASS labelled rows a class are learned from; terms with a weight, prototypes and their postings
come from these rows alone, and are what is broadcast. Everything else reads all rows.

Defined results. Null and empty texts: the score of a text without terms. Ties at the K-th cosine: the prototype that
comes first in the index, which is sorted by vector. No labelled toxic row: every score is 0; no clean one: 1. Labels
that are null, or ids with both labels, are left out; so are labels of ids without a text. Extra columns are ignored;
repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import fold, hash_below, map_arrow, map_text, materialize, text_chunks

#: About so many labelled rows of each class are learned from (a repeatable sample by doc_id).
TRAIN_PER_CLASS = 6000
K, Z, PRIOR = 15, 4.0, 0.25
#: Prototypes a block, at least; blocks grow so that the tables of block maxima hold CELLS numbers at most.
BLOCK, CELLS = 64, 4 << 20
WORD = re.compile(r"\w+")
#: Distinct vectors whose result a task keeps.
SEEN = 20_000


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """(text, term, count) of every term of every text, in order of text and term, and the words of each text."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    place: dict[str, int] = {}
    flat = [place.setdefault(w, len(place)) for ws in words for w in ws]
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in place), np.uint64, len(place)).view(np.int64)
    terms, at = np.unique(h, return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    cell, count = np.unique(doc * max(len(terms), 1) + at[flat] if flat else np.zeros(0, np.int64), return_counts=True)
    return cell // max(len(terms), 1), terms[cell % max(len(terms), 1)] if len(terms) else np.zeros(0, np.int64), count, words


def family(words: list[str]) -> int:
    """The smallest hash of five-word shingles (of the whole sequence if it is shorter)."""
    if len(words) < 5:
        return xxhash.xxh64_intdigest(" ".join(words))
    return min(map(xxhash.xxh64_intdigest, map(" ".join, zip(words, words[1:], words[2:], words[3:], words[4:]))))


def evidence(a: Column, b: Column, n_pos: int, n_neg: int, base: float) -> Column:
    """The log odds by which the Wilson interval of a term's toxic share clears the base rate; a, b: toxic and clean families."""
    n, share = a + b, a * (base / n_pos) / (a * (base / n_pos) + b * ((1 - base) / n_neg))
    half = Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    mid, scale = share + Z * Z / (2 * n), 1 + Z * Z / n
    odds = lambda p: F.log(p / (1 - p))
    edge = float(np.log(base / (1 - base)))
    return F.greatest(F.lit(0.0), odds(F.greatest((mid - half) / scale, F.lit(1e-9))) - edge, edge - odds(F.least((mid + half) / scale, F.lit(1 - 1e-9))))


class Index:
    """Prototypes over weighted terms: postings by term and block, with maxima."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, vectors: list[tuple], bare: tuple[float, float], base: float) -> None:
        """terms: sorted hashes; vectors: (places of terms, counts, toxic weight, clean weight, doc_id)."""
        self.terms, self.weight, self.base = terms, weight, base
        rows = sorted((v for v in vectors if len(v[0])), key=lambda v: (tuple(v[0]), tuple(v[1])))
        self.toxic, self.clean = np.array([v[2] for v in rows], float), np.array([v[3] for v in rows], float)
        self.doc = np.array([v[4] for v in rows], np.int64)
        self.bare = (bare[0] + PRIOR * base) / (sum(bare) + PRIOR)
        self.block = max(BLOCK, -(-len(rows) * max(1, len(terms)) // CELLS))
        self.blocks = max(1, -(-len(rows) // self.block))
        p = np.repeat(np.arange(len(rows)), [len(v[0]) for v in rows])
        t = np.concatenate([np.asarray(v[0], np.int64) for v in rows]) if rows else np.zeros(0, np.int64)
        w = self.unit(t, np.concatenate([np.asarray(v[1], np.int64) for v in rows]) if rows else np.zeros(0, np.int64), p)
        order = np.lexsort((p, t))
        self.at, self.w = p[order], w[order]
        cell = t[order] * self.blocks + self.at // self.block
        self.cut = np.searchsorted(cell, np.arange(len(terms) * self.blocks + 1)).reshape(-1)
        self.top = np.zeros(len(terms) * self.blocks)
        np.maximum.at(self.top, cell, self.w)
        self.top = self.top.reshape(len(terms), self.blocks)

    def unit(self, term: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Weights of (term, count), to unit length by row."""
        w = (1 + np.log(count)) * self.weight[term] if len(term) else np.zeros(0)
        norm = np.sqrt(np.bincount(row, w * w)) if len(row) else np.zeros(0)
        return w / norm[row] if len(row) else w

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k largest positive cosines and their prototypes, ties to the smaller prototype."""
        bound = q @ self.top[ids]
        best, who = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-9):
                break
            sums = np.zeros(self.block)
            for t, x in zip(ids.tolist(), q.tolist(), strict=True):
                lo, hi = self.cut[t * self.blocks + b], self.cut[t * self.blocks + b + 1]
                if hi > lo:
                    sums[self.at[lo:hi] - b * self.block] += x * self.w[lo:hi]
            hit = np.flatnonzero(sums)
            best, who = np.concatenate([best, np.round(sums[hit], 12)]), np.concatenate([who, b * self.block + hit])
            order = np.lexsort((who, -best))[:k]
            best, who = best[order], who[order]
        return best, who

    def judge(self, ids: np.ndarray, q: np.ndarray) -> tuple:
        """Score, and the neighbours' ids, labels and cosines."""
        cos, who = self.nearest(ids, q)
        vote = cos**2
        good, bad = (vote * self.toxic[who]).sum(), (vote * self.clean[who]).sum()
        return float((good + PRIOR * self.base) / (good + bad + PRIOR)), self.doc[who].tolist(), (self.toxic[who] > self.clean[who]).astype(int).tolist(), cos.tolist()

    def score(self, texts: list[str | None], seen: dict) -> list[tuple]:
        """judge() of every text; `seen` keeps results by vector."""
        out = [(self.bare, [], [], [])] * len(texts)
        if not len(self.terms):
            return out
        doc, term, count, _ = bags(texts)
        place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[place] == term
        doc, place, count = doc[known], place[known], count[known]
        # in order of place within a text, as vectors are
        order = np.lexsort((place, doc))
        doc, place, count = doc[order], place[order], count[order]
        q = self.unit(place, count, doc)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
            key = (place[lo:hi].tobytes(), count[lo:hi].tobytes())
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[key] = self.judge(place[lo:hi], q[lo:hi])
            out[doc[lo]] = seen[key]
        return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Index:
    """The index from docs (doc_id, text) and labels (doc_id, toxic)."""
    none = np.zeros(0, np.int64)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, per_class / max(1, sizes.get(y, 0))) for y in (0, 1)]
    sample = known.filter(hash_below(F.col("doc_id"), 23, F.when(F.col("label") == 1, share[1]).otherwise(share[0])))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")  # about 2 * per_class small rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            doc, term, n, words = bags(texts)
            stop = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("label"), pa.array([family(w) - (1 << 63) for w in words], pa.int64()),
                pa.ListArray.from_arrays(stop, pa.array(term, pa.int64())), pa.ListArray.from_arrays(stop, pa.array(n, pa.int32())),
            ], ["doc_id", "label", "family", "terms", "counts"])

    schema = "doc_id long, label int, family long, terms array<long>, counts array<int>"
    bag = materialize(map_arrow(rows.select(F.col("doc_id").cast("long"), "text", "label"), count, schema), "toxic-bags")
    families = {r["label"]: r["n"] for r in bag.groupBy("label").agg(F.count_distinct("family").alias("n")).collect()}
    if not families.get(0) or not families.get(1):
        only = 1.0 if families.get(1) else 0.0
        return Index(none, np.zeros(0), [], (only, 1 - only), only)
    base = sizes[1] / sum(sizes.values())
    each = bag.select("label", "family", F.explode("terms").alias("term")).distinct()
    seen = each.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    told = evidence(F.col("a"), F.col("b"), families[1], families[0], base)
    idf = 1 + F.log((1 + families[0] + families[1]) / (1 + F.col("a") + F.col("b")))
    got = seen.select("term", (told * idf).alias("w")).filter("w > 1e-9").toPandas()  # terms that some rows of the sample agree on
    got = got.sort_values("term")
    terms, weight = got["term"].to_numpy(np.int64), got["w"].to_numpy(float)
    model = docs.sparkSession.sparkContext.broadcast(terms)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = model.value
        for batch in batches:
            ids, counts = [], []
            for ts, ns in zip(batch.column("terms"), batch.column("counts"), strict=True):
                t, n = ts.values.to_numpy(), ns.values.to_numpy()
                at = np.minimum(np.searchsorted(all_, t), max(len(all_) - 1, 0))
                ok = all_[at] == t if len(all_) else np.zeros(len(t), bool)
                order = np.argsort(at[ok], kind="stable")
                ids.append(at[ok][order])
                counts.append(n[ok][order])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "label", "ids", "counts"])

    vectors = map_arrow(bag, places, "doc_id long, label int, ids array<int>, counts array<int>")
    w = F.when(F.col("label") == 1, 1 / share[1]).otherwise(1 / share[0])
    # an example that speaks for its prototype: the least id of the label that weighs more
    protos = vectors.groupBy("ids", "counts").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("clean"),
        F.min(F.when(F.col("label") == 1, F.col("doc_id"))).alias("bad"), F.min(F.when(F.col("label") == 0, F.col("doc_id"))).alias("good"),
    ).toArrow().to_pylist()  # rows of the sample at most
    bare = next(((r["toxic"], r["clean"]) for r in protos if not r["ids"]), (0.0, 0.0))
    return Index(terms, weight, [(r["ids"], r["counts"], r["toxic"], r["clean"], r["bad"] if r["toxic"] > r["clean"] else r["good"]) for r in protos], bare, base)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted, n_neighbours, nearest_cosine, neighbour_ids, neighbour_labels for every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        index, seen = model.value, {}

        def step(texts):
            found = index.score(texts, seen)
            s = np.clip(np.array([x[0] for x in found], float), 0, 1)
            return {
                "score": s, "predicted": (s >= 0.5).astype(np.int32), "n_neighbours": np.array([len(x[1]) for x in found], np.int32),
                "nearest_cosine": np.array([x[3][0] if x[3] else 0.0 for x in found], float), "neighbour_ids": [x[1] for x in found], "neighbour_labels": [x[2] for x in found],
            }

        return step

    out = "score double, predicted int, n_neighbours int, nearest_cosine double, neighbour_ids array<long>, neighbour_labels array<int>"
    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long", out)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence; learns from labels outside fold 0."""
    index = train(docs, labels.filter(fold(F.col("doc_id")) != 0), per_class)
    scored = score(docs, index)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), *(c for c in scored.columns if c != "doc_id"))


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """The rows of docs that score under 0.5, with all their columns; learns from labels of docs outside fold 0."""
    index = train(docs, labels.filter(fold(F.col("doc_id")) != 0), per_class)
    model = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = model.value, {}
        for part, texts in text_chunks(batches):
            yield part.filter(pa.array([x[0] < 0.5 for x in index.score(texts, seen)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
