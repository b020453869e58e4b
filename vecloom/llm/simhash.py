"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered, `shingle` words a shingle (repeats count), XXH64
with seed 42; a bit is set if over half the hashes set it.

Anchors: bits 0-22 and 23-45 are each covered by the binary Golay code, perfect with radius 3, so that an anchor is a
pair of codewords (2^24 in all) and the other 18 bits are left free. Two fingerprints at distance 3 or less have a
point between them, one bit from the one and two from the other at most. Its anchor lies within radius + 2 of both,
block by block, so it is enough to copy each fingerprint to every anchor within the covering radius plus what two
changed bits can reach: about 61 anchors, found by table from each block's syndrome. Fingerprints of equal anchors
are compared exactly, and each group answers with a spanning forest of its links, never with all its pairs.

Skew: equal fingerprints are one row before any copying. An anchor with over HOT fingerprints passes through as is; in
a second pass its fingerprints are dealt to chunks, and every pair of chunks is compared in a task of its own.

Defined results. Null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle: the
whole sequence is one. Repeated rows and ids keep their rows; rows with a null id take part in links but name no
component. Extra columns are ignored by `near_duplicates` and returned by `keep_one`. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import map_arrow, map_text, materialize
from vecloom.llm.components import components

THRESHOLD, HOT = 3, 20_000
GOLAY = 0b101011100011


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """The fingerprint of each text, as int64."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        if not words:
            continue
        grams = map(join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [join(words)]
        h = np.array([digest(g, 42) for g in grams], np.uint64)
        bits = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 16):
            part = h[lo : lo + (1 << 16)].astype("<u8")
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weights[2 * bits > len(h)].sum(dtype=np.uint64)
    return out.view(np.int64)


class Cover:
    """Tables of the Golay code: the codeword nearest to each 23-bit word, and those a few flips away."""

    def __init__(self, flips: int = 2) -> None:
        self.flips = flips
        low, checks = np.arange(1 << 12, dtype=np.int64), []
        for i in range(12):  # the remainder of x^(11+i) by the generator polynomial
            r = 1 << (11 + i)
            for k in range(22, 10, -1):
                if r >> k & 1:
                    r ^= GOLAY << (k - 11)
            checks.append(r)
        self.checks = np.array(checks)
        code = low << 11
        for i in range(12):
            code ^= np.where(low >> i & 1, checks[i], 0)
        leader = np.zeros(1 << 11, np.int64)
        positions = range(23)
        for a in positions:
            for b in positions:
                for c in positions:
                    if a <= b <= c:
                        e = 1 << a | 1 << b | 1 << c
                        leader[self.syndrome(np.array([e]))[0]] = e
        leader[0] = 0
        for a in positions:  # lighter leaders last
            for b in range(a):
                leader[self.syndrome(np.array([1 << a | 1 << b]))[0]] = 1 << a | 1 << b
        for a in positions:
            leader[self.syndrome(np.array([1 << a]))[0]] = 1 << a
        self.leader = leader
        # by syndrome: codeword offsets whose distance from the leader is 3 + j at most, in order of j
        d = np.bitwise_count(leader[:, None] ^ code[None, :]).astype(np.int64)
        over = np.maximum(d - 3, 0)
        self.lists = []
        for j in range(flips + 1):
            s, c = np.nonzero(over == j)
            start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << 11))])
            self.lists.append((code[c] >> 11, start))

    def syndrome(self, y: np.ndarray) -> np.ndarray:
        s = y & 0x7FF
        for i in range(12):
            s = s ^ np.where(y >> (11 + i) & 1, self.checks[i], 0)
        return s

    def anchors(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of f, anchor) for all anchors that `flips` changed bits of a fingerprint can reach."""
        u = f.view(np.uint64)
        blocks = []
        for shift in (0, 23):
            y = (u >> np.uint64(shift) & np.uint64(0x7FFFFF)).astype(np.int64)
            s = self.syndrome(y)
            blocks.append((s, (y ^ self.leader[s]) >> 11))
        (s1, m1), (s2, m2) = blocks
        rows, found = [], []
        for i in range(self.flips + 1):
            for j in range(self.flips + 1 - i):
                (c1, at1), (c2, at2) = self.lists[i], self.lists[j]
                n1, n2 = at1[s1 + 1] - at1[s1], at2[s2 + 1] - at2[s2]
                n = n1 * n2
                row = np.repeat(np.arange(len(f)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                w = n2[row]
                a = c1[at1[s1][row] + k // w] ^ m1[row]
                b = c2[at2[s2][row] + k % w] ^ m2[row]
                rows.append(row)
                found.append(a << 12 | b)
        return np.concatenate(rows), np.concatenate(found).astype(np.int32)


def forest(f: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links that connect whatever links of at most `threshold` bits connect (distinct f)."""
    left, out = np.arange(len(f)), []
    u = f.view(np.uint64)
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:128], front[128:]
            near = np.bitwise_count(u[now][:, None] ^ u[left][None, :]) <= threshold
            hit = near.any(0)
            if hit.any():
                out.append((now[near[:, hit].argmax(0)], left[hit]))
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


class Comparer:
    """Links of fingerprints that come sorted by key, in batches."""

    def __init__(self, hot: int) -> None:
        self.hot, self.key, self.f, self.passing = hot, np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def feed(self, key: np.ndarray, f: np.ndarray, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(a, b, 0) for links, (key, fingerprint, 1) for members of a key with over `hot` of them."""
        key, f = np.concatenate([self.key, key]), np.concatenate([self.f, f])
        if self.passing is not None:  # the rest of a hot key
            n = int(np.searchsorted(key, self.passing, "right"))
            if n:
                yield key[:n], f[:n], 1
            key, f = key[n:], f[n:]
            if len(key):
                self.passing = None
        end = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1], "left"))
        if len(key) - end > self.hot:  # the key goes on, and is hot already
            self.passing = int(key[-1])
            yield key[end:], f[end:], 1
            self.key, self.f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            self.key, self.f = key[end:], f[end:]
        key, f = key[:end], f[:end]
        if not len(key):
            return
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(first, len(key)))
        few = np.repeat(size, size) <= 32
        k, g = key[few], f[few]
        pairs = []
        for lag in range(1, 32):
            same = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else np.zeros(0, np.int64)
            if not len(same):
                break
            a, b = g[same], g[same + lag]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= THRESHOLD
            pairs.append((a[near], b[near]))
        if pairs:
            yield np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), 0
        for at, n in zip(first[size > 32].tolist(), size[size > 32].tolist(), strict=True):
            own = f[at : at + n]
            if n > self.hot:
                yield key[at : at + n], own, 1
            else:
                i, j = forest(own)
                yield own[i], own[j], 0


def _compare(rows: DataFrame, hot: int) -> DataFrame:
    """a, b, kind of Comparer over rows (key, f), dealt out and sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Comparer(hot)
        empty = np.zeros(0, np.int64)
        for batch in batches:
            yield from out(own.feed(batch.column("key").to_numpy().astype(np.int64), batch.column("f").to_numpy()))
        yield from out(own.feed(empty, empty, True))

    def out(found) -> Iterator[pa.RecordBatch]:
        for a, b, kind in found:
            if not len(a):
                continue
            if kind == 0:
                both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
                a, b = both[:, 0], both[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), run, "a long, b long, kind int")


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints f of prints at THRESHOLD or fewer differing bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover()
        for batch in batches:
            f = batch.column("f").to_numpy()
            for lo in range(0, len(f), 8192):
                part = f[lo : lo + 8192]
                row, anchor = cover.anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["key", "f"])

    # copies of a fingerprint are many times its size: they are made by as many tasks as a shuffle has
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.filter("f is not null").select("f").distinct().repartition(tasks, "f")
    found = materialize(_compare(map_arrow(distinct, spread, "key int, f long"), hot), "links")
    warm = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("f"))
    if warm.isEmpty():
        return found.filter("kind = 0").select("a", "b")
    sizes = warm.groupBy("key").agg(F.ceil(F.count("*") / (hot / 2)).cast("int").alias("g"))
    chunk = F.pmod(F.xxhash64("f"), F.col("g").cast("long")).cast("int")
    dealt = warm.join(sizes, "key").withColumn("c", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = dealt.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "f")
    more = materialize(_compare(cells, 1 << 40), "links")
    return found.filter("kind = 0").select("a", "b").union(more.select("a", "b"))


def fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h (the text's hash), f for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return map_text(rows, lambda: lambda texts: {"f": fingerprints(texts, shingle)}, "doc_id long, h long", "f long")


def classes(docs: DataFrame, shingle: int, hot: int) -> DataFrame:
    """doc_id, h, f, root (a fingerprint) and component_id of every row of docs."""
    prints = materialize(fingerprint(docs, shingle), "prints")
    own = prints.groupBy("f").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints, hot)).select(F.col("v").alias("f"), "root")
    named = own.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("f", "root", "component_id"), "f")


def near_duplicates(docs: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs."""
    return classes(docs, shingle, hot).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """One row of docs for each component, all columns kept: that of the smallest (doc_id, hash of the text), nulls last."""
    each = classes(docs, shingle, hot).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("d"), F.col("h").alias("g"), "n")).alias("k")).select("k.d", "k.g", "k.n")
    first = materialize(first, "kept")
    # the user's columns travel in one struct, so that no name of theirs can meet one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("i"), F.xxhash64("row.text").alias("h"))
    match = rows["i"].eqNullSafe(first["d"]) & (rows["h"] == first["g"])
    once = rows.join(first.filter("n = 1"), match, "left_semi")
    more = rows.join(first.filter("n > 1"), match, "left_semi").dropDuplicates(["i", "h"])
    return (once if first.filter("n > 1").isEmpty() else once.union(more)).select("row.*")
