"""Language identification: multinomial naive Bayes over hashed character n-grams.

Model: counts of 1- to 4-grams of lower-cased letters (a word's ends count as a space), hashed into 2^16 buckets,
for each language, and the languages' shares of the labelled rows as priors; the log-probability matrix (buckets x
languages) is broadcast, and a batch of texts is scored as a sparse product in numpy: every n-gram gathers its row, rows
are summed by text. The score is the posterior of the most likely language.

Defined results. Null text, or text without a letter: `und`, score 0. Ties: the language first in code-point order.
Repeated rows are scored alike; null and repeated doc_ids pass through. No labelled row at all: every text is `und`.
Extra columns are ignored. Texts are scored whole, whatever their length. More than MAX_LANGS languages: an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import fold, hash_below, map_arrow, map_text, text_chunks

BITS, SMOOTHING = 16, 0.1
ORDERS = (1, 2, 3, 4)
#: About so many labelled texts of each language are learned from (a repeatable sample by doc_id and text).
TRAIN_PER_LANG = 4000
#: The matrix takes 256 KB a language; a table with more languages raises an error.
MAX_LANGS = 1024

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hash bucket of every n-gram of the texts and the text's place, in order."""
    low = [(t or "").lower() for t in texts]
    cps = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    doc = np.repeat(np.arange(len(low)), np.diff(starts))
    doc = np.append(doc, len(low) - 1 if low else 0).astype(np.int32)
    is_letter = letters()[cps]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]  # the space after a word
    cps, doc, is_letter = np.where(is_letter, cps, 32)[keep], doc[keep], is_letter[keep]
    if not is_letter.any():
        return
    for n in ORDERS:
        m = len(cps) - n + 1
        if m <= 0:
            return
        ok = is_letter[:m].copy() if n == 1 else np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= is_letter[k : k + m]
        if n == 2:
            ok &= is_letter[:m] | is_letter[1 : 1 + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ cps[at + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        # the spaces around a word may be another text's: an n-gram belongs to its first letter's
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), doc[np.where(is_letter[at], at, at + 1)]


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the log-probability matrix [bucket, language] and log priors from docs (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    names = sorted(langs)
    if not names:
        return [], np.zeros((1 << BITS, 0)), np.zeros(0)
    share = F.create_map([F.lit(x) for k in names for x in (k, min(1.0, per_lang / langs[k]))])
    sample = rows.filter(F.col("lang").isin(names)).filter(hash_below(F.struct("doc_id", "text"), 11, share[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 << BITS), np.int64)
        place = {k: i for i, k in enumerate(names)}
        for part, texts in text_chunks(batches):
            of = np.array([place[x] for x in part.column("lang").to_pylist()])
            for bucket, doc in ngrams(texts):
                total += np.bincount((of[doc].astype(np.int64) << BITS) + bucket, minlength=total.size).reshape(total.shape)
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[i, b])], ["i", "b", "n"])

    counts = np.zeros((1 << BITS, len(names)))
    got = map_arrow(sample, count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
    counts[got["b"].to_numpy(int), got["i"].to_numpy(int)] = got["n"].to_numpy(float)
    share = np.array([langs[k] for k in names], float)
    return names, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * (1 << BITS))), np.log(share / share.sum())


def score(texts: list[str | None], names: list[str], columns: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The most likely language of each text, and its probability; columns: log probabilities [language, bucket]."""
    sums, seen = np.tile(np.asarray(prior, np.float64), (len(texts), 1)), np.zeros(len(texts), np.int64)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    for bucket, doc in ngrams(texts):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        for k in range(len(names)):
            sums[doc[first], k] += np.add.reduceat(columns[k][bucket], first, dtype=np.float64)
        seen += np.bincount(doc, minlength=len(texts))
    p = np.exp(sums - sums.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [names[b] if n else "und" for b, n in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen > 0, p.max(1), 0.0)


def detect(docs: DataFrame, names: list[str], logp: np.ndarray, prior: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logp.astype(np.float32).T), prior))  # MAX_LANGS x 256 KB

    def make():
        known, columns, first = model.value

        def step(texts):
            pred, p = score(texts, known, columns, first)
            return {"lang_pred": pred, "score": p}

        return step

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long", "lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows outside fold 0."""
    model = train(docs.filter(fold(F.col("doc_id")) != 0), per_lang)
    return detect(docs, *model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
