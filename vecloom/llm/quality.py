"""Quality rules: tokeniser fertility.

A public vocabulary is run over the whole text. Three figures are held against bands that depend on the text's main
script: characters of words per token, the share of byte-fallback tokens, and the entropy of the token distribution
(in bits, judged against the most that so many tokens could have). Base rules: too few words, or repeated 3-word windows.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results. Null or empty text: no words, all counts 0, base_failed, not kept.
Texts are read whole; repeated rows are judged alike; null ids pass through; extra columns are ignored by `measure`
and returned by `keep_clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import pieces
from vecloom.llm.base import map_arrow, map_text, text_chunks

MIN_WORDS, MAX_REPEAT = 50, 0.5
SYMBOLS = "#*$%&|<>"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Indic", "Thai", "Kana", "Hangul", "Han", "none")
#: script -> least and most characters a token, most byte tokens (share), least entropy (bits) as a share of log2(min(tokens, 512)).
BANDS = {
    "Latin": (1.35, 7.5, 0.12, 0.67),
    "Cyrillic": (1.0, 6.5, 0.2, 0.5),
    "Greek": (0.6, 5.0, 0.4, 0.45),
    "Han": (0.4, 3.0, 0.85, 0.45),
    "Kana": (0.4, 3.0, 0.6, 0.45),
    "Hangul": (0.35, 3.0, 0.85, 0.4),
    "none": (0.8, 8.0, 0.5, 0.5),
}
OTHER = (0.3, 8.0, 0.98, 0.35)
_RANGES = [(0x41, 0x24F, 0), (0x1E00, 0x1EFF, 0), (0x370, 0x3FF, 2), (0x400, 0x52F, 1), (0x590, 0x5FF, 4), (0x600, 0x77F, 3), (0x900, 0xDFF, 5), (0xE00, 0xE7F, 6), (0x3040, 0x30FF, 7), (0x1100, 0x11FF, 8), (0xAC00, 0xD7AF, 8), (0x3400, 0x9FFF, 9), (0x20000, 0x3FFFF, 9)]
_script: np.ndarray | None = None


def script_table() -> np.ndarray:
    global _script
    if _script is None:
        from vecloom.llm.langid import letters

        table = np.full(0x110000, 255, np.uint8)
        for lo, hi, k in _RANGES:
            table[lo : hi + 1] = k
        table[~letters() & (table != 5) & (table != 6)] = 255
        _script = table
    return _script


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    words: list[bytes] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        ws = t.encode("utf-8", "surrogatepass").split()
        words += ws
        out["n_words"][i] = len(ws)
        out["word_chars"][i] = len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))
        out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if len(words) >= 3:
        known = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(n), out["n_words"])
        inside = doc[:-2] == doc[2:]
        _, pair = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)
        _, of, count = np.unique(((pair * len(known) + ids[2:]) * n + doc[2:])[inside], return_inverse=True, return_counts=True)
        at = np.flatnonzero(inside)[count[of] > 1]
        hit = np.zeros(len(words), bool)
        for k in range(3):
            hit[at + k] = True
        out["n_repeat_words"] = np.bincount(doc[hit], minlength=n).astype(np.int64)
    return out


def fertility(texts: list[str | None], model: pieces.PieceModel, word_chars: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, chars_per_token, byte_share, entropy and main script of each text."""
    n = len(texts)
    ids, at = model.encode_flat(texts)
    tokens = np.diff(at)
    doc = np.repeat(np.arange(n), tokens)
    is_byte = np.array([k == pieces.BYTE for k in model.kinds])
    cell, count = np.unique(doc * len(model.pieces) + ids, return_counts=True)
    own = cell // len(model.pieces)
    # bytes that stand for white space are no sign of a foreign text
    blank = np.isin(cell % len(model.pieces), model.byte_ids[[9, 10, 11, 12, 13]])
    odd = np.bincount(own, np.where(is_byte[cell % len(model.pieces)] & ~blank, count, 0), n)
    p = count / np.maximum(tokens[own], 1)
    entropy = np.bincount(own, -p * np.log2(p), n)
    cps = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = script_table()[cps]
    which = np.repeat(np.arange(n), [len(t or "") for t in texts])[kind < 255]
    by = np.bincount(which * 10 + kind[kind < 255], minlength=n * 10).reshape(n, 10)
    script = np.where(by.sum(1) > 0, by.argmax(1), 10)
    return {"n_tokens": tokens, "chars_per_token": word_chars / np.maximum(tokens, 1), "byte_share": odd / np.maximum(tokens, 1), "entropy": entropy, "script": script}


def verdict(f: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each text lies within its script's bands."""
    table = np.array([BANDS.get(s, OTHER) for s in SCRIPTS])[f["script"]]
    room = np.log2(np.clip(f["n_tokens"], 2, 512))
    return (f["chars_per_token"] >= table[:, 0]) & (f["chars_per_token"] <= table[:, 1]) & (f["byte_share"] <= table[:, 2]) & (f["entropy"] >= table[:, 3] * room)


def judge(texts: list[str | None], model: pieces.PieceModel) -> dict[str, np.ndarray]:
    out = base_counts(texts)
    f = fertility(texts, model, out["word_chars"])
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 100 * MAX_REPEAT * out["n_words"])
    out["kept"] = ~out["base_failed"] & verdict(f)
    out |= {k: f[k] for k in ("chars_per_token", "byte_share", "entropy")}
    out["script"] = [SCRIPTS[i] for i in f["script"].tolist()]
    return out


def measure(docs: DataFrame, path: str = pieces.MODEL) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the fertility figures of every row of docs (doc_id, text)."""
    held = pieces.shared(docs.sparkSession, path)

    def make():
        model = held.value

        def step(texts):
            return judge(texts, model)

        step.done = model.forget
        return step

    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, entropy double, script string"
    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long", out)


def keep_clean(docs: DataFrame, path: str = pieces.MODEL) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; any schema that has a string column `text`."""
    held = pieces.shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        try:
            for part, texts in text_chunks(batches):
                yield part.filter(pa.array(judge(texts, model)["kept"]))
        finally:
            model.forget()

    return map_arrow(docs, run, docs.schema)
