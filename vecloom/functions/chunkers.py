"""Chunkers: a text column to an array of (ordinal, text), by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.plans.spec import Spec

#: White space as Unicode has it, but for the no-break spaces, which count as content.
BLANK = r"\A[\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]*\z"


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def _chunk(ordinal: Column, text: Column) -> Column:
    return F.struct(ordinal.cast("int").alias("ordinal"), text.alias("text"))


def _none() -> Column:
    return F.array().cast("array<struct<ordinal:int,text:string>>")


def whole(text: Column) -> Column:
    """One chunk, or none for a blank text."""
    return F.when(is_blank(text), _none()).otherwise(F.array(_chunk(F.lit(0), text)))


def fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` code points every size - overlap, up to the first that reaches the end; none for a blank text."""
    check_sizes(size, overlap)
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _chunk(i, F.substring(text, i * step + 1, F.lit(size))))
    return F.when(is_blank(text), _none()).otherwise(windows)


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk size must be positive: {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"chunk overlap must be at least 0 and below the size: {overlap}")


def chunker(name: str | None, size: int = 0, overlap: int = 0) -> Callable[[Column], Column]:
    """The chunker of that name, whatever its case; blank means `whole`."""
    known = (name or "").strip().lower() or "whole"
    if known == "whole":
        return whole
    if known == "fixed":
        check_sizes(size, overlap)
        return lambda text: fixed(text, size, overlap)
    raise ValueError(f"unknown chunker: {name!r}; known are fixed, whole")


def of_spec(spec: Spec) -> Callable[[Column], Column]:
    return chunker(spec.chunker, spec.chunk_size, spec.chunk_overlap)
