"""The derivation function: which columns become which vectors."""

from __future__ import annotations

from dataclasses import dataclass

from vecloom.functions.identity import hex_digest


@dataclass(frozen=True)
class Spec:
    source_table: str
    key_columns: tuple[str, ...]
    embedding_columns: tuple[str, ...]
    model_name: str
    join_separator: str = " "
    chunker: str = "whole"
    chunk_size: int = 0
    chunk_overlap: int = 0
    model_revision: str = ""
    embedding_version: str = "v1"
    normalize: bool = False

    @property
    def config_id(self) -> str:
        """Sixteen hex digits over all that shapes a vector; neither source nor keys, so that tables share content."""
        parts = {
            "cols": ",".join(self.embedding_columns), "sep": self.join_separator, "chunker": self.chunker, "chunkSize": self.chunk_size, "chunkOverlap": self.chunk_overlap,
            "model": self.model_name, "revision": self.model_revision, "version": self.embedding_version, "normalize": str(self.normalize).lower(),
        }
        return hex_digest(*(f"{k}={v}" for k, v in parts.items()))[:16]

    @property
    def model_version(self) -> str:
        return f"{self.model_name}:{self.embedding_version}"

    @property
    def needed(self) -> list[str]:
        """The columns that a source scan reads."""
        return list(dict.fromkeys((*self.key_columns, *self.embedding_columns)))
