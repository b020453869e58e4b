"""Change detection over a versioned source: append scans, assessment of a range, reconciliation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.identity import hex_digest, row_id
from vecloom.plans.spec import Spec
from vecloom.sources.versioned import APPEND, REPLACE, Commit, DataFile, SnapshotGone, VersionedTable

#: Bytes of data files in a unit of work: large enough for a cluster to be busy, small enough to be done again.
UNIT_BYTES = 64 << 30
SAFE, RECONCILE, REANCHOR = "INCREMENTAL_SAFE", "RECONCILE_REQUIRED", "REANCHOR_REQUIRED"


@dataclass(frozen=True)
class Assessment:
    verdict: str
    reason: str
    destructive: list[int] = field(default_factory=list)
    #: Partition values that a reconciliation must re-derive; empty means the whole table.
    affected: list[dict[str, str | None]] = field(default_factory=list)


@dataclass(frozen=True)
class Work:
    """Files to derive, stamped with the version that they count as."""

    files: list[DataFile]
    snapshot_id: int
    seq: int
    committed_at: int
    backfill: bool = False

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)

    @property
    def name(self) -> str:
        """What the queue knows the unit by: its files."""
        return hex_digest(*sorted(f.path for f in self.files))


def assess(table: VersionedTable, start: int, end: int) -> Assessment:
    """Whether the commits in (start, end] can be read as appends alone."""
    commits = table.commits()
    by_seq = {c.seq: c for c in commits}
    if end and end not in by_seq:
        return Assessment(REANCHOR, f"version {end} is not in the log")
    if start > end:
        return Assessment(REANCHOR, f"version {start} is not an ancestor of {end}")
    if start and start not in by_seq and (not commits or start < commits[0].seq - 1):
        return Assessment(REANCHOR, f"version {start} has expired, and with it commits that followed")
    bad = [c for c in commits if start < c.seq <= end and c.operation not in (APPEND, REPLACE)]
    if not bad:
        return Assessment(SAFE, "appends only")
    return Assessment(RECONCILE, f"{len(bad)} commits rewrote or deleted rows", [c.seq for c in bad], affected_partitions(table, bad))


def affected_partitions(table: VersionedTable, commits: Iterable[Commit]) -> list[dict[str, str | None]]:
    """Distinct partition values of what commits added and removed; empty, for all, if they can't be told."""
    if len(table.specs) > 1 or not table.partition_by:
        return []
    found = {f.scope(): f.partition for c in commits for f in (*c.added, *c.removed)}
    return [found[k] for k in sorted(found, key=str)]


def packed(files: Iterable[DataFile], unit_bytes: int) -> list[list[DataFile]]:
    """Files in groups of about unit_bytes, one file at least, in order of path."""
    out: list[list[DataFile]] = []
    held = 0
    for f in sorted(files, key=lambda f: f.path):
        if not out or held + f.bytes > unit_bytes:
            out.append([])
            held = 0
        out[-1].append(f)
        held += f.bytes
    return out


def backfill_work(table: VersionedTable, anchor: int, partitions: list[dict[str, str | None]] | None = None, unit_bytes: int = UNIT_BYTES) -> list[Work]:
    """All files of a version, or those of some partitions, in units, stamped with that version."""
    commit = next((c for c in table.commits() if c.seq == anchor), None)
    if commit is None:
        raise SnapshotGone(f"version {anchor} of {table.name} is gone")
    keep = {tuple(sorted(p.items())) for p in partitions or []}
    files = [f for f in table.live_files(anchor) if not keep or f.scope() in keep]
    return [Work(part, commit.snapshot_id, commit.seq, commit.ts_ms, True) for part in packed(files, unit_bytes)]


def incremental_work(table: VersionedTable, start: int, end: int, unit_bytes: int = UNIT_BYTES) -> list[Work]:
    """Files appended in (start, end], in units of one commit each; refuses a range that isn't appends alone."""
    if start == end:
        return []
    found = assess(table, start, end)
    if found.verdict == REANCHOR:
        raise SnapshotGone(found.reason)
    if found.verdict != SAFE:
        raise ValueError(f"not an append-only range: {found.reason}")
    return [Work(part, c.snapshot_id, c.seq, c.ts_ms) for c in table.commits() if start < c.seq <= end and c.operation == APPEND for part in packed(c.added, unit_bytes)]


def read_work(table: VersionedTable, work: list[Work], columns: Iterable[str]) -> DataFrame:
    """The rows of units of work with the stamps __seq, __snapshot_id, __committed_at; only `columns` are read."""
    return table.read_added([Commit(w.seq, w.snapshot_id, None, w.committed_at, APPEND, w.files) for w in work], columns)


def present_keys(table: VersionedTable, spec: Spec, seq: int) -> DataFrame:
    """source_row_id of every row of a version; reads the key columns alone."""
    return table.read(seq, spec.key_columns).select(row_id(spec.key_columns).alias("source_row_id")).distinct()


def vanished(live_rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Live row ids that the source no longer has."""
    return live_rows.select("source_row_id").distinct().join(keys, "source_row_id", "left_anti")


def check_sweep(keys: DataFrame) -> None:
    """An empty source would make tombstones of everything: refused."""
    if keys.filter(F.col("source_row_id").isNotNull()).isEmpty():
        raise ValueError("the source has no keys at this version: a sweep would delete every row, and is refused")
