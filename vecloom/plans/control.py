"""The control plane: admission, life of a materialization, and the leased queue of work.

State is small and transactional, so it lives in SQLite: one file for all processes of a driver host, beside the catalog
where that is on a local disk; for catalogs elsewhere a path must be named, and `:memory:` must be asked for. Writers take
the lock at once (BEGIN IMMEDIATE), which makes leases exclusive; a lease is renewed while its work goes on.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import functions as F

from vecloom.functions import chunkers
from vecloom.functions.identity import dedup_key
from vecloom.plans.spec import Spec
from vecloom.sources.catalog import Catalog

TRANSITIONS = {
    "REGISTERED": {"VALIDATED", "PAUSED", "RETIRING", "RETIRED"},
    "VALIDATED": {"BACKFILLING", "PAUSED", "RETIRING", "RETIRED"},
    "BACKFILLING": {"LIVE", "DEGRADED", "PAUSED", "RETIRING"},
    "LIVE": {"MIGRATING", "DEGRADED", "PAUSED", "RETIRING"},
    "MIGRATING": {"LIVE", "DEGRADED", "PAUSED", "RETIRING"},
    "DEGRADED": {"LIVE", "BACKFILLING", "PAUSED", "RETIRING"},
    "PAUSED": {"VALIDATED", "BACKFILLING", "LIVE", "MIGRATING", "RETIRING", "RETIRED"},
    "RETIRING": {"RETIRED"},
    "RETIRED": set(),
}
RUNNABLE = ("VALIDATED", "BACKFILLING", "LIVE")
MAX_ATTEMPTS, MAX_LEASE, LEASE_S = 3, 500, 300
PRIORITY = {"INCREMENTAL": 0, "BACKFILL": 100}


class IllegalTransition(RuntimeError): ...


class Rejected(ValueError):
    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


class AlreadyExists(Rejected): ...


@dataclass(frozen=True)
class Admission:
    problems: list[str]
    warnings: list[str]
    config_id: str
    estimate: dict[str, float]
    id: str | None = None


_DDL = """
create table if not exists materialization (
  id text primary key, source_table text, config_id text, spec text, state text, anchor_snapshot integer, anchor_seq integer, watermark integer default 0,
  last_error text, serving integer default 0, freshness_s integer, caught_up_ms integer, created_ms integer, unique (source_table, config_id));
create unique index if not exists one_serving on materialization (source_table) where serving = 1;
create table if not exists work (
  dedup text primary key, materialization_id text, path text, snapshot_id integer, seq integer, kind text, priority integer, rows integer, state text default 'PENDING',
  attempts integer default 0, owner text, lease_ms integer, error text, created_ms integer);
create table if not exists embedded (model_version text, config_id text, content_hash text, primary key (model_version, config_id, content_hash)) without rowid;
create table if not exists registered (name text primary key, columns text, model text, embedding_version text, enabled integer, snapshot_id integer, seq integer);
create table if not exists derived (source_table text, config_id text, metric text, value real, primary key (source_table, config_id, metric));
"""


class Control:
    def __init__(self, catalog: Catalog, path: str | None = None, clock: Callable[[], float] = time.time) -> None:
        self.catalog, self.clock = catalog, clock
        if path is None:
            scheme, _, rest = catalog.root.partition("://")
            if rest and scheme != "file":
                raise ValueError(f"the catalog is at {catalog.root}: name a path on the driver's disk for its control state")
            folder = rest or catalog.root.removeprefix("file:")
            os.makedirs(folder, exist_ok=True)
            path = f"{folder}/control.sqlite"
        self.db = sqlite3.connect(path, isolation_level=None, check_same_thread=False, timeout=60)
        self.db.row_factory = sqlite3.Row
        self.lock = threading.RLock()
        self.db.executescript(_DDL)

    @contextmanager
    def _tx(self) -> Iterator[sqlite3.Connection]:
        with self.lock:
            self.db.execute("begin immediate")
            try:
                yield self.db
            except BaseException:
                self.db.execute("rollback")
                raise
            self.db.execute("commit")

    def _now(self) -> int:
        return int(self.clock() * 1000)

    def _all(self, sql: str, *args: object) -> list[dict]:
        with self.lock:
            return [dict(r) for r in self.db.execute(sql, args)]

    # -- admission

    def admit(self, spec: Spec, dry_run: bool = False, freshness_s: int | None = None) -> Admission:
        """Check a spec against its source; registers it unless it is a dry run. All problems are reported at once."""
        problems, warnings = [], []
        problems += [f"no {what}" for what, v in (("source table", spec.source_table), ("model", spec.model_name), ("key columns", spec.key_columns), ("embedding columns", spec.embedding_columns)) if not v]
        problems += [f"a column name must not hold a comma: {c!r}" for c in spec.needed if "," in c]
        if not spec.model_revision:
            warnings.append("the model revision is not pinned")
        if len(set(spec.embedding_columns)) < len(spec.embedding_columns):
            warnings.append("an embedding column is repeated")
        if spec.join_separator == " " and len(spec.embedding_columns) > 1:
            warnings.append("columns are joined by a space: ('a b', 'c') and ('a', 'b c') share content")
        if spec.chunker not in ("whole", "fixed"):
            problems.append(f"unknown chunker: {spec.chunker!r}")
        elif spec.chunker == "fixed":
            try:
                chunkers.check_sizes(spec.chunk_size, spec.chunk_overlap)
            except ValueError as e:
                problems.append(str(e))
        elif spec.chunk_size or spec.chunk_overlap:
            warnings.append("the sizes have no effect on whole texts")
        table = self.catalog.load(spec.source_table) if spec.source_table else None
        estimate: dict[str, float] = {}
        if table is None or table.current() is None:
            problems.append(f"there is no table {spec.source_table!r}, or it has no version")
        else:
            types = {f.name: f.dataType.simpleString() for f in table.schema}
            problems += [f"no key column {c!r}" for c in spec.key_columns if c not in types]
            problems += [f"no embedding column {c!r}" for c in spec.embedding_columns if c not in types]
            problems += [f"embedding column {c!r} is not a string" for c in spec.embedding_columns if types.get(c, "string") != "string"]
            keys = [c for c in spec.key_columns if c in types]
            if keys and len(keys) == len(spec.key_columns):
                bad = table.read(columns=keys).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in keys)).first()
                problems += [f"key column {c!r} has nulls" for c in keys if bad[c]]
            estimate = self.estimate(spec)
        same = self._all("select id from materialization where source_table = ? and config_id = ?", spec.source_table, spec.config_id)
        if same:
            (warnings if dry_run else problems).append(f"this source has this configuration already: {same[0]['id']}")
        if dry_run or problems:
            if problems and not dry_run:
                raise (AlreadyExists if same and len(problems) == 1 else Rejected)(problems)
            return Admission(problems, warnings, spec.config_id, estimate)
        snapshot, seq = table.version()
        new = uuid.uuid4().hex
        with self._tx() as db:
            db.execute("insert into materialization (id, source_table, config_id, spec, state, anchor_snapshot, anchor_seq, freshness_s, created_ms) values (?,?,?,?,?,?,?,?,?)", (new, spec.source_table, spec.config_id, json.dumps(asdict(spec)), "VALIDATED", snapshot, seq, freshness_s, self._now()))
        return Admission([], warnings, spec.config_id, estimate, new)

    def estimate(self, spec: Spec) -> dict[str, float]:
        """Rows, files, bytes and chunks, from the log alone."""
        table = self.catalog.table(spec.source_table)
        s = table.status()
        per_row = 1
        if spec.chunker == "fixed" and s["records"] and s["bytes"]:
            share = min(1.0, len(spec.embedding_columns) / len(table.schema))
            per_row = max(1, math.ceil(s["bytes"] / s["records"] * share / max(1, spec.chunk_size - spec.chunk_overlap)))
        return {"rows": s["records"], "files": s["files"], "bytes": s["bytes"], "chunks_per_row": per_row, "chunks": math.ceil(s["records"] * per_row)}

    # -- life

    def get(self, id_: str) -> dict:
        found = self._all("select * from materialization where id = ?", id_)
        if not found:
            raise LookupError(f"there is no materialization {id_}")
        return found[0]

    def spec(self, id_: str) -> Spec:
        """The spec, whose configuration must hash to the one that was admitted."""
        row = self.get(id_)
        raw = json.loads(row["spec"])
        spec = Spec(**raw | {k: tuple(raw[k]) for k in ("key_columns", "embedding_columns")})
        if spec.config_id != row["config_id"]:
            raise RuntimeError(f"the spec of {id_} gives configuration {spec.config_id}, not {row['config_id']}")
        return spec

    def list(self, state: str | None = None) -> list[dict]:
        return self._all("select * from materialization where ? is null or state = ? order by created_ms, id", state, state)

    def runnable(self) -> list[dict]:
        return [m for m in self.list() if m["state"] in RUNNABLE]

    def _move(self, id_: str, to: str, **more: object) -> dict:
        with self._tx() as db:
            row = db.execute("select state from materialization where id = ?", (id_,)).fetchone()
            if row is None:
                raise LookupError(f"there is no materialization {id_}")
            if row["state"] != to and to not in TRANSITIONS[row["state"]]:
                raise IllegalTransition(f"{row['state']} cannot become {to}")
            more |= {"state": to}
            db.execute(f"update materialization set {', '.join(f'{k} = ?' for k in more)} where id = ?", (*more.values(), id_))
        return self.get(id_)

    def backfilling(self, id_: str) -> dict:
        return self._move(id_, "BACKFILLING")

    def live(self, id_: str, watermark: int) -> dict:
        """Live up to a sequence number; it never decreases, and clears the last error."""
        return self._move(id_, "LIVE", watermark=max(watermark, self.get(id_)["watermark"]), last_error=None, caught_up_ms=self._now())

    def degraded(self, id_: str, error: str) -> dict:
        return self._move(id_, "DEGRADED", last_error=error)

    def pause(self, id_: str) -> dict:
        return self._move(id_, "PAUSED")

    def resume(self, id_: str) -> dict:
        """From PAUSED to what the watermark allows; from DEGRADED by anchoring at the current version, the reason kept."""
        m = self.get(id_)
        if m["state"] == "DEGRADED":
            snapshot, seq = self.catalog.table(m["source_table"]).version()
            return self._move(id_, "BACKFILLING", anchor_snapshot=snapshot, anchor_seq=seq, watermark=0)
        if m["state"] != "PAUSED":
            raise IllegalTransition(f"{m['state']} cannot be resumed")
        return self._move(id_, "LIVE" if m["watermark"] >= m["anchor_seq"] > 0 else "VALIDATED")

    def retire(self, id_: str) -> dict:
        """Vectors are never deleted."""
        return self._move(id_, "RETIRED" if self.get(id_)["state"] in ("REGISTERED", "VALIDATED", "PAUSED") else "RETIRING", serving=0)

    def complete_retire(self, id_: str) -> dict:
        return self._move(id_, "RETIRED")

    def blockers(self, id_: str) -> list[str]:
        m = self.get(id_)
        return [w for w, bad in (("not live", m["state"] != "LIVE"), ("nothing published", not m["watermark"]), (f"last error: {m['last_error']}", m["last_error"])) if bad]

    def promote(self, id_: str) -> dict:
        """Make this the one that serves its source."""
        if found := self.blockers(id_):
            raise IllegalTransition("; ".join(found))
        with self._tx() as db:
            db.execute("update materialization set serving = 0 where source_table = (select source_table from materialization where id = ?)", (id_,))
            db.execute("update materialization set serving = 1 where id = ?", (id_,))
        return self.get(id_)

    def progress(self, id_: str) -> dict:
        """State, watermark, lag in versions, and whether freshness is breached (LIVE and DEGRADED alone)."""
        m = self.get(id_)
        head = self.catalog.table(m["source_table"]).version()[1]
        late = m["freshness_s"] is not None and head > m["watermark"] and (self._now() - (m["caught_up_ms"] or m["created_ms"])) / 1000 > m["freshness_s"]
        return m | {"head": head, "lag": max(0, head - m["watermark"]), "sla_breached": bool(late and m["state"] in ("LIVE", "DEGRADED"))}

    # -- queue

    def enqueue(self, id_: str, items: list[tuple[str, int, int, int]], kind: str = "INCREMENTAL") -> int:
        """Add units (path, snapshot id, sequence number, rows); what is queued already is left alone."""
        now = self._now()
        with self._tx() as db:
            rows = sorted((dedup_key(id_, p, s), id_, p, s, q, kind, PRIORITY[kind], n, now) for p, s, q, n in items)
            return sum(db.execute("insert or ignore into work (dedup, materialization_id, path, snapshot_id, seq, kind, priority, rows, created_ms) values (?,?,?,?,?,?,?,?,?)", r).rowcount for r in rows)

    def lease(self, owner: str, limit: int = 8, lease_s: int = LEASE_S, id_: str | None = None) -> list[dict]:
        """Take pending units, by priority and age, for a time."""
        with self._tx() as db:
            rows = [dict(r) for r in db.execute("select * from work where state = 'PENDING' and (? is null or materialization_id = ?) order by priority, created_ms, seq, dedup limit ?", (id_, id_, min(limit, MAX_LEASE)))]
            until = self._now() + lease_s * 1000
            db.executemany("update work set state = 'LEASED', owner = ?, lease_ms = ? where dedup = ?", [(owner, until, r["dedup"]) for r in rows])
        return [r | {"state": "LEASED", "owner": owner, "lease_ms": until} for r in rows]

    def renew(self, dedup: str, owner: str, lease_s: int = LEASE_S) -> bool:
        """Hold a lease for longer; False if it is no longer the owner's."""
        with self._tx() as db:
            return db.execute("update work set lease_ms = ? where dedup = ? and owner = ? and state = 'LEASED'", (self._now() + lease_s * 1000, dedup, owner)).rowcount > 0

    @contextmanager
    def holding(self, dedup: str, owner: str, lease_s: int = LEASE_S) -> Iterator[None]:
        """Renew a lease every third of its time while the block runs."""
        done = threading.Event()

        def keep() -> None:
            while not done.wait(lease_s / 3):
                if not self.renew(dedup, owner, lease_s):
                    return

        thread = threading.Thread(target=keep, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    def complete(self, dedup: str, owner: str, embedded: list[tuple[str, str, str]] = ()) -> bool:
        """Done, together with the record of (model version, configuration, content); repeating it changes nothing."""
        with self._tx() as db:
            row = db.execute("select state, owner from work where dedup = ?", (dedup,)).fetchone()
            if row is None or (row["state"] != "DONE" and row["owner"] != owner):
                return False
            db.executemany("insert or ignore into embedded values (?,?,?)", embedded)
            db.execute("update work set state = 'DONE', lease_ms = null where dedup = ?", (dedup,))
        return True

    def fail(self, dedup: str, owner: str, error: str) -> bool:
        """One attempt more; FAILED after the last. Another owner's word is ignored."""
        with self._tx() as db:
            return db.execute(f"update work set attempts = attempts + 1, error = ?, owner = null, lease_ms = null, state = case when attempts + 1 >= {MAX_ATTEMPTS} then 'FAILED' else 'PENDING' end where dedup = ? and owner = ? and state = 'LEASED'", (error, dedup, owner)).rowcount > 0

    def reclaim(self) -> int:
        """Leases that ran out count as failed attempts."""
        with self._tx() as db:
            return db.execute(f"update work set attempts = attempts + 1, owner = null, lease_ms = null, state = case when attempts + 1 >= {MAX_ATTEMPTS} then 'FAILED' else 'PENDING' end where state = 'LEASED' and lease_ms < ?", (self._now(),)).rowcount

    def open_units(self, id_: str, paths: list[str]) -> int:
        """How many of the units are not done."""
        states = {r["path"]: r["state"] for r in self._all("select path, state from work where materialization_id = ?", id_)}
        return sum(states.get(p, "DONE") != "DONE" for p in paths)

    def queue_depth(self) -> dict[str, int]:
        return {r["state"]: r["n"] for r in self._all("select state, count(*) n from work group by state")}

    def embedded_probe(self, model_version: str, config_id: str, hashes: list[str]) -> set[str]:
        out: set[str] = set()
        for lo in range(0, len(hashes), 500):
            part = hashes[lo : lo + 500]
            out |= {r["content_hash"] for r in self._all(f"select content_hash from embedded where model_version = ? and config_id = ? and content_hash in ({','.join('?' * len(part))})", model_version, config_id, *part)}
        return out

    def embedded_count(self, model_version: str, config_id: str) -> int:
        return self._all("select count(*) n from embedded where model_version = ? and config_id = ?", model_version, config_id)[0]["n"]

    # -- tables registered by hand, with the version that they were last synchronised to

    def register_table(self, name: str, columns: list[str], model: str, embedding_version: str = "v1", enabled: bool = True) -> dict:
        """Register a table once; its name, columns and model must be there."""
        if not name or not columns or not model:
            raise Rejected([f"no {what}" for what, v in (("table", name), ("columns", columns), ("model", model)) if not v])
        with self._tx() as db:
            if db.execute("select 1 from registered where name = ?", (name,)).fetchone():
                raise AlreadyExists([f"table {name!r} is registered already"])
            db.execute("insert into registered values (?,?,?,?,?,0,0)", (name, json.dumps(columns), model, embedding_version, int(enabled)))
        return self.registered(name)

    def registered(self, name: str) -> dict:
        found = self._all("select * from registered where name = ?", name)
        if not found:
            raise LookupError(f"table {name!r} is not registered")
        return found[0] | {"columns": json.loads(found[0]["columns"]), "enabled": bool(found[0]["enabled"])}

    def set_embedding(self, name: str, model: str, embedding_version: str) -> dict:
        """Another model or version starts the table anew; the same ones change nothing."""
        now = self.registered(name)
        if (now["model"], now["embedding_version"]) != (model, embedding_version):
            self._set(name, model=model, embedding_version=embedding_version, snapshot_id=0, seq=0)
        return self.registered(name)

    def set_enabled(self, name: str, enabled: bool) -> dict:
        self._set(name, enabled=int(enabled))
        return self.registered(name)

    def synchronised(self, name: str, snapshot_id: int, seq: int) -> dict:
        self._set(name, snapshot_id=snapshot_id, seq=seq)
        return self.registered(name)

    def unregister(self, name: str, delete_embeddings: bool = False) -> None:
        if delete_embeddings:
            raise Rejected(["vectors are shared by content and are never deleted with a table"])
        self.registered(name)
        with self._tx() as db:
            db.execute("delete from registered where name = ?", (name,))

    def _set(self, name: str, **values: object) -> None:
        self.registered(name)
        with self._tx() as db:
            db.execute(f"update registered set {', '.join(f'{k} = ?' for k in values)} where name = ?", (*values.values(), name))

    # -- metrics

    def record(self, source: str, config_id: str, values: dict[str, float]) -> None:
        with self._tx() as db:
            db.executemany("insert into derived values (?,?,?,?) on conflict do update set value = value + excluded.value", [(source, config_id, k, v) for k, v in values.items()])

    def metrics(self, source: str | None = None) -> dict[tuple[str, str], dict[str, float]]:
        out: dict[tuple[str, str], dict[str, float]] = {}
        for r in self._all("select * from derived where ? is null or source_table = ?", source, source):
            out.setdefault((r["source_table"], r["config_id"]), {})[r["metric"]] = r["value"]
        return out
