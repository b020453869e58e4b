"""Cycles: plan, drain and publish every runnable materialization; and the library's calls in one place."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators import changes
from vecloom.operators.content_map import chunk_history, live_entries
from vecloom.operators.derive import Counters, Deriver
from vecloom.operators.ivf import ClusterIndex
from vecloom.operators.maintenance import full_pass
from vecloom.operators.projection import Publisher, distinct_vectors
from vecloom.operators.search import top_k
from vecloom.plans.control import LEASE_S, Control
from vecloom.plans.spec import Spec
from vecloom.plans.sqlview import similarity_view
from vecloom.sources.catalog import Catalog
from vecloom.sources.embedders import Embedder, embedder_for
from vecloom.sources.versioned import SnapshotGone


class Engine:
    """Everything over one catalog: control, derivation, publishing, index, search and maintenance."""

    def __init__(self, catalog: Catalog, embedders: Embedder | Mapping[str, Embedder], control: Control | None = None, owner: str = "engine", reconcile: bool = True, unit_bytes: int = changes.UNIT_BYTES, lease_s: int = LEASE_S) -> None:
        """embedders: one, or one by model name. unit_bytes: of the data files that one leased unit of work derives."""
        self.catalog, self.embedders, self.spark = catalog, embedders, catalog.spark
        self.control, self.owner, self.reconcile_enabled = control or Control(catalog), owner, reconcile
        self.unit_bytes, self.lease_s = unit_bytes, lease_s
        self.deriver, self.publisher, self.index = Deriver(catalog, embedders), Publisher(catalog), ClusterIndex(catalog)

    # -- one materialization

    def run_one(self, id_: str) -> dict[str, object]:
        """Bring a materialization to the version that its source has now; that version is pinned before planning."""
        m, spec = self.control.get(id_), self.control.spec(id_)
        source = self.catalog.table(spec.source_table)
        target = source.version()[1]
        total, mode = Counters(), "current"
        try:
            if not m["watermark"]:
                mode = "backfill"
                if m["state"] != "BACKFILLING":
                    self.control.backfilling(id_)
                anchor = m["anchor_seq"]
                total += self._drain(id_, spec, changes.backfill_work(source, anchor, unit_bytes=self.unit_bytes), "BACKFILL")
                start = anchor
            else:
                start = m["watermark"]
            if start < target:
                found = changes.assess(source, start, target)
                if found.verdict == changes.REANCHOR:
                    raise SnapshotGone(found.reason)
                if found.verdict == changes.SAFE:
                    mode = "incremental" if mode == "current" else mode
                    total += self._drain(id_, spec, changes.incremental_work(source, start, target, self.unit_bytes), "INCREMENTAL")
                elif self.reconcile_enabled:
                    mode = "reconcile"
                    total += self.reconcile(id_, spec, target, found.affected)
                else:
                    raise RuntimeError(f"{found.reason}, and reconciliation is off")
            elif mode == "current" and self.publisher.is_current(spec):
                return {"id": id_, "mode": mode, "counters": total, "watermark": m["watermark"]}
            summary = self.publisher.build(spec)
            self.control.live(id_, target)
        except Exception as e:
            self.control.degraded(id_, f"{type(e).__name__}: {e}"[:1000])
            raise
        return {"id": id_, "mode": mode, "counters": total, "watermark": target, "published": summary}

    def _drain(self, id_: str, spec: Spec, work: list[changes.Work], kind: str) -> Counters:
        """Queue units of work, lease them, derive and record them."""
        source, total = self.catalog.table(spec.source_table), Counters()
        by_key = {(w.name, w.snapshot_id): w for w in work}
        self.control.enqueue(id_, [(name, w.snapshot_id, w.seq, w.rows) for (name, _), w in by_key.items()], kind)
        self.control.reclaim()
        while leased := self.control.lease(self.owner, 1, self.lease_s, id_):
            item = leased[0]
            unit = by_key.get((item["path"], item["snapshot_id"]))
            if unit is None:  # left by an earlier plan, and covered by this one
                self.control.complete(item["dedup"], self.owner)
                continue
            try:
                with self.control.holding(item["dedup"], self.owner, self.lease_s):
                    got = self.deriver.derive(changes.read_work(source, [unit], spec.needed), spec, item["dedup"])
            except Exception as e:
                self.control.fail(item["dedup"], self.owner, str(e)[:500])
                raise
            self.control.complete(item["dedup"], self.owner)
            self.control.record(spec.source_table, spec.config_id, {k: v for k, v in asdict(got).items()})
            total += got
        if left := self.control.open_units(id_, [name for name, _ in by_key]):
            raise RuntimeError(f"{left} units of work are with another owner, or have failed")
        return total

    def reconcile(self, id_: str, spec: Spec, target: int, partitions: list[dict[str, str | None]]) -> Counters:
        """Re-derive what destructive commits touched, then give tombstones to rows that the source has no more."""
        source = self.catalog.table(spec.source_table)
        keys = changes.present_keys(source, spec, target)
        changes.check_sweep(keys)
        total = Counters()
        for w in changes.backfill_work(source, target, partitions, self.unit_bytes):
            got = self.deriver.derive(changes.read_work(source, [w], spec.needed), spec, f"reconcile-{id_}-{w.snapshot_id}-{w.name}")
            total += got
        commit = next(c for c in source.commits() if c.seq == target)
        live = live_entries(self.deriver.history(spec))
        gone = changes.vanished(live, keys).withColumns({"__seq": F.lit(commit.seq).cast("long"), "__snapshot_id": F.lit(commit.snapshot_id).cast("long"), "__committed_at": F.lit(commit.ts_ms).cast("long")})
        return replace(total, tombstones=total.tombstones + self.deriver.delete(gone, spec))

    def cycle(self, parallelism: int = 1) -> list[dict[str, object]]:
        """Run all that can run. Those of one configuration follow one another (they share content); failures stay their own."""
        groups: dict[str, list[str]] = defaultdict(list)
        for m in self.control.runnable():
            groups[m["config_id"]].append(m["id"])

        def run(ids: Sequence[str]) -> list[dict[str, object]]:
            out = []
            for i in ids:
                try:
                    out.append(self.run_one(i))
                except Exception as e:
                    out.append({"id": i, "error": f"{type(e).__name__}: {e}"})
            return out

        if parallelism <= 1:
            return [r for ids in groups.values() for r in run(ids)]
        with ThreadPoolExecutor(parallelism) as pool:
            return [r for part in pool.map(run, groups.values()) for r in part]

    # -- reading

    def search(self, spec: Spec, text: str, k: int = 10) -> DataFrame:
        """Exact top k over the serving table, for a text."""
        return top_k(self.publisher.read(spec), self.embed_query(spec, text), k).select("source_row_id", "chunk_ordinal", "content_hash", "similarity", "text")

    def probe(self, spec: Spec, text: str, k: int = 10, probes: int = 8, require_fresh: bool = False, include_exact: bool = False) -> dict[str, object]:
        return self.index.search(spec, self.embed_query(spec, text), k, probes, require_fresh, include_exact)

    def embed_query(self, spec: Spec, text: str) -> list[float]:
        """The vector of a query, by the model that the scope's contents went through."""
        return embedder_for(self.embedders, spec).embed_query(text)

    def view(self, spec: Spec, name: str, engine: str = "spark") -> str:
        """DDL of a similarity view over the published table, whose width is looked up in its last build."""
        if engine not in ("spark", "trino"):
            raise ValueError(f"unknown engine: {engine!r}; known are spark, trino")
        built = self.publisher.current(spec)
        if built is None or not int(built["embedding-dim"]):
            raise LookupError(f"nothing is published for {spec.source_table} under {spec.config_id}: its width is not known")
        return similarity_view(name, self.publisher.name(spec), int(built["embedding-dim"]), engine)

    def provenance(self, spec: Spec, row: str, ordinal: int = 0) -> dict[str, object]:
        """The history of a chunk, the assertion that counts, and its vector."""
        history = chunk_history(self.deriver.history(spec), spec.source_table, row, ordinal, spec.config_id)
        rows = history.collect()  # the history of one chunk
        winner = rows[-1] if rows else None
        vector = None
        if winner is not None and not winner["deleted"]:
            store = self.deriver.store.read(partition={"model_version": spec.model_version}).filter(F.col("content_hash") == winner["content_hash"])
            vector = distinct_vectors(store, spec).first()
        note = "never derived" if winner is None else "deleted" if winner["deleted"] else "vector missing" if vector is None else "resolved"
        return {"history": rows, "winner": winner, "vector": vector, "note": note}

    def maintain(self, names: Sequence[str], compacting: bool = True, force: bool = False) -> list[dict[str, object]]:
        """A full pass over tables, one after the other; a failure is reported and the rest go on."""
        out = []
        for n in names:
            try:
                out.append(full_pass(self.catalog.table(n), compacting=compacting, force=force))
            except Exception as e:
                out.append({"table": n, "error": f"{type(e).__name__}: {e}"})
        return out
