"""The commands of a migration: analyze, diff, preflight, migrate, status, verify, cutover, readiness, demo, cleanup."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MigrationError, SetupError, SpecError
from ..plans.spec import Config, TableSpec
from ..sources.store import Progress, RunLock, SnapshotStore
from ..streaming.apply import MESSAGES, ChangeApplier, follow, message_stream
from . import catalogs, monitor, reconcile, schema
from .changes import plan_of
from .copy import copy_table
from .paging import key_uniqueness
from .project import spec_checks, validate

PHASES = {None: "not started", "backfill": "copying", "copied": "copied, applying changes", "cutover": "cut over"}


@dataclass
class Migration:
    """A config with the tables that it speaks of: source frames and their keys, the root of the target store, the folder of
    the source's change log and the source's catalog, as far as there are any."""

    spark: SparkSession
    config: Config
    sources: dict[str, DataFrame]
    keys: dict[str, list[str]]
    root: str
    sequences: dict[str, tuple[str, int]] = field(default_factory=dict)
    log: str | None = None
    catalog: catalogs.Catalog | None = None

    def __post_init__(self):
        self.store = SnapshotStore(self.spark, f"{self.root}/store")
        self.progress = Progress(self.spark, f"{self.root}/progress")

    @property
    def tables(self) -> tuple[TableSpec, ...]:
        if self.config.migrate is None:
            raise SpecError("the config has no migrate section")
        return self.config.migrate.tables

    def _spec(self, table: str) -> TableSpec:
        return next((t for t in self.config.migrate.tables if t.name == table), TableSpec(table)) if self.config.migrate else TableSpec(table)

    def analyze(self, table: str | None = None) -> DataFrame:
        """Padding of each table as it is: the one named, else those to analyze, else those to migrate."""
        names = [table] if table else [*self.config.analyze_tables] or [t.name for t in (self.config.migrate.tables if self.config.migrate else ())]
        if not names:
            raise SpecError("no table to analyze")
        frames = [schema.catalog_of(self.sources[n], n) for n in names]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return schema.padding_report(out)

    def diff(self, table: str) -> DataFrame:
        """What the spec makes of a table: against the target where it exists, else against what the spec asks for."""
        source, spec = schema.catalog_of(self.sources[table], table), self._spec(table)
        if table in self.store.manifest()["tables"]:
            return schema.diff_live(source, schema.catalog_of(self.store.read(table), table), spec)
        return schema.diff_synthesized(source, spec)

    # --- slot and lag ---

    def slot(self) -> dict | None:
        """The consumer of the log, as it was set up: its tables and the position where it began."""
        return self.progress.metadata().get(f"slot:{self.config.migrate.slot}")

    def _log_end(self) -> int | None:
        """The last position of the log; null without a log or before its first file."""
        if self.log is None or not self.store.files.names(self.log):
            return None
        return self.spark.read.schema(MESSAGES).parquet(self.log).agg(F.max("seq")).first()[0]

    def set_up(self, resume: bool) -> None:
        """Make the slot, or check that a resumed run has it and for the same tables. A slot that is left from another
        run isn't taken over: what it has applied doesn't go with a new copy."""
        m, found = self.config.migrate, self.slot()
        tables = sorted(t.name for t in m.tables)
        if resume:
            if found is None:
                raise SetupError(f"there is no slot {m.slot} to resume")
            if found["tables"] != tables:
                raise SetupError(f"slot {m.slot} is for {', '.join(found['tables'])}")
            return
        if found is not None:
            raise SetupError(f"slot {m.slot} exists: resume its run, or clean up first")
        end = self._log_end()
        start = -1 if end is None else end
        self.progress.set(**{f"slot:{m.slot}": {"tables": tables, "publication": m.publication, "start": start}})
        self.store.apply({}, start)

    def lag(self) -> int | None:
        """How far the applied position is behind the log's end; null without a log or a slot, 0 for an empty log."""
        if self.log is None or self.config.migrate is None or self.slot() is None:
            return None
        end = self._log_end()
        return 0 if end is None else max(end - self.store.manifest()["max_lsn"], 0)

    def read_lag(self) -> DataFrame:
        """Take a reading, and return all of them with trend, time left and readiness."""
        found, now = self.progress.metadata().get("lag", []), self.lag()
        if now is not None:
            found = [*found, [time.time(), now]][-100:]
            self.progress.set(lag=found)
        readings = self.spark.createDataFrame([tuple(x) for x in found], "taken_at double, bytes long")
        return monitor.lag_trend(readings).withColumn("readiness", monitor.readiness(F.col("bytes"), self.config.migrate.lag_threshold_bytes))

    def applier(self, copying: Callable[[], bool] = lambda: False) -> ChangeApplier:
        return ChangeApplier(self.store, [plan_of(t, self.sources[t.name], self.keys[t.name]) for t in self.tables], copying)

    def follow(self, copying: Callable[[], bool] = lambda: False):
        """Apply the log as it grows, in the background."""
        return follow(message_stream(self.spark, self.log), self.applier(copying), f"{self.root}/stream")

    # --- commands ---

    def preflight(self, force: bool = False, resume: bool = False) -> DataFrame:
        """Every check of the setting and of every table; casts are counted in one pass over each."""
        facts, here = [], self.store.manifest()["tables"]
        identity, rows = {}, {}
        if self.catalog is not None:
            identity = {r.table_name: r.identity for r in catalogs.replica_identities(self.catalog).collect()}  # a row for each table
            rows = {r.table_name: r.estimated_rows for r in catalogs.estimates(self.catalog).collect()}
        for spec in self.tables:
            df, key = self.sources.get(spec.name), self.keys.get(spec.name)
            if df is None:
                facts.append({"spec": spec, "exists": False, "columns": {}})
                continue
            uniqueness = key_uniqueness(df, key, spec.name).first() if key else None
            kinds = {r.name: r.type_name for r in schema.catalog_of(df, spec.name).collect()}  # a row for each column
            checks = spec_checks(df, spec)
            failing = {r.check_name: r.failing for r in validate(df, checks).collect()} if checks else {}
            facts.append({
                "spec": spec, "columns": kinds, "key": key if uniqueness and uniqueness.is_unique else [], "target_exists": spec.name in here and not resume, "force": force, "failing": failing,
                "identity": identity.get(spec.name) or "d", "rows": uniqueness.row_count if uniqueness else rows.get(spec.name),
            })
        m = self.config.migrate
        setting = {
            "slot": m.slot, "slot_exists": self.slot() is not None, "resume": resume, "log": self.log,
            "log_readable": self.log is not None and self.store.files.exists(self.log), "batch_size": m.batch_size,
            "rows_per_second": m.max_rows_per_second
        }
        return reconcile.preflight(self.spark, facts, setting)

    def migrate(self, resume: bool = False, force: bool = False, stop=lambda: False, on_batch=lambda _: None, keep_on: bool = False) -> str:
        """Preflight, set up, follow the log from before the copy on, copy every table: completed or interrupted. One runner
        at a time. After the copy what the log has is applied; with ``keep_on`` it is followed until ``stop``."""
        m = self.config.migrate
        with RunLock(self.spark, self.root, m.slot):
            items = self.preflight(force, resume)
            failed = items.where("status = 'fail'").select("table_name", "label", "detail").collect()
            if failed:
                raise SetupError("; ".join(f"{r.table_name}: {r.label} {r.detail}" for r in failed))
            self.set_up(resume)
            if force and not resume:
                for t in self.tables:
                    self.store.forget(t.name)
            copying = [True]
            query = self.follow(lambda: copying[0]) if self.log is not None else None
            try:
                for spec in self.tables:
                    if copy_table(
                        self.sources[spec.name], spec, self.keys[spec.name], self.store, self.progress, m.batch_size, m.max_rows_per_second,
                        lambda: stop() or self._failed(query), on_batch, unique=True
                    ) == "interrupted":
                        self._raise(query)
                        return "interrupted"
                copying[0] = False
                while query is not None:
                    try:
                        query.processAllAvailable()
                    except StreamingQueryException:
                        self._raise(query)
                        raise
                    if not keep_on or stop():
                        break
                    time.sleep(0.5)
            finally:
                if query is not None:
                    query.stop()
            self._raise(query)
        return "completed"

    @staticmethod
    def _failed(query) -> bool:
        return query is not None and query.exception() is not None

    @classmethod
    def _raise(cls, query) -> None:
        if cls._failed(query):
            raise MigrationError(f"applying the log failed: {query.exception()}")

    def status(self) -> tuple[str, DataFrame]:
        """The phase and statistics of the pages of each table; works without the source."""
        return PHASES.get(self.progress.metadata().get("phase"), "unknown"), monitor.batch_stats(self.progress.batches())

    def readiness(self, target: catalogs.Catalog) -> DataFrame:
        """What the target lacks of each table's secondary objects."""
        if self.catalog is None:
            raise SetupError("readiness needs the source's catalog")
        both = catalogs.secondary_objects(self.catalog, "source").unionByName(catalogs.secondary_objects(target, "target"))
        out = None
        for t in self.tables:
            some = reconcile.readiness(both.where(F.col("table_name") == t.name), t)
            out = some if out is None else out.unionByName(some)
        return out

    def verify(self, sample_size: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Counts of each table, and mismatching fields of a sample of those whose counts are equal and not zero. A given
        sample size goes before the config's."""
        n = sample_size or self.config.sample_size
        counts = reconcile.row_counts({t.name: (self.sources[t.name], self.store.read(t.name)) for t in self.tables})
        equal = {r.table_name: r.source_count for r in counts.collect() if r.equal and r.source_count}
        found = None
        for t in self.tables:
            if t.name in equal and self.keys.get(t.name):
                source, key = self.sources[t.name], self.keys[t.name]
                below = round(reconcile.sample_fraction(equal[t.name], n) * 1_000_000)
                sample = reconcile.hashed_sample(source, key, 1_000_000, below) if below < 1_000_000 else source
                some = reconcile.mismatches(sample, self.store.read(t.name), t, key).select(
                    F.lit(t.name).alias("table_name"),
                    F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in t.target_key(key)]).alias("key"), "column_name",
                    "kind"
                )
                found = some if found is None else found.unionByName(some)
        return counts, found

    def drain(self, timeout: float | None = None) -> bool:
        """Apply what the log has, for at most so long (the config's lag_drain_timeout); whether it came to the end."""
        if self.log is None or self.slot() is None:
            return False
        query = self.follow()
        until = time.time() + (self.config.lag_drain_timeout if timeout is None else timeout)
        try:
            while self.lag() and time.time() < until:
                self._raise(query)
                time.sleep(0.2)
        finally:
            query.stop()
        self._raise(query)
        return not self.lag()

    def owned(self) -> dict[str, tuple[str, int]]:
        """Each table's sequence: the column that owns it and the last value used."""
        found = dict(self.sequences)
        if self.catalog is not None:
            names = {t.name for t in self.tables}
            found |= {r.table_name: (r.column_name, r.last_value) for r in catalogs.owned_sequences(self.catalog).collect() if r.table_name in names}
        return found

    def cutover(self, timeout: float | None = None) -> DataFrame:
        """Drain the log, set the sequences, compare the counts; passed is about counts, lag_drained about the log (null
        where there is none to look at). Sequences belong to the renamed columns."""
        drained = self.drain(timeout) if self.lag() is not None else None
        counts, _ = self.verify()
        owned = self.owned()
        plan = reconcile.sequence_plan({t: (self.sources[t], c, last) for t, (c, last) in owned.items()}, self.config.sequence_buffer) if owned else None
        if plan is not None:
            self.progress.set(sequences={r.table_name: {
                "column": self._spec(r.table_name).target_name(r.column_name), "value": r.target_value
            } for r in plan.collect()})  # a row for each table
        self.progress.set(phase="cutover")
        if plan is None:
            plan = self.spark.createDataFrame([], "table_name string, target_value long")
        return reconcile.cutover_report(counts, plan, None if drained is None else int(not drained))

    def cleanup(self, drop_target: bool = False, confirmed: str = "") -> None:
        """Forget the slot, the stream and the progress; the target goes too only if its root is typed as confirmation."""
        if drop_target and confirmed != self.root:
            raise SetupError("type the target's root to confirm")
        for path in (self.progress.root, f"{self.root}/stream", *([f"{self.root}/{self.config.migrate.slot}.lock"] if self.config.migrate else [])):
            self.progress.files.delete(path)
        if drop_target:
            self.store.drop()
