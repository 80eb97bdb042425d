"""Structured Streaming: change logs applied to a snapshot store, whole transactions at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LogError
from ..operators import changelog as C
from ..operators import changes as H
from ..sources import wal
from ..sources.store import SnapshotStore

MESSAGES = "seq long, message binary"


def log_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of a log folder's JSON files, at most ``max_files`` to a batch (backpressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def message_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of a folder's binary log: Parquet files of (seq, message), at most ``max_files`` to a batch. Files come in
    the order of their times, so a log has to be written in its order, a file after another."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", max_files).parquet(folder)


class _Applier:
    """foreachBatch sink. A batch adds one delta for each table that it changes, all in one step; what comes after its last
    commit waits for the next batch in the store itself, so no version ever has half a transaction. A batch that was
    applied before is skipped by its id, and a message by its position. A TRUNCATE of a followed table fails the batch
    before anything is written. ``copying``: asks whether a copy is still under way."""

    position = "lsn"

    def __init__(self, store: SnapshotStore, copying: Callable[[], bool] = lambda: False):
        self.store, self.copying = store, copying

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        m = self.store.manifest()
        if batch_id <= m["batch_id"]:
            return
        at, held = self.position, self.store.held()
        log = batch if held is None else held.unionByName(batch, allowMissingColumns=True)
        log = log.where(F.col(at) > m["max_lsn"]).dropDuplicates([at]).persist()  # read several times; as large as a batch
        try:
            last = log.where(self.is_commit()).agg(F.max(at)).first()[0]
            if last is None:
                self.store.hold(log, batch_id)
                return
            deltas, more = self.deltas(log.where(F.col(at) <= last), m)
            self.store.apply(deltas, last, batch_id, self.copying(), log.where(F.col(at) > last), **more)
            self.store.prune()
        finally:
            log.unpersist()

    def is_commit(self) -> Column:
        raise NotImplementedError

    def deltas(self, log: DataFrame, manifest: dict) -> tuple[dict[str, tuple[DataFrame, list[str], list[str]]], dict]:
        """States of each table (see SnapshotStore.apply), and what else the manifest should remember."""
        raise NotImplementedError


class LogApplier(_Applier):
    """Applies a log of one table that is decoded already: key, lsn, op, columns and a commit flag."""

    def __init__(self, store: SnapshotStore, table: str, key: list[str], columns: list[str], commit: str = "is_commit", sent: dict | None = None):
        super().__init__(store)
        self.table, self.key, self.columns, self.commit, self.sent = table, key, columns, commit, sent

    def is_commit(self) -> Column:
        return F.col(self.commit)

    def deltas(self, log, manifest):
        if not log.where("op = 'T'").isEmpty():
            raise LogError(f"TRUNCATE on {self.table} can't be applied")
        changes = log.where(F.col("op").isin("I", "U", "P", "D"))
        states = C.merged(C.states(changes, self.key, self.columns, sent=self.sent), self.key, self.columns)
        return {self.table: (states, self.key, [*self.key, *self.columns])}, {}


class ChangeApplier(_Applier):
    """Applies a binary log (seq, message) to all tables that have a plan, each under its spec. Row messages of other
    tables are skipped. Relations outlive the batch that announced them in the manifest."""

    position = "seq"

    def __init__(self, store: SnapshotStore, plans: list[H.TablePlan], copying: Callable[[], bool] = lambda: False):
        super().__init__(store, copying)
        self.plans = plans

    def is_commit(self) -> Column:
        return F.substring("message", 1, 1) == F.lit(b"C")

    def deltas(self, log, manifest):
        known = [wal.Relation(*r[:4], tuple(r[4])) for r in manifest.get("relations", [])]
        versions = wal.relation_versions(log, known)
        found = versions.collect()  # a row for each definition of a table
        now = [[r.relation, r.namespace, r.name, r.identity, list(r["columns"])] for r in found if r.until is None]
        versions = log.sparkSession.createDataFrame(found, versions.schema)
        self._refuse_truncate(log, found)
        decoded = wal.decode(log, versions=versions)
        deltas = {p.spec.name: (H.change_states(H.table_changes(decoded, p), p), p.target_key, p.target_columns) for p in self.plans}
        return deltas, {"relations": now}

    def _refuse_truncate(self, log: DataFrame, versions: list) -> None:
        followed = {(p.namespace, p.spec.name) for p in self.plans}
        cut = wal.parse(log.where(F.substring("message", 1, 1) == F.lit(b"T"))).select(F.explode("relations").alias("r"), "seq")
        hit = set()
        for r in cut.groupBy("r").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).collect():  # a row for each table
            hit |= {(v.namespace, v.name) for v in versions if v.relation == r.r and v.since <= r.last and (v.until is None or r.first < v.until)}
        if hit & followed:
            raise LogError(f"TRUNCATE on {', '.join(sorted(map('.'.join, hit & followed)))} can't be applied")


def apply_available(stream: DataFrame, applier: _Applier, checkpoint: str, timeout: float | None = None) -> bool:
    """Apply all that the log has now and stop; whether that was done within ``timeout`` seconds."""
    query = stream.writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done = query.awaitTermination(timeout) if timeout else (query.awaitTermination() or True)
    if not done:
        query.stop()
    if (error := query.exception()) is not None:
        raise error
    return bool(done)


def follow(stream: DataFrame, applier: _Applier, checkpoint: str, every: str = "1 second"):
    """Apply the log as it grows, in the background: the query, with ``stop``, ``exception`` and ``processAllAvailable``."""
    return stream.writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
