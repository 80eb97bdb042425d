"""Changes from bytes to rows: spec, routing, key changes, the store's growth, and migrations that follow a log."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from strataport.errors import MigrationError, SetupError
from strataport.operators import changelog as C
from strataport.operators import changes as H
from strataport.operators.commands import Migration
from strataport.operators.copy import copy_table
from strataport.operators.project import apply_spec
from strataport.plans.spec import Config, Endpoint, MigrateSpec, table_spec
from strataport.sources import wal
from strataport.sources.store import Progress, RunLock, SnapshotStore
from strataport.streaming.apply import MESSAGES, ChangeApplier, apply_available, message_stream

SPEC = table_spec({
    "name": "items",
    "columns": {"id": {"type": "bigint", "rename": "item_id"}, "score": {"type": "bigint"}, "note": {"drop": True}, "label": {"rename": "name"}},
    "add_columns": [{"name": "flag", "type": "boolean", "default": "false"}]
})
R = wal.Relation(7, "public", "items", "d", ("id", "label", "score", "note"))
OTHER = wal.Relation(8, "audit", "items", "d", ("id", "label"))
COLUMNS = "id int, label string, score int, note string"


def source(spark, n):
    return spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("row_"), "id").alias("label"), (F.col("id") * 10).cast("int").alias("score"),
        F.lit("x").alias("note")
    )


def t(*values):
    return [("u", None) if v is ... else ("n", None) if v is None else ("t", str(v)) for v in values]


class Log:
    """A log folder, a file for each call."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.seq = spark, str(folder), 0

    def write(self, *messages):
        rows = [(self.seq + i, m) for i, m in enumerate(messages)]
        self.seq += len(rows)
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(self.folder)

    def transaction(self, *messages):
        self.write(wal.begin(self.seq, wal.EPOCH, 1), *messages, wal.commit(self.seq, self.seq, wal.EPOCH))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_under_a_spec(spark):
    log = [
        wal.relation(R), wal.relation(OTHER), wal.insert(7, t(1, "a", 5, "n")), wal.insert(8, t(1, "no")), wal.update(7, t(1, "b", 6, ...)),
        wal.update(7, t(1, "c", ..., None)), wal.update(7, t(2, "d", 7, "n"), t(1, None, None, None)), wal.delete(7, t(9, None, None, None)),
        wal.insert(7, t(3, None, None, None))
    ]
    plan = H.plan_of(SPEC, source(spark, 1), ["id"])
    got = H.table_changes(wal.decode(spark.createDataFrame(list(enumerate(log)), MESSAGES)), plan)
    assert got.columns == ["item_id", "lsn", "op", "name", "score", "flag", "sent_name", "sent_score", "sent_flag"] and dict(got.dtypes)["item_id"] == "bigint"
    found = sorted((r.lsn, r.op, r.item_id, r["name"], r.score, r.sent_score) for r in got.collect())
    assert found == [
        (2, "I", 1, "a", 5, True), (4, "U", 1, "b", 6, True), (5, "P", 1, "c", None, False), (6, "D", 1, None, None, None), (6, "I", 2, "d", 7, True),
        (7, "D", 9, None, None, True), (8, "I", 3, None, None, True)
    ]
    rows = C.living(H.change_states(got, plan), plan.target_key, plan.values)
    assert sorted(map(tuple, rows.collect()), key=str) == [(2, "d", 7, False), (3, None, None, False)]
    lost = [wal.relation(R), wal.update(7, t(2, "d", ..., None), t(1, None, None, None))]
    with pytest.raises(Exception, match="leaves values unsent"):
        H.table_changes(wal.decode(spark.createDataFrame(list(enumerate(lost)), MESSAGES)), plan).collect()
    whole = [wal.relation(R), wal.update(7, t(2, "d", ..., None), t(1, "c", 4, None), "O")]
    assert sorted((r.op, r.item_id, r.score) for r in H.table_changes(
        wal.decode(spark.createDataFrame(list(enumerate(whole)), MESSAGES)), plan
    ).collect()) == [("D", 1, None), ("I", 2, 4)]


def simulate(rows, ops):
    """One change after another, as a database would."""
    rows = dict(rows)
    for kind, k, *x in ops:
        if kind == "I":
            rows[k] = (x[0], x[1], rows[k][2] if k in rows and kind == "U" else False)
        elif kind == "U":
            rows[k] = (x[0], x[1], rows[k][2] if k in rows else False)
        elif kind == "P" and k in rows:
            rows[k] = (x[0], rows[k][1], rows[k][2])
        elif kind == "D":
            rows.pop(k, None)
        elif kind == "M":
            rows.pop(k, None)
            rows[x[0]] = (x[1], x[2], False)
    return sorted((k, *v) for k, v in rows.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_applier_equals_one_by_one(spark, tmp_path, seed):
    rng, log = random.Random(seed), Log(spark, tmp_path / "log")
    src, plan = source(spark, 20), None
    plan = H.plan_of(SPEC, src, ["id"])
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.publish({"items": apply_spec(src, SPEC).withColumn("flag", F.col("item_id") == 3)}, key={"items": ["item_id"]})
    want = {i: (f"row_{i}", i * 10, i == 3) for i in range(1, 21)}
    log.write(wal.relation(R), wal.relation(OTHER))
    done = []
    for _ in range(5):
        for _ in range(3):
            ops = []
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(1, 30)
                ops.append(rng.choice([("I", k, f"i{rng.random()}", k), ("U", k, f"u{rng.random()}", None), ("P", k, f"p{rng.random()}"), ("D", k), ("M", k, 100 + k, "moved", 1)]))
            as_message = {
                "I": lambda k, a, b: wal.insert(7, t(k, a, b, "n")), "U": lambda k, a, b: wal.update(7, t(k, a, b, "n")), "P": lambda k,
                a: wal.update(7, t(k, a, ..., "n")), "D": lambda k: wal.delete(7, t(k, None, None, None)), "M": lambda k, to, a,
                b: wal.update(7, t(to, a, b, "n"), t(k, None, None, None))
            }
            log.transaction(*[as_message[o](*x) for o, *x in ops], wal.insert(8, t(1, "elsewhere")))
            done += ops
        assert apply_available(message_stream(spark, f"file://{tmp_path}/log", 2), ChangeApplier(store, [plan]), f"file://{tmp_path}/cp")
        assert rows_of(store.read("items")) == simulate(want, done)
    assert store.manifest()["max_lsn"] == log.seq - 1
    log.write(wal.begin(log.seq, wal.EPOCH, 1), wal.delete(7, t(5, None, None, None)))
    before = rows_of(store.read("items"))
    run = lambda: apply_available(message_stream(spark, f"file://{tmp_path}/log"), ChangeApplier(store, [plan]), f"file://{tmp_path}/cp")
    assert run() and rows_of(store.read("items")) == before and store.held().count() == 2  # no commit yet
    log.write(wal.commit(1, 1, wal.EPOCH), wal.truncate([8]))
    log.transaction()
    assert run() and rows_of(store.read("items")) == [r for r in before if r[0] != 5]
    log.transaction(wal.truncate([8, 7]))
    with pytest.raises(Exception, match="TRUNCATE on public.items"):
        run()


def test_writes_are_in_proportion_to_the_change(spark, tmp_path):
    plan = H.plan_of(SPEC, source(spark, 1), ["id"])
    store, written = SnapshotStore(spark, f"file://{tmp_path}/store"), []
    write = store._write
    store._write = lambda df, v, name: written.append(write(df, v, name)) or written[-1]
    store.publish({"items": apply_spec(source(spark, 20_000), SPEC)}, key={"items": ["item_id"]})
    written.clear()
    relation = [[*R[:4], list(R.columns)]]
    store.apply({}, -1, relations=relation)
    for i in range(32):
        log = [(10 * i + j, wal.update(7, t(100 * i + j + 1, "new", 1, None))) for j in range(5)] + [(10 * i + 5, wal.commit(i, i, wal.EPOCH))]
        ChangeApplier(store, [plan])(spark.createDataFrame(log, MESSAGES), i)
    assert sum(written) <= 5 * 32 * 6  # each of the 160 changes a logarithmic number of times, and no row of the table
    assert len(store.manifest()["tables"]["items"]["deltas"]) <= 7
    assert store.read("items").where("name = 'new'").count() == 160 and store.read("items").count() == 20_000
    versions = [n for n in store.files.names(f"file://{tmp_path}/store") if n.startswith("v=")]
    assert len(versions) <= 9  # what nothing reads is pruned
    store.fold("items")
    assert store.read("items").where("name = 'new'").count() == 160 and "deltas" not in store.manifest()["tables"]["items"]


def test_copy_and_log_in_any_order(spark, tmp_path):
    """A delete that is applied before its row is copied holds, and so does an update."""
    src = source(spark, 40)
    plan = H.plan_of(SPEC, src, ["id"])
    store, progress = SnapshotStore(spark, f"file://{tmp_path}/store"), Progress(spark, f"file://{tmp_path}/progress")
    store.apply({}, -1, relations=[[*R[:4], list(R.columns)]])
    log = [(1, wal.delete(7, t(30, None, None, None))), (2, wal.update(7, t(31, "late", 1, None))), (3, wal.update(7, t(32, "part", ..., None))), (4, wal.commit(4, 4, wal.EPOCH))]
    seen = []
    assert copy_table(src, SPEC, ["id"], store, progress, 10, stop=lambda: bool(seen), on_batch=seen.append) == "interrupted"
    ChangeApplier(store, [plan], lambda: True)(spark.createDataFrame(log, MESSAGES), 0)
    (tmp_path / "store/pages/items/p=3").mkdir()  # a dead writer's
    assert copy_table(src, SPEC, ["id"], store, progress, 10, on_batch=seen.append) == "completed"
    got = {r[0]: tuple(r)[1:] for r in store.read("items").collect()}
    assert len(got) == 39 and 30 not in got and got[31] == ("late", 1, False) and got[32] == ("part", 320, False) and got[33] == ("row_33", 330, False)
    assert [b["rows"] for b in seen] == [10, 10, 10, 10] and progress.metadata()["phase"] == "copied"


def migration(spark, tmp_path, n=60, log=True):
    config = Config(Endpoint("h", "d", "u"), migrate=MigrateSpec((SPEC,), "s", "p", batch_size=10))
    return Migration(spark, config, {"items": source(spark, n)}, {"items": ["id"]}, f"file://{tmp_path}/root", {"items": ("id", 5)}, f"file://{tmp_path}/log" if log else None)


def test_migrate_follows_the_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log, m = Log(spark, tmp_path / "log"), migration(spark, tmp_path)
    log.write(wal.relation(R))
    log.transaction(wal.delete(7, t(1, None, None, None)))  # before the slot: the source has it already
    log.seq += 10

    def on_batch(b):
        if b["batch_no"] == 1:
            log.write(wal.relation(R))
            log.transaction(wal.delete(7, t(2, None, None, None)), wal.delete(7, t(60, None, None, None)))
            log.transaction(wal.update(7, t(59, "new", 1, None)), wal.insert(7, t(61, "more", 2, None)))

    assert m.slot() is None and m.lag() is None
    assert m.migrate(on_batch=on_batch) == "completed"
    got = {r[0]: tuple(r)[1:] for r in m.store.read("items").collect()}
    assert len(got) == 59 and 1 in got and 2 not in got and 60 not in got and got[59] == ("new", 1, False) and got[61] == ("more", 2, False)
    assert m.lag() == 0 and m.read_lag().orderBy(F.desc("taken_at")).first().readiness == "caught_up"
    with pytest.raises(SetupError, match="slot"):
        m.migrate(force=True)
    log.transaction(wal.delete(7, t(61, None, None, None)))
    assert m.lag() > 0
    report = m.cutover(30).first()
    assert report.lag_drained and not report.passed  # the source frame here doesn't change with its log
    assert m.store.read("items").count() == 58
    assert m.progress.metadata()["sequences"]["items"]["column"] == "item_id"
    m.cleanup()
    assert m.slot() is None and m.store.manifest()["tables"]


def test_migrate_stops_at_a_truncate(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log, m = Log(spark, tmp_path / "log"), migration(spark, tmp_path)
    with pytest.raises(MigrationError, match="TRUNCATE"):
        m.migrate(on_batch=lambda b: log.transaction(wal.relation(R), wal.truncate([7])) if b["batch_no"] == 1 else None)
    with pytest.raises(SetupError, match="slot"):
        m.migrate()
    assert migration(spark, tmp_path / "other", log=False).migrate() == "completed"
    with pytest.raises(SetupError, match="slot"):
        migration(spark, tmp_path / "third", log=False).migrate(resume=True)


def test_a_dead_run_loses_its_lock(spark, tmp_path):
    dead = RunLock(spark, f"file://{tmp_path}", "run", lease=0.3)
    dead.__enter__()
    time.sleep(0.6)
    with pytest.raises(SetupError):  # it renews its lease
        RunLock(spark, f"file://{tmp_path}", "run").__enter__()
    dead.done.set()
    time.sleep(0.7)
    with RunLock(spark, f"file://{tmp_path}", "run"):
        with pytest.raises(SetupError):
            RunLock(spark, f"file://{tmp_path}", "run").__enter__()
        dead.__exit__()  # isn't the holder any more
        assert threading.active_count() and RunLock(spark, f"file://{tmp_path}", "run")._found()
