"""Operators that aren't queries: copy and resume, change-log convergence, codec, store, streaming, commands."""

import random

import pytest
from pyspark.sql import functions as F

from strataport.errors import LogError, SetupError, SpecError, TableNotFound
from strataport.functions import text as X
from strataport.operators import changelog as C
from strataport.operators import monitor, paging
from strataport.operators.commands import Migration
from strataport.operators.copy import copy_table
from strataport.operators.project import apply_spec, validate
from strataport.plans.spec import Config, Endpoint, MigrateSpec, table_spec
from strataport.sources import wal
from strataport.sources.store import Progress, RunLock, SnapshotStore
from strataport.streaming.apply import LogApplier, apply_available, log_stream

ITEMS = table_spec({"name": "items", "columns": {"id": {"type": "bigint"}, "label": {"rename": "name"}, "score": {"type": "bigint"}}})


def items(spark, n):
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("row_"), "id").alias("label"), (F.col("id") * 10).cast("int").alias("score"))


def test_copy_resumes_and_never_overwrites(spark, tmp_path):
    store, progress = SnapshotStore(spark, f"file://{tmp_path}/s"), Progress(spark, f"file://{tmp_path}/p")
    source = items(spark, 250)
    store.publish({"items": apply_spec(source.where("id = 7"), ITEMS).withColumn("name", F.lit("applied"))})
    seen = []
    assert copy_table(source, ITEMS, ["id"], store, progress, 100, stop=lambda: len(seen) == 1, on_batch=seen.append) == "interrupted"
    assert progress.last("items") == (1, [100])
    assert copy_table(source, ITEMS, ["id"], store, progress, 100, on_batch=seen.append) == "completed"
    assert [b["rows"] for b in seen] == [100, 100, 50]
    out = store.read("items")
    assert out.count() == 250 and out.where("id = 7").first().name == "applied" and dict(out.dtypes)["score"] == "bigint"
    assert "pages" not in store.manifest()["tables"]["items"]  # pages beside older rows are folded
    stats = monitor.batch_stats(progress.batches()).first()
    assert (stats.batch_count, stats.total_rows) == (3, 250)
    store.prune()
    assert store.read("items").count() == 250


def test_store_and_lock(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    with pytest.raises(TableNotFound):
        store.read("t")
    store.create("t", items(spark, 2))
    with pytest.raises(SetupError):
        store.create("t", items(spark, 2))
    with RunLock(spark, f"file://{tmp_path}", "run"):
        with pytest.raises(SetupError):
            RunLock(spark, f"file://{tmp_path}", "run").__enter__()
    with RunLock(spark, f"file://{tmp_path}", "run"):
        pass


def test_projection_refuses_what_it_cannot_do(spark):
    df = items(spark, 1)
    with pytest.raises(SpecError):
        apply_spec(df, table_spec({"name": "items", "columns": {"nope": {"drop": True}}}))
    with pytest.raises(SpecError):
        apply_spec(df, table_spec({"name": "items", "columns": {"label": {"type": "jsonb"}}}))
    rows = spark.createDataFrame([(1,), (3_000_000_000,), (None,)], "id long")
    assert [tuple(r) for r in validate(rows, [("id", F.col("id"), "int8", "integer")]).collect()] == [("id", "validated", 1, False)]


def simulate(log):
    rows = {}
    for key, _, op, value, props in log:
        if op in "IU":
            rows[key] = [value, props]
        elif op == "P" and key in rows:
            rows[key][0] = value
        elif op == "D":
            rows.pop(key, None)
    return sorted((k, *v) for k, v in rows.items())


@pytest.mark.parametrize("seed", range(3))
def test_compaction_equals_one_by_one_whatever_the_batches(spark, seed):
    rng = random.Random(seed)
    log = [(rng.randrange(8), i, rng.choice("IUPPD"), rng.choice([None, 1, 2]), rng.choice([None, "a", "b"])) for i in range(120)]
    df = spark.createDataFrame(log, "k long, lsn long, op string, value long, props string").repartition(4)
    sent = {"value": F.lit(True), "props": F.lit(False)}
    state = None
    for lo, hi in ((0, 30), (30, 31), (31, 120)):
        state = C.compact(df.where(f"lsn >= {lo} and lsn < {hi}"), ["k"], ["value", "props"], sent=sent, base=state)
    got = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    assert got(state) == sorted(simulate(log), key=str) == got(C.compact(df, ["k"], ["value", "props"], sent=sent))


def test_truncate_and_key_changes(spark):
    log = spark.createDataFrame([("T", "a")], "kind string, tables string")
    with pytest.raises(Exception, match="TRUNCATE"):
        C.reject_truncate(log).collect()
    moved = spark.createDataFrame([(2, 5, "U", 1), (3, 6, "U", None)], "k long, lsn long, op string, old long")
    assert sorted((r.k, r.op) for r in C.split_key_changes(moved, "k", "old").collect()) == [(1, "D"), (2, "U"), (3, "U")]


def test_codec_round_trip():
    d = wal.Decoder()
    r = wal.Relation(9, "public", "items", "d", ("id", "label"))
    assert d.decode(wal.relation(r))["columns"] == ["id", "label"]
    assert d.decode(wal.begin(0x1_3FA2C100, wal.EPOCH + 5, 77)) == {"kind": "B", "lsn": 0x1_3FA2C100, "at_us": wal.EPOCH + 5, "xid": 77}
    assert d.decode(wal.commit(1, 2, wal.EPOCH))["end_lsn"] == 2
    row = [("t", "1"), ("t", "é\t\n\\")]
    assert d.decode(wal.insert(9, row))["new"][1] == {"state": "t", "text": "é\t\n\\"}
    u = d.decode(wal.update(9, [("t", "1"), ("u", None)], [("t", "0"), ("n", None)]))
    assert u["old_kind"] == "K" and [c["state"] for c in u["new"]] == ["t", "u"] and u["old"][1]["state"] == "n"
    assert d.decode(wal.delete(9, row, "O"))["old_kind"] == "O"
    assert d.decode(wal.truncate([9, 8]))["relations"] == [9, 8]
    assert d.decode(wal.insert(9, [*row, ("t", "x")]))["columns"] == ["id", "label", "col_2"]
    for bad in (b"", b"Z", b"I\0\0\0\1N\0\0", wal.insert(9, row)[:-1], b"I\0\0\0\x09X"):
        with pytest.raises(LogError):
            d.decode(bad)
    assert wal.unframe(b"w" + bytes(7) + b"\5" + bytes(16) + b"BODY") == ("w", 5, b"BODY")
    assert wal.unframe(b"k" + bytes(16) + b"\1")[2] == b"\1"
    with pytest.raises(LogError):
        wal.unframe(b"x")


def test_stream_applies_whole_transactions(spark, tmp_path):
    schema = "k long, lsn long, op string, value long, is_commit boolean"
    log = tmp_path / "log"
    root = f"file://{tmp_path}"
    store = SnapshotStore(spark, f"{root}/store")
    run = lambda: apply_available(log_stream(spark, str(log), schema, 1), LogApplier(store, "t", ["k"], ["value"]), f"{root}/cp")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(log))
    write([(1, 1, "I", 10, False), (2, 2, "I", 20, True), (1, 3, "U", 11, False)])
    assert run()
    assert sorted(map(tuple, store.read("t").collect())) == [(1, 10), (2, 20)]  # the third has no commit yet
    write([(2, 4, "D", None, True)])
    assert run()
    assert [tuple(r) for r in store.read("t").collect()] == [(1, 11)] and store.manifest()["max_lsn"] == 4
    LogApplier(store, "t", ["k"], ["value"])(spark.createDataFrame([(9, 2, "I", 1, True)], schema), 0)
    assert [tuple(r) for r in store.read("t").collect()] == [(1, 11)]  # a replay
    write([(0, 5, "T", None, True)])
    with pytest.raises(Exception, match="TRUNCATE"):
        run()


def test_texts(spark):
    row = spark.range(1).select(
        X.lsn_text(F.lit(0x1_3FA2C100)).alias("a"), X.lsn_number(F.lit("1/3FA2C100")).alias("b"), X.lsn_number(F.lit("zz")).alias("c"), X.bytes_text(F.lit(1536)).alias("d"), X.bytes_text(F.lit(12)).alias("e"),
        X.duration_text(F.lit(61)).alias("f"), X.display_type(F.lit("timestamp without time zone")).alias("g"), X.display_type(F.lit("character(2)")).alias("h"), X.shortened(F.lit("y" * 50)).alias("i"), X.quote_table(F.lit("select")).alias("j"),
    ).first()
    assert tuple(row) == ("1/3FA2C100", 0x1_3FA2C100, None, "1.5 KB", "12 B", "2m", "timestamp", "char(2)", "y" * 37 + "...", 'public."select"')


def test_report_texts(spark):
    row = spark.range(1).select(
        X.count_text(F.lit(1234567)), X.scale_text(F.lit(1_600_000)), X.scale_text(F.lit(3 << 30)), X.redacted(F.lit(None).cast("string")),
        X.redacted(F.lit("z" * 61)), X.listed(F.lit("a,b")), X.listed(F.lit(""))
    ).first()
    assert list(row) == ["1,234,567", "1.5 MB", "3.0 GB", "NULL", "z" * 57 + "...", ["a", "b"], []]


def test_numbering_and_throttle(spark):
    df = spark.createDataFrame([(i * 13 % 101,) for i in range(101)], "k long").repartition(5)
    assert all(r.rn == r.k + 1 for r in paging.numbered(df, ["k"]).collect())
    assert spark.range(1).select(paging.throttle_delay(F.lit(1000), F.lit(500), 1000)).first()[0] == 0.5


def test_commands(spark, tmp_path):
    config = Config(Endpoint("h", "d", "u"), migrate=MigrateSpec((ITEMS,), "s", "p", batch_size=100))
    m = Migration(spark, config, {"items": items(spark, 250)}, {"items": ["id"]}, f"file://{tmp_path}", {"items": ("id", 5)})
    assert m.status()[0] == "not started" and m.analyze().count() == 1
    assert {r.status for r in m.diff("items").collect()} == {"type_changed", "renamed"}
    assert m.migrate() == "completed" and m.status()[0] == "copied, applying changes"
    with pytest.raises(SetupError):
        m.migrate()  # the target exists
    counts, found = m.verify()
    assert counts.first().equal and found.count() == 0
    m.store.publish({"items": m.store.read("items").withColumn("name", F.when(F.col("id") == 2, "x").otherwise(F.col("name")))})
    assert [tuple(r) for r in m.verify()[1].collect()] == [("items", "id=2", "name", "differs")]
    r = m.cutover().first()
    assert (r.target_value, r.passed, r.lag_drained) == (1250, True, None)  # there is no log
    assert m.progress.metadata()["sequences"] == {"items": {"column": "id", "value": 1250}}
    with pytest.raises(SetupError):
        m.cleanup(True, "no")
    m.cleanup(True, f"file://{tmp_path}")
    assert not m.store.manifest()["tables"]
