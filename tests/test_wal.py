"""The vectorised decoder against the one that reads a message at a time."""

import random

import pytest
from pyspark.sql import functions as F

from strataport.errors import LogError
from strataport.sources import wal

R = [wal.Relation(7, "public", "items", "d", ("id", "label")), wal.Relation(7, "public", "items", "d", ("id", "label", "score")), wal.Relation(9, "audit", "items", "f", ("k",))]


def messages(n, seed=3):
    rng = random.Random(seed)
    cells = lambda k: [rng.choice([("n", None), ("u", None), ("t", ""), ("t", "é\t\n\\" * rng.randrange(4)), ("t", str(rng.random()))]) for _ in range(k)]
    out = [wal.relation(R[0]), wal.relation(R[2])]
    while len(out) < n:
        k = rng.choice([2, 2, 3])
        if len(out) == n // 2:
            out.append(wal.relation(R[1]))
        out.append(rng.choice([
            lambda: wal.begin(
                rng.getrandbits(60), wal.EPOCH + rng.randrange(10**9), rng.getrandbits(32)
            ), lambda: wal.commit(len(out), len(out) + 1, wal.EPOCH - 5), lambda: wal.insert(7, cells(k)),
            lambda: wal.update(7, cells(2), cells(2), rng.choice("KO")), lambda: wal.update(7, cells(k)), lambda: wal.delete(9, cells(1), "O"), lambda: wal.truncate([7, 9]), lambda: wal.relation(R[2]),
            lambda: b"O" + (5).to_bytes(8, "big") + b"other\0", lambda: b"Y" + (4).to_bytes(4, "big") + b"public\0mood\0", lambda: b"M\0" + (6).to_bytes(8, "big") + b"note\0" + (2).to_bytes(4, "big") + b"hi",
        ])())
    return out


def test_equals_one_by_one(spark):
    log = messages(700)
    d, want = wal.Decoder(), []
    for i, m in enumerate(log):
        want.append({"seq": i} | d.decode(m))
    df = spark.createDataFrame(list(enumerate(log)), "seq long, message binary").repartition(5)  # row messages far from their relation
    got = sorted(wal.decode(df).collect(), key=lambda r: r.seq)
    cells = lambda x: None if x is None else [dict(state=c.state, text=c.text) for c in x]
    for r, w in zip(got, want):
        r = r.asDict() | {"old": cells(r.old), "new": cells(r.new), "content": None if r.content is None else bytes(r.content)}
        assert {k: v for k, v in r.items() if v is not None} == {k: v for k, v in w.items() if v is not None}, w
    assert len(got) == len(want)
    assert wal.decode(df.limit(0)).count() == 0
    versions = wal.relation_versions(df).collect()
    assert sorted((v.relation, len(v.columns), v.until is None) for v in versions) == [(7, 2, False), (7, 3, True), (9, 1, True)]


def test_faults(spark):
    row = wal.insert(7, [("t", "1"), ("t", "x")])
    for bad in (b"", b"Z", row[:-1], b"I\0\0\0\x07X", b"I\0\0\0\x07N\0\1z", wal.update(7, [("n", None)], [("n", None)])[:9], b"B\0", row):
        log = [(0, bad)] if bad is row else [(0, wal.relation(R[0])), (1, bad)]
        with pytest.raises(Exception, match="LogError|comes before"):
            wal.decode(spark.createDataFrame(log, "seq long, message binary")).collect()
    bad_text = wal.insert(7, [("t", "1"), ("t", "x")]).replace(b"x", b"\xff")
    got = wal.decode(spark.createDataFrame([(1, bad_text)], "seq long, message binary"), [R[0]]).first()
    assert got.new[1].text == "�" and got.columns == ["id", "label"] and got.name == "items"


def test_columns_encode_like_functions(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "é", "")], "seq long, a string, b string")
    new = wal.tuple_of(wal.cell(F.col("a")), wal.cell(F.col("b"), F.col("seq") == 2))
    got = df.select(
        wal.insert_of(7, new).alias("i"), wal.update_of(7, new, wal.tuple_of(wal.cell(F.col("a"))), "O").alias("u"),
        wal.delete_of(F.lit(7), new).alias("d"), wal.begin_of(F.col("seq"), F.lit(5), F.lit(3)).alias("b"),
        wal.commit_of(F.col("seq"), F.lit(9), F.lit(-1)).alias("c")
    ).collect()
    for r, a, b, n in zip(got, "aé", (("n", None), ("u", None)), (1, 2)):
        row = [("t", a), b]
        assert [bytes(x) for x in r] == [wal.insert(7, row), wal.update(7, row, [("t", a)], "O"), wal.delete(7, row), wal.begin(n, 5, 3), wal.commit(n, 9, -1)]


def test_frames(spark, tmp_path):
    log = messages(60)
    keep = (18).to_bytes(4, "big") + b"k" + bytes(17)
    (tmp_path / "log-0002.bin").write_bytes(b"".join(map(wal.frame, log[30:])))
    (tmp_path / "log-0001.bin").write_bytes(keep + b"".join(map(wal.frame, log[:30])) + keep)
    got = wal.read_frames(spark.read.format("binaryFile").load(f"file://{tmp_path}")).orderBy("seq").collect()
    assert [bytes(r.message) for r in got] == log and got[30].seq == 2 << 32
    (tmp_path / "log-0003.bin").write_bytes(wal.frame(log[0])[:-1])
    with pytest.raises(Exception, match="within a frame"):
        wal.read_frames(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()
    with pytest.raises(LogError):
        wal.unframe(b"x")
