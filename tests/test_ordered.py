"""Running values against one pass over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from strataport.operators.changelog import transactions
from strataport.operators.ordered import ranged, running
from strataport.operators.paging import numbered


def brute(rows, key, by):
    out, state = {}, {}
    order = sorted(rows, key=lambda r: [r[k] for k in key])
    for r in order:
        s = state.setdefault(r[by] if by else 0, {"sum": 0, "last": None, "max": None})
        s["last"] = r["v"] if r["v"] is not None else s["last"]
        s["max"] = max(x for x in (s["max"], r["v"]) if x is not None) if (s["max"], r["v"]) != (None, None) else None
        out[r["n"]] = [s["sum"], s["last"], s["max"]]
        s["sum"] += 1
    ahead = {}
    for r in reversed(order):
        g = r[by] if by else 0
        ahead[g] = r["v"] if r["v"] is not None else ahead.get(g)
        out[r["n"]].append(ahead[g])
    return {n: tuple(x) for n, x in out.items()}


@pytest.mark.parametrize(("key", "by"), [(["n"], None), (["n"], "g"), (["s"], "g"), (["a", "s"], None)])
def test_running_values(spark, key, by):
    rng = random.Random(5)
    rows = [{
        "n": i, "s": f"k{i * 7919 % 500:04d}", "a": 0 if i < 300 else i % 3, "g": rng.choice(["hot", "hot", "hot", "cold", None]),
        "v": rng.choice([None, None, rng.randrange(50)])
    } for i in range(500)]
    df = spark.createDataFrame(rows, "n long, s string, a long, g string, v long").repartition(5)
    got = running(df, key, by, parts=7, before=("sum", F.lit(1)), last=("last", F.col("v")), top=("max", F.col("v")), coming=("next", F.col("v")))
    assert {r.n: (r.before, r.last, r.top, r.coming) for r in got.collect()} == brute(rows, key, by)
    assert got.columns == ["n", "s", "a", "g", "v", "before", "last", "top", "coming"]
    assert ranged(df, key, parts=7).select("_range").distinct().count() == 7


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "n long, c boolean")
    assert transactions(df, F.col("c"), "n").count() == 0 and numbered(df, ["n"]).count() == 0
    one = spark.createDataFrame([(5, True), (6, False)], "n long, c boolean")
    assert [tuple(r) for r in transactions(one, F.col("c"), "n").collect()] == [(5, True, 0, 5)]


def test_one_shuffle_of_the_rows(spark):
    plan = transactions(spark.range(1000).withColumn("pad", F.lit("x")), F.col("id") % 10 == 0, "id")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_range" in line]
    assert len(moved) == 2 and "rangepartitioning" not in plan  # the rows, and the totals of their ranges
