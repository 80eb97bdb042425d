"""Running values over a table in key order, without a task that sees all of it or all of one group.

Rows are dealt to ranges of the key by bounds that are known beforehand, so each row's range is a plain expression of its
key: the rows are shuffled once, and what the ranges before hold is a small aggregation of the same table (a row for each
range and group), whose prefix is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a key that isn't a number are compared one by one, as a tree of so many leaves.
LEAVES = 128
_SAMPLE = 32
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def ranged(df: DataFrame, key: list[str], name: str = "_range", parts: int | None = None) -> DataFrame:
    """``df`` with the number of the range of its key that a row is in: ranges of about equal size, by a sample of keys.

    The bounds are values, so every evaluation of the plan gives a row the same range. Of a single number or time the
    range is found by binary search; any other key is compared with at most ``LEAVES`` bounds. Null keys are in the last
    range (a number) or come first (else).
    """
    n = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if len(key) == 1 and (kind := dict(df.dtypes)[key[0]]) in _NUMBERS:
        from pyspark.ml.feature import Bucketizer

        as_double = F.col(key[0]).cast("timestamp" if kind in ("date", "timestamp_ntz") else kind).cast("double")
        found = df.agg(F.percentile_approx(as_double, [i / n for i in range(1, n)], 10 * n)).first()[0]
        splits = [-float("inf"), *sorted(set(found or [])), float("inf")]
        if len(splits) < 3:
            return df.withColumn(name, F.lit(0))
        put = Bucketizer(splits=splits, inputCol="_at", outputCol="_to", handleInvalid="keep").transform(df.withColumn("_at", as_double))
        return put.withColumn(name, F.col("_to").cast("int")).drop("_at", "_to")
    n = min(n, LEAVES)
    some = sorted(df.select(*key).na.drop().orderBy(F.rand(7)).limit(_SAMPLE * n).collect())  # <= 32 * 128 keys
    bounds = [some[len(some) * i // n] for i in range(1, n)] if some else []

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.struct(*key) < F.struct(*[F.lit(x).alias(k) for k, x in zip(key, bounds[mid])]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return df.withColumn(name, tree(0, len(bounds)))


def running(df: DataFrame, key: list[str], by: str | None = None, parts: int | None = None, **what: tuple[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``what``, (kind, value), in the order of ``key`` within each ``by`` (a null is a
    group of its own):

    ``sum``: of the rows before; ``last``: the latest value that isn't null, this row's included; ``next``: the nearest
    one at or after this row; ``max``: the greatest so far.
    """
    group = [] if by is None else ["_by"]
    if by is not None:  # never null, so that a plain equality joins it
        df = df.withColumn("_by", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))
    rows = ranged(df, key, parts=parts).withColumns({f"_v_{n}": value for n, (_, value) in what.items()})
    here = Window.partitionBy(*group, "_range")
    up, down = here.orderBy(*key), here.orderBy(*[F.desc(k) for k in key])
    so_far = (Window.unboundedPreceding, 0)
    at = F.struct(*key)
    local, total, before, out = {}, [], {}, {}
    parted = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_range")  # a row for each range and group
    back = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc("_range"))
    past = (Window.unboundedPreceding, -1)
    for n, (kind, _) in what.items():
        v, t, own, base = F.col(f"_v_{n}"), f"_t_{n}", F.col(f"_l_{n}"), F.col(f"_b_{n}")
        known = F.when(v.isNotNull(), at)
        if kind == "sum":
            local[f"_l_{n}"] = F.coalesce(F.sum(v).over(up.rowsBetween(*past)), F.lit(0))
            total.append(F.sum(v).alias(t))
            before[f"_b_{n}"] = F.coalesce(F.sum(t).over(parted.rowsBetween(*past)), F.lit(0))
            out[n] = own + base
        elif kind == "last":
            local[f"_l_{n}"] = F.last(v, True).over(up.rowsBetween(*so_far))
            total.append(F.max_by(v, known).alias(t))
            before[f"_b_{n}"] = F.last(t, True).over(parted.rowsBetween(*past))
            out[n] = F.coalesce(own, base)
        elif kind == "next":  # the latest, in the reversed order
            local[f"_l_{n}"] = F.last(v, True).over(down.rowsBetween(*so_far))
            total.append(F.min_by(v, known).alias(t))
            before[f"_b_{n}"] = F.last(t, True).over(back.rowsBetween(*past))
            out[n] = F.coalesce(own, base)
        elif kind == "max":
            local[f"_l_{n}"] = F.max(v).over(up.rowsBetween(*so_far))
            total.append(F.max(v).alias(t))
            before[f"_b_{n}"] = F.max(t).over(parted.rowsBetween(*past))
            out[n] = F.greatest(own, base)
        else:
            raise ValueError(kind)
    ends = rows.groupBy(*group, "_range").agg(*total).withColumns(before)
    ends = ends.select(*group, "_range", *before)
    joined = rows.withColumns(local).join(ends, [*group, "_range"])
    kept = [c for c in df.columns if c != "_by" and c not in what]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in out.items()])
