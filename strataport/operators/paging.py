"""Key-ordered pages of a table and the merges of a page into a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def after_key(key: list[str], last: list) -> Column:
    """Rows after a key. A compound key is written out, so that the file scan can skip row groups by it."""
    out = None
    for i in range(len(key)):
        same = [F.col(k) == v for k, v in zip(key[:i], last[:i])]
        term = reduce(lambda a, b: a & b, [*same, F.col(key[i]) > last[i]])
        out = term if out is None else out | term
    return out


def page(df: DataFrame, key: list[str], size: int, last: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """The next ``size`` rows after ``last`` (the first, without it): a partial sort in each task."""
    rows = df.where(after_key(key, last)) if last is not None else df
    return (rows.select(*columns) if columns else rows).orderBy(*key).limit(size)


def numbered(df: DataFrame, key: list[str], name: str = "rn") -> DataFrame:
    """Rows with their number in key order from 1, without a task that sees all of them: a number is a row's place in its
    range of keys plus the count of all ranges before it."""
    return running(df, key, **{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) + 1)


def pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """Every page of a table: batch_no, start_key, end_key, row_count, rows_so_far. Only keys are read and moved."""
    rows = numbered(df.select(key), [key])
    by = rows.groupBy(F.floor((F.col("rn") - 1) / size).cast("long").alias("batch_no")).agg(
        F.min(key).alias("start_key"), F.max(key).alias("end_key"), F.count(F.lit(1)).alias("row_count")
    )
    return by.withColumn("rows_so_far", F.col("batch_no") * size + F.col("row_count"))  # every page before is full


def insert_absent(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch join the target where their key is absent; existing rows win. A batch's repeated keys count once."""
    return target.unionByName(batch.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` (of unique keys) take the place of rows with their key or are added."""
    return target.join(changes.select(*key), key, "left_anti").select(*target.columns).unionByName(changes.select(*target.columns))


def partial_update(target: DataFrame, changes: DataFrame, key: list[str], columns: list[str], sent: str = "sent_{}") -> DataFrame:
    """Columns that a change has sent (a flag beside each) overwrite the row of its key, nulls too; keys that the target
    doesn't have are ignored."""
    t, c = target.alias("t"), changes.alias("c")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"c.{k}") for k in key])
    pick = lambda x: F.when(F.col(f"c.{sent.format(x)}"), F.col(f"c.{x}")).otherwise(F.col(f"t.{x}")).alias(x)
    return t.join(c, on, "left").select(*[pick(x) if x in columns else F.col(f"t.{x}") for x in target.columns])


def delete_keys(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return target.join(keys.select(*key), key, "left_anti").select(*target.columns)


def key_uniqueness(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows, distinct keys, and whether the key is unique: one aggregation by key, summed."""
    by = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(
        F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("key_count")
    ).withColumn("is_unique", F.col("row_count") == F.col("key_count"))


def throttle_delay(rows: Column, milliseconds: Column, rows_per_second: int | None) -> Column:
    """Seconds to wait after a page to keep within a rate."""
    if not rows_per_second:
        return F.lit(0.0)
    return F.greatest(rows / float(rows_per_second) - milliseconds / 1000.0, F.lit(0.0))
