"""Change logs as frames: transactions, relation versions, routing, compaction and convergence with a copy.

A change has its key columns, ``lsn`` (unique, in order), ``op`` (I, U: a full row; P: a partial update; D: delete) and the
row's columns, each with a flag of whether it was sent; I and U send all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

KINDS = ("I", "U", "P", "D")


def reject_truncate(log: DataFrame, kind: str = "kind", tables: str = "tables") -> DataFrame:
    """The log, failing at run time at a TRUNCATE, which can't be applied."""
    message = F.concat(F.lit("TRUNCATE on "), F.coalesce(F.col(tables).cast("string"), F.lit("?")), F.lit(" can't be applied"))
    return log.where(F.when(F.col(kind) == "T", F.raise_error(message).isNull()).otherwise(F.lit(True)))


def route(log: DataFrame, plans: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Changes of planned tables, and how many of each other are skipped."""
    return log.where(F.col(by).isin(plans)), log.where(~F.col(by).isin(plans)).groupBy(by).agg(F.count(F.lit(1)).alias("skipped"))


def transactions(log: DataFrame, is_commit: Column, lsn: str = "lsn", segment: str | None = None) -> DataFrame:
    """Changes with txn (from 0) and commit_lsn; a tail without a commit is left out.

    ``segment`` names a column of independent streams, which are numbered apart. The log is shuffled once, by ranges of
    its positions; neither the whole log nor one stream meets in a task.
    """
    out = running(log, [lsn], segment, txn=("sum", is_commit.cast("long")), commit_lsn=("next", F.when(is_commit, F.col(lsn))))
    return out.where("commit_lsn is not null")


def relation_as_of(log: DataFrame, relation: str, is_relation: Column, version: Column, lsn: str = "lsn") -> DataFrame:
    """Each change with the latest version of its relation at or before it, null before the first."""
    return running(log, [lsn], relation, relation_version=("last", F.when(is_relation, version)))


#: Positions of what isn't a change: a row of the target, one that a copy brought, a default.
BASE, COPIED, DEFAULT = -1, -2, -10


def states(
    log: DataFrame, key: list[str], columns: list[str], lsn: str = "lsn", op: str = "op", sent: dict[str, Column] | None = None,
    place: dict[str, Column] | None = None
) -> DataFrame:
    """Each change as the state that it gives its key: the position if it deletes (gone) or is a full row (full), and each
    column's value with its position where it was sent. ``sent``: for a partial update whether it sent a column (all,
    for columns that aren't named); ``place``: another position for a column's value."""
    sent, place, full, at = sent or {}, place or {}, F.col(op).isin("I", "U"), F.col(lsn).cast("long")
    gives = lambda c: (full | (sent[c] & (F.col(op) == "P"))) if c in sent else F.col(op) != "D"
    return log.select(
        *key, F.when(F.col(op) == "D", at).alias("gone"), F.when(full, at).alias("full"),
        *[F.when(gives(c), F.struct(place.get(c, at).alias("at"), F.col(c).alias("v"))).alias(c) for c in columns]
    )


def row_states(rows: DataFrame, key: list[str], columns: list[str], at: int = BASE) -> DataFrame:
    """Rows as states that were there before all changes."""
    place = F.lit(at).cast("long")
    return rows.select(*key, F.lit(None).cast("long").alias("gone"), place.alias("full"), *[F.struct(place.alias("at"), F.col(c).alias("v")).alias(c) for c in columns])


def merged(each: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One state for each key: the latest of everything. Merging states of parts gives the states of the whole. Maxima
    combine on the map side, so a key with a third of the log sends one row from each task."""
    return each.groupBy(*key).agg(F.max("gone").alias("gone"), F.max("full").alias("full"), *[F.max_by(c, F.col(c)["at"]).alias(c) for c in columns])


def living(state: DataFrame, key: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows that states leave: a key lives if a full row came after its last delete."""
    alive = state.where(F.col("full") > F.coalesce("gone", F.lit(DEFAULT)))
    return alive.select(*key, *[F.col(c)["v"].alias(c) for c in columns]).select(*(order or [*key, *columns]))


def compact(
    log: DataFrame, key: list[str], columns: list[str], lsn: str = "lsn", op: str = "op", sent: dict[str, Column] | None = None,
    base: DataFrame | None = None
) -> DataFrame:
    """The final row of each live key: what applying the changes one by one gives, in one aggregation. A ``base`` row is a
    full change before all others."""
    each = states(log, key, columns, lsn, op, sent)
    if base is not None:
        each = each.unionByName(row_states(base, key, columns))
    return living(merged(each, key, columns), key, columns)


def op_counts(log: DataFrame, key: list[str], lsn: str = "lsn", op: str = "op") -> DataFrame:
    """Per key: inserts, updates, deletes and the last operation."""
    count = lambda *k: F.count_if(F.col(op).isin(*k))
    return log.groupBy(*key).agg(count("I").alias("ins"), count("U", "P").alias("upd"), count("D").alias("del"), F.max_by(op, lsn).alias("last_op"))


def split_key_changes(log: DataFrame, key: str, old_key: str, lsn: str = "lsn", op: str = "op") -> DataFrame:
    """An update that changes its key becomes a delete of the old key and an upsert of the new one."""
    moved = (F.col(op) == "U") & F.col(old_key).isNotNull() & (F.col(old_key) != F.col(key))
    gone = log.where(moved).withColumns({key: F.col(old_key), op: F.lit("D")})
    return log.unionByName(gone)
