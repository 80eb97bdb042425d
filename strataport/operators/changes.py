"""Decoded log messages as typed changes of a target table, under its spec."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions import types as T
from ..plans.spec import TableSpec
from . import changelog as C
from .project import source_types


@dataclass(frozen=True)
class TablePlan:
    """What becomes of one table's changes: its spec, the source's columns with their types (Spark's and the log's), its
    key there, and the namespace in which the log has it."""

    spec: TableSpec
    columns: tuple[tuple[str, str, str], ...]
    key: tuple[str, ...]
    namespace: str = "public"

    @property
    def kept(self) -> list[tuple[str, str, str]]:
        gone = set(self.spec.drops)
        return [c for c in self.columns if c[0] not in gone]

    @property
    def target_key(self) -> list[str]:
        return self.spec.target_key(list(self.key))

    @property
    def target_columns(self) -> list[str]:
        """All of the target's columns, in its order."""
        return [self.spec.target_name(c) for c, _, _ in self.kept] + [a.name for a in self.spec.add_columns]

    @property
    def values(self) -> list[str]:
        return [c for c in self.target_columns if c not in self.target_key]


def plan_of(spec: TableSpec, source: DataFrame, key: list[str], namespace: str = "public") -> TablePlan:
    kinds = source_types(source)
    lost = [k for k in key if k in spec.drops or k not in kinds]
    if not key or lost:
        raise SpecError(f"{spec.name}: changes need a key that is kept: {', '.join(lost) or 'none'}")
    return TablePlan(spec, tuple((f.name, f.dataType.simpleString(), kinds[f.name]) for f in source.schema), tuple(key), namespace)


def of_table(decoded: DataFrame, plan: TablePlan) -> DataFrame:
    """The row messages of a plan's table: routed by namespace and name, as two schemas may have a table of one name."""
    return decoded.where(F.col("kind").isin("I", "U", "D") & (F.col("namespace") == plan.namespace) & (F.col("name") == plan.spec.name))


def _cell(row: str, column: str) -> Column:
    """The value of a named column in a tuple, null where the tuple doesn't have it."""
    return F.try_element_at(F.col(row), F.nullif(F.array_position("columns", column), F.lit(0).cast("long")).cast("int"))


def table_changes(decoded: DataFrame, plan: TablePlan) -> DataFrame:
    """The changes of a table: the target's key and columns, typed as the spec wants, lsn, op (I, U, P, D) and for each
    column that isn't of the key a flag ``sent_<column>``.

    An update with values that it doesn't send is a partial one (P). An update whose old row has another key deletes that
    key and inserts the new one; where the log has the whole old row, unsent values come from there, else they can't be
    known and it is an error. Columns that a message doesn't have are null; added columns have their default in rows that
    are inserted, and keep their value in others.
    """
    rows = of_table(decoded, plan)
    kept, key = plan.kept, plan.target_key

    def typed(cell: Column, kind: str, spark: str, to: str | None) -> Column:
        value = cell["text"].cast(spark)
        return T.cast_column(value, kind, to) if to else value

    cells = {c: (_cell("new", c), _cell("old", c)) for c, _, _ in kept}
    unsent = {c: F.coalesce(cells[c][0]["state"] == "u", F.lit(False)) for c in cells}
    whole_old = F.coalesce(F.col("old_kind") == "O", F.lit(False))
    cast = {c: (lambda x, kind=kind, spark=spark, c=c: typed(x, kind, spark, plan.spec.columns[c].type if c in plan.spec.columns else None)) for c, spark, kind in kept}
    deleted = F.col("kind") == "D"
    old_key = {c: cast[c](cells[c][1]) for c in plan.key}
    new_key = {c: F.when(unsent[c], old_key[c]).otherwise(cast[c](cells[c][0])) for c in plan.key}
    moved = (F.col("kind") == "U") & F.col("old").isNotNull() & reduce(
        lambda a, b: a | b, [cells[c][1]["text"].isNotNull() & ~(old_key[c].eqNullSafe(new_key[c])) for c in plan.key]
    )
    lost = reduce(lambda a, b: a | b, [unsent[c] & ~whole_old for c in unsent if c not in plan.key], F.lit(False))
    head = rows.withColumns({"_moved": moved, "_lost": lost})
    head = head.where(F.when(
        F.col("_moved") & F.col("_lost"),
        F.raise_error(F.concat(F.lit(f"{plan.spec.name}: an update changes its key and leaves values unsent, at "), F.col("seq").cast("string"))).isNull()
    ).otherwise(F.lit(True)))
    some_unsent = reduce(lambda a, b: a | b, [unsent[c] for c in unsent if c not in plan.key], F.lit(False))
    op = F.when(deleted, "D").when(F.col("kind") == "I", "I").when(F.col("_moved"), "I").when(some_unsent & ~whole_old, "P").otherwise("U")
    name = plan.spec.target_name
    fill = {c: F.when(deleted, F.lit(None)).when(unsent[c] & whole_old, cast[c](cells[c][1])).otherwise(cast[c](cells[c][0])) for c in cells if c not in plan.key}
    added = {a.name: (F.expr(a.default) if a.default is not None else F.lit(None)).cast(T.spark_type(a.type)) for a in plan.spec.add_columns}
    main = head.select(
        *[F.when(deleted, old_key[c]).otherwise(new_key[c]).alias(name(c)) for c in plan.key], F.col("seq").alias("lsn"), op.alias("op"), *[x.alias(name(c)) for c, x in fill.items()], *[x.alias(n) for n, x in added.items()],
        *[(~unsent[c] | whole_old).alias(f"sent_{name(c)}") for c in fill], *[F.lit(False).alias(f"sent_{n}") for n in added],
    )
    gone = head.where("_moved").select(*[old_key[c].alias(name(c)) for c in plan.key], F.col("seq").alias("lsn"), F.lit("D").alias("op"))
    out = main.unionByName(gone, allowMissingColumns=True)
    return out.select(*key, "lsn", "op", *plan.values, *[f"sent_{c}" for c in plan.values])


def change_states(changes: DataFrame, plan: TablePlan) -> DataFrame:
    """One state for each key that some changes touch. Of an update an added column's default counts only where nothing
    else gives the column a value."""
    place = {a.name: F.when(F.col("op") == "U", F.lit(C.DEFAULT).cast("long")).otherwise(F.col("lsn")) for a in plan.spec.add_columns}
    sent = {c: F.col(f"sent_{c}") for c in plan.values}
    return C.merged(C.states(changes, plan.target_key, plan.values, sent=sent, place=place), plan.target_key, plan.values)
