"""A spec as one projection, and one-pass validation of its casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions import types as T
from ..plans.spec import TableSpec


def source_types(df: DataFrame) -> dict[str, str]:
    return {f.name: T.of_spark(f.dataType.simpleString()) for f in df.schema}


def select_list(df: DataFrame, spec: TableSpec) -> list[Column]:
    """Columns of the target: source order without drops, renamed and cast, then added ones.

    Casts are plain projections inside code generation; dropped columns are never read. A default is an SQL expression,
    evaluated once for a query where it is a time.
    """
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise SpecError(f"{spec.name}: no such column: {', '.join(missing)}")
    kinds, out = source_types(df), []
    for c in df.columns:
        s = spec.columns.get(c)
        if s and s.drop:
            continue
        col = F.col(f"`{c}`")
        if s and s.type:
            if T.cast_safety(kinds[c], s.type) == "unsupported":
                raise SpecError(f"{spec.name}.{c}: {kinds[c]} to {s.type} isn't supported")
            col = T.cast_column(col, kinds[c], s.type)
        out.append(col.alias(spec.target_name(c)))
    for a in spec.add_columns:
        value = F.expr(a.default) if a.default is not None else F.lit(None)
        out.append(value.cast(T.spark_type(a.type)).alias(a.name))
    return out


def apply_spec(df: DataFrame, spec: TableSpec, order: list[str] | None = None) -> DataFrame:
    """The target rows of a table, in the order of the spec or the one given."""
    out = df.select(*select_list(df, spec))
    return out.select(*[f"`{c}`" for c in order]) if order else out


def validate(df: DataFrame, checks: Iterable[tuple[str, Column, str, str]]) -> DataFrame:
    """Failing rows of all casts in a single aggregation: (check_name, safety, failing, warn_only).

    ``checks``: name, column, internal source type, target type. ``failing`` is null where rows aren't counted. One scan
    and one row from each task, however many checks.
    """
    rows, aggs = [], []
    for i, (name, col, source, target) in enumerate(checks):
        safety = T.cast_safety(source, target)
        test = T.failing(col, source, target) if safety == "validated" else None
        if test is not None:
            aggs.append(F.count_if(test).alias(f"f{i}"))
        rows.append((name, safety, f"f{i}" if test is not None else None, (source, T.internal(target)) in T.WARN_ONLY))
    counted = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    each = F.array(*[F.struct(
        F.lit(n).alias("check_name"), F.lit(s).alias("safety"), (F.col(f) if f else F.lit(None)).cast("long").alias("failing"),
        F.lit(w).alias("warn_only")
    ) for n, s, f, w in rows])
    return counted.select(F.inline(each))


def spec_checks(df: DataFrame, spec: TableSpec) -> list[tuple[str, Column, str, str]]:
    """Checks of all casts that a spec asks for."""
    kinds = source_types(df)
    return [(c, F.col(f"`{c}`"), kinds[c], s.type) for c, s in spec.columns.items() if s.type and not s.drop and c in kinds]
