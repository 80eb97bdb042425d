"""Schema algebra over catalog frames: target synthesis, diff, storage layout and DDL.

A catalog frame has a row for each column: table_name, attnum, name, type_name, formatted_type, alignment, fixed_size
(null: variable), nullable, default_expr. Catalogs have a row for each column of a schema, so these frames are small
whatever the tables hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import types as T
from ..plans.spec import TableSpec

CATALOG = "table_name string, attnum int, name string, type_name string, formatted_type string, alignment int, fixed_size int, nullable boolean, default_expr string"
DIFF = "table_name string, ord int, status string, source_name string, source_type string, target_name string, target_type string"


def catalog(spark: SparkSession, table: str, columns: list[tuple]) -> DataFrame:
    """A catalog frame from (name, type as spelled, nullable, default); alignment and size come from the registry."""
    rows = []
    for i, (name, kind, *rest) in enumerate(columns, 1):
        p = T.physical(kind)
        nullable, default = (*rest, *(True, None)[len(rest) :])
        rows.append((table, i, name, T.internal(kind), kind, p.alignment, p.size, nullable, default))
    return spark.createDataFrame(rows, CATALOG)


def catalog_of(df: DataFrame, table: str) -> DataFrame:
    """The catalog frame of a DataFrame's own schema."""
    spelled = {"int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "bool": "boolean"}
    kinds = [(f.name, T.of_spark(f.dataType.simpleString()), f.nullable) for f in df.schema]
    return catalog(df.sparkSession, table, [(n, spelled.get(k, k), nullable) for n, k, nullable in kinds])


def spec_frames(spark: SparkSession, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """A spec as frames: changes (name, to_type, rename, dropped and the physical shape of to_type), and added columns."""
    changes = [(
        c, s.type, s.rename, s.drop, *((p.alignment, p.size, T.internal(s.type)) if s.type and (p := T.physical(s.type)) else (None, None, None))
    ) for c, s in spec.columns.items()]
    adds = [(i, a.name, T.internal(a.type), a.type, T.physical(a.type).alignment, T.physical(a.type).size, a.default) for i, a in enumerate(spec.add_columns, 1)]
    return (
        spark.createDataFrame(changes, "name string, to_type string, rename string, dropped boolean, to_align int, to_size int, to_name string"),
        spark.createDataFrame(adds, "ord int, name string, type_name string, formatted_type string, alignment int, fixed_size int, default_expr string"),
    )


def target_catalog(source: DataFrame, spec: TableSpec) -> DataFrame:
    """The catalog that a spec makes of a source catalog: source order without drops, then added columns, all nullable."""
    changes, adds = spec_frames(source.sparkSession, spec)
    kept = source.alias("s").join(F.broadcast(changes).alias("c"), "name", "left").where("not coalesce(dropped, false)")  # a row for each column of a spec
    retyped = F.col("to_type").isNotNull()
    base = kept.select(
        "table_name", "attnum", F.coalesce("rename", "name").alias("name"), F.coalesce("to_name", "type_name").alias("type_name"), F.coalesce("to_type", "formatted_type").alias("formatted_type"),
        F.coalesce("to_align", "alignment").alias("alignment"), F.when(retyped, F.col("to_size")).otherwise(F.col("fixed_size")).alias("fixed_size"), "nullable", "default_expr",
    )
    added = adds.select(
        F.lit(spec.name).alias("table_name"), (F.col("ord") + 10_000).alias("attnum"), "name", "type_name", "formatted_type", "alignment",
        "fixed_size", F.lit(True).alias("nullable"), "default_expr"
    )
    return base.unionByName(added)


def _status(src: Column, tgt: Column, src_type: Column, tgt_type: Column) -> Column:
    retyped, renamed = F.lower(src_type) != F.lower(tgt_type), src != tgt
    return F.when(retyped & renamed, "type_and_renamed").when(retyped, "type_changed").when(renamed, "renamed").otherwise("unchanged")


def diff_synthesized(source: DataFrame, spec: TableSpec) -> DataFrame:
    """A row for each source column (unchanged, type_changed, renamed, type_and_renamed, dropped), then each added one."""
    changes, adds = spec_frames(source.sparkSession, spec)
    both = source.join(F.broadcast(changes), "name", "left")  # a row for each column of a spec
    gone = F.coalesce("dropped", F.lit(False))
    name, kind = F.coalesce("rename", "name"), F.coalesce("to_type", "formatted_type")
    rows = both.select(
        "table_name", F.col("attnum").alias("ord"), F.when(gone, "dropped").otherwise(_status(F.col("name"), name, F.col("formatted_type"), kind)).alias("status"),
        F.col("name").alias("source_name"), F.col("formatted_type").alias("source_type"), F.when(~gone, name).alias("target_name"), F.when(~gone, kind).alias("target_type"),
    )
    none = F.lit(None).cast("string")
    return rows.unionByName(adds.select(
        F.lit(spec.name).alias("table_name"), (F.col("ord") + 10_000).alias("ord"), F.lit("added").alias("status"), none.alias("source_name"),
        none.alias("source_type"), F.col("name").alias("target_name"), F.col("formatted_type").alias("target_type")
    ))


def diff_live(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """The same against a target's own catalog: matched by renamed name; without a match dropped; unmatched target columns
    added, after all others in their own order."""
    changes, _ = spec_frames(source.sparkSession, spec)
    s = source.join(F.broadcast(changes.select("name", "rename")), "name", "left").select(
        "table_name", "attnum", "name", "formatted_type", F.coalesce("rename", "name").alias("link")
    )
    t = target.select(F.col("attnum").alias("t_attnum"), F.col("name").alias("t_name"), F.col("formatted_type").alias("t_type"))
    both = s.join(t, F.col("link") == F.col("t_name"), "full")
    status = F.when(F.col("name").isNull(), "added").when(F.col("t_name").isNull(), "dropped").otherwise(_status(
        F.col("name"), F.col("t_name"), F.col("formatted_type"), F.col("t_type")
    ))
    return both.select(
        F.coalesce("table_name", F.lit(spec.name)).alias("table_name"), F.coalesce("attnum", F.col("t_attnum") + 10_000).alias("ord"),
        status.alias("status"), F.col("name").alias("source_name"), F.col("formatted_type").alias("source_type"),
        F.col("t_name").alias("target_name"), F.col("t_type").alias("target_type")
    )


def _key(optimal: bool) -> Column:
    fixed = F.col("fixed_size")
    if not optimal:
        return F.struct(F.col("attnum").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
    return F.struct(
        fixed.isNull().cast("int").alias("a"), F.when(fixed.isNull(), 0).otherwise(-F.col("alignment")).alias("b"),
        F.when(fixed.isNull(), 0).otherwise(-fixed).alias("c"), F.col("attnum").alias("d")
    )


def layout(columns: DataFrame, optimal: bool = False) -> DataFrame:
    """Per column of each table: pos (from 1), offset and padding before it, in source order or the order with least
    padding (fixed before variable, wider alignment and size first, else as before).

    A fold, as each offset depends on the one before; a group has the columns of one table.
    """
    one = F.struct(
        _key(optimal).alias("key"), F.col("name"), F.when(F.col("fixed_size").isNull(), 4).otherwise(F.col("alignment")).alias("align"),
        F.coalesce("fixed_size", F.lit(4)).alias("size")
    )
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<name:string,offset:int,padding:int,size:int>>").alias("out"))

    def place(acc: Column, c: Column) -> Column:
        pad = F.pmod(c["align"] - F.pmod(acc["end"], c["align"]), c["align"])
        start = acc["end"] + pad
        return F.struct(
            (start + c["size"]).alias("end"),
            F.concat(acc["out"], F.array(F.struct(c["name"].alias("name"), start.alias("offset"), pad.alias("padding"), c["size"].alias("size")))).alias("out")
        )

    folded = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(one)).alias("c")).select("table_name", F.aggregate("c", zero, place)["out"].alias("out"))
    return folded.select("table_name", F.posexplode("out").alias("pos", "c")).select("table_name", (F.col("pos") + 1).alias("pos"), "c.name", "c.offset", "c.padding", "c.size")


def padding_report(columns: DataFrame) -> DataFrame:
    """Per table: bytes and padding as it is and at best, what is saved, its percentage (one decimal), already_optimal."""

    def sums(optimal: bool, name: str) -> DataFrame:
        return layout(columns, optimal).groupBy("table_name").agg(F.sum(F.col("padding") + F.col("size")).alias(f"{name}_bytes"), F.sum("padding").alias(f"{name}_padding"))

    both = sums(False, "current").join(sums(True, "optimal"), "table_name")
    saved = F.col("current_bytes") - F.col("optimal_bytes")
    return both.withColumns({"saved_bytes": saved, "saved_pct": F.round(saved * 100.0 / F.col("current_bytes"), 1), "already_optimal": saved == 0})


def ddl_lines(columns: DataFrame, key: list[str] = (), optimal: bool = False) -> DataFrame:
    """Per table a line for each column of its CREATE TABLE, padded to a grid, and one for its key (pos after all)."""
    per_table = Window.partitionBy("table_name")  # the columns of a table
    quoted, shown = X.quote_ident(F.col("name")), X.display_type(F.col("formatted_type"))
    ordered = columns.withColumns({"q": quoted, "t": shown, "pos": F.row_number().over(per_table.orderBy(_key(optimal)))})
    ordered = ordered.withColumns({"qw": F.max(F.length("q")).over(per_table), "tw": F.max(F.length("t")).over(per_table)})
    pad = lambda c, n: F.concat(c, F.repeat(F.lit(" "), n - F.length(c)))
    default = F.col("default_expr").isNotNull() & ~F.col("default_expr").startswith("nextval(") & ~F.col("default_expr").rlike(r"(?i)\bgenerated\b")
    line = F.concat_ws(
        "  ", F.concat(F.lit("  "), pad(F.col("q"), F.col("qw")), F.lit("  "), pad(F.col("t"), F.col("tw"))), F.when(~F.col("nullable"), "NOT NULL"),
        F.when(default, F.concat(F.lit("DEFAULT "), F.col("default_expr")))
    )
    lines = ordered.select("table_name", "pos", F.rtrim(line).alias("line"))
    if not key:
        return lines
    names = F.concat_ws(", ", *[X.quote_ident(F.lit(k)) for k in key])
    return lines.unionByName(lines.groupBy("table_name").agg((F.max("pos") + 1).alias("pos")).select(
        "table_name", "pos", F.concat(F.lit("  PRIMARY KEY ("), names, F.lit(")")).alias("line")
    ))


def create_table(columns: DataFrame, key: list[str] = (), optimal: bool = False, schema: str = "public") -> DataFrame:
    """Per table its CREATE TABLE statement."""
    lines = ddl_lines(columns, key, optimal).groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), ",\n")
    return lines.select("table_name", F.concat(F.lit("CREATE TABLE "), X.quote_table(F.col("table_name"), schema), F.lit(" (\n"), body, F.lit("\n)")).alias("ddl"))
