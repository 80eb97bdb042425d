"""Scans of a source's catalog: keys, indexes, constraints, identities, grants, comments, owned sequences, estimates.

A catalog is a set of frames, a row for each relation, attribute, index, ...; the scans join them for all tables at once
rather than asking table by table. ``read_catalog`` takes them from a folder of JSON files beside the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONS = "oid long, namespace string, table_name string, owner string, identity string, estimate long, acl array<struct<grantee:string,privilege:string>>"
ATTRIBUTES = "relid long, attnum int, name string, dropped boolean, identity string, default string, comment string"
INDEXES = "indexrelid long, relid long, name string, is_unique boolean, is_primary boolean, attnums array<int>, definition string"
CONSTRAINTS = "relid long, name string, kind string, attnums array<int>, index_id long, definition string"
SEQUENCES = "oid long, name string, relid long, attnum int, deptype string, last_value long, is_called boolean"
COMMENTS = "relid long, comment string"


@dataclass(frozen=True)
class Catalog:
    relations: DataFrame
    attributes: DataFrame
    indexes: DataFrame
    constraints: DataFrame
    sequences: DataFrame
    comments: DataFrame


SCHEMAS = {"relations": RELATIONS, "attributes": ATTRIBUTES, "indexes": INDEXES, "constraints": CONSTRAINTS, "sequences": SEQUENCES, "comments": COMMENTS}


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    """A catalog from JSON-lines files named after its parts; a part without a file is empty."""
    from ..sources.store import Files

    files = Files(spark)
    at = {n: f"{folder.rstrip('/')}/{n}.json" for n in SCHEMAS}
    return Catalog(*[spark.read.schema(SCHEMAS[f.name]).json(at[f.name]) if files.exists(at[f.name]) else spark.createDataFrame([], SCHEMAS[f.name]) for f in fields(Catalog)])


def _tables(c: Catalog) -> DataFrame:
    return c.relations.select(F.col("oid").alias("relid"), "table_name", "owner")


def _named(each: DataFrame, c: Catalog, by: list[str]) -> DataFrame:
    """``by`` with columns: the names behind attnums, in their order; expressions (attnum 0) are left out."""
    one = each.select(*by, "relid", F.posexplode_outer("attnums").alias("pos", "attnum"))
    names = c.attributes.select("relid", "attnum", F.col("name").alias("column"))
    got = one.join(names, ["relid", "attnum"], "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("pos", "column")))).alias("c"))
    return got.withColumn("columns", F.transform("c", lambda x: x["column"])).drop("c")


def primary_keys(c: Catalog) -> DataFrame:
    """table_name and the columns of its primary key, in key order."""
    keys = c.indexes.where("is_primary").join(_tables(c), "relid")
    return _named(keys, c, ["table_name"])


def key_members(c: Catalog) -> DataFrame:
    """Every column that a primary key has: (table_name, name)."""
    keys = c.indexes.where("is_primary").select("relid", F.explode("attnums").alias("attnum"))
    return keys.join(c.attributes, ["relid", "attnum"]).join(_tables(c), "relid").select("table_name", "name").distinct()


def indexes(c: Catalog) -> DataFrame:
    """Indexes that are neither the primary key nor behind a constraint: table_name, name, is_unique, columns, definition."""
    free = c.indexes.where("not is_primary").join(
        c.constraints.where("index_id != 0").select(F.col("relid"), F.col("index_id").alias("indexrelid")), ["relid", "indexrelid"], "left_anti"
    )
    return _named(free.join(_tables(c), "relid"), c, ["table_name", "name", "is_unique", "definition"])


def constraints(c: Catalog) -> DataFrame:
    """Foreign keys, unique and check constraints: table_name, name, kind, columns, definition."""
    some = c.constraints.where(F.col("kind").isin("f", "u", "c")).join(_tables(c), "relid")
    return _named(some, c, ["table_name", "name", "kind", "definition"])


def identities(c: Catalog) -> DataFrame:
    """Identity and serial columns: table_name, name, kind."""
    own = c.attributes.where("attnum > 0 and not dropped").where(F.col("identity").isin("a", "d") | F.col("default").like("nextval(%"))
    kind = F.when(F.coalesce("identity", F.lit("")) == "", "serial").otherwise("identity")
    return own.join(_tables(c), "relid").select("table_name", "name", kind.alias("kind"))


def grants(c: Catalog) -> DataFrame:
    """Per table and grantee the privileges in order, without the owner's own; grantee 0 is PUBLIC."""
    from .reconcile import grouped_grants

    each = c.relations.select("table_name", "owner", F.explode("acl").alias("g")).select("table_name", "owner", "g.grantee", "g.privilege")
    return grouped_grants(each)


def comments(c: Catalog) -> DataFrame:
    """Comments of tables (name null) and of their columns: table_name, name, comment."""
    of_table = c.comments.join(_tables(c), "relid").select("table_name", F.lit(None).cast("string").alias("name"), "comment")
    of_column = c.attributes.where("attnum > 0 and not dropped and comment is not null").join(_tables(c), "relid").select("table_name", "name", "comment")
    return of_table.where("comment is not null").unionByName(of_column)


def owned_sequences(c: Catalog) -> DataFrame:
    """Sequences that a column owns: table_name, column_name, sequence_name, last_value as far as it was used."""
    own = c.sequences.where(F.col("deptype").isin("a", "i"))
    used = F.when(F.col("is_called"), F.col("last_value")).otherwise(F.col("last_value") - 1)
    named = own.join(c.attributes.select("relid", "attnum", F.col("name").alias("column_name")), ["relid", "attnum"]).join(_tables(c), "relid")
    return named.select("table_name", "column_name", F.col("name").alias("sequence_name"), used.alias("last_value"))


def estimates(c: Catalog) -> DataFrame:
    """The catalog's estimate of each table's rows; 0 where it has none."""
    return c.relations.select("table_name", F.greatest(F.coalesce("estimate", F.lit(0)), F.lit(0)).cast("long").alias("estimated_rows"))


def replica_identities(c: Catalog) -> DataFrame:
    return c.relations.select("table_name", "identity")


def column_defaults(c: Catalog) -> DataFrame:
    """Every live column with its default, null where it has none: table_name, attnum, name, default."""
    return c.relations.select(F.col("oid").alias("relid"), "table_name").join(
        c.attributes.where("attnum > 0 and not dropped"), "relid"
    ).select("table_name", "attnum", "name", "default")


def droppable(names: DataFrame, c: Catalog) -> DataFrame:
    """Those of some table names that exist."""
    return names.join(c.relations, "table_name", "left_semi")


def same_tables(published: DataFrame, configured: list[str], by: str = "publication") -> DataFrame:
    """Per publication whether it covers exactly the configured tables; it may be taken over only then."""
    want = F.array(*map(F.lit, sorted(configured))).cast("array<string>")
    return published.groupBy(by).agg(F.array_sort(F.collect_set("table_name")).alias("tables")).select(by, (F.col("tables") == F.array_sort(want)).alias("reusable"))


def secondary_objects(c: Catalog, side: str) -> DataFrame:
    """All of these as the rows that a readiness report compares."""
    from .reconcile import OBJECTS

    names = [x.split()[0] for x in OBJECTS.split(", ")]
    parts = [
        indexes(c).withColumn("category", F.lit("index")),
        constraints(c).withColumn("category", F.lit("constraint")),
        identities(c).withColumn("category", F.lit("sequence")),
        c.relations.select("table_name", F.col("owner").alias("name")).where("name is not null").withColumn("category", F.lit("owner")),
        grants(c).withColumnRenamed("grantee", "name").withColumn("category", F.lit("grant")),
        comments(c).select("table_name", F.coalesce("name", F.lit("(table)")).alias("name"), F.col("comment").alias("definition")).withColumn("category", F.lit("comment")),
    ]
    kinds = {x.split()[0]: x.split()[1] for x in OBJECTS.split(", ")}
    whole = [p.withColumn("side", F.lit(side)).select(*[F.col(n).cast(kinds[n]) if n in p.columns or n == "side" else F.lit(None).cast(kinds[n]).alias(n) for n in names]) for p in parts]
    out = whole[0]
    for w in whole[1:]:
        out = out.unionByName(w)
    return out
