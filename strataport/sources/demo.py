"""Seeded demo data: users, agents and listings of a property site, made in parallel from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import catalog
from ..plans.spec import TableSpec, table_spec

# The columns of the demo's three tables, in their order; the padding figures depend on them.
USERS = [
    ("id", "integer", False), ("is_admin", "boolean", False, "false"), ("email", "varchar(255)", False), ("first_name", "varchar(100)"),
    ("last_name", "varchar(100)"), ("created_at", "timestamp", False, "now()")
]
AGENTS = [
    ("id", "integer", False), ("user_id", "integer", False), ("license_number", "varchar(50)"), ("active", "boolean", False, "true"),
    ("commission_rate", "numeric(5,4)", False, "0.0300"), ("hired_at", "date"), ("created_at", "timestamp", False, "now()")
]
LISTINGS = [
    ("id", "integer", False), ("active", "boolean", False, "true"), ("list_price", "numeric(10,2)", False), ("bedrooms", "smallint"), ("has_garage", "boolean", False, "false"),
    (
        "listed_at", "timestamp", False, "now()"
    ), ("square_feet", "integer"), ("is_featured", "boolean", False, "false"), ("price_per_sqft", "real"), ("longitude", "double precision"),
    ("year_built", "smallint"), ("created_at", "timestamp", False, "now()"), ("bathrooms", "smallint"), (
        "is_new_construction", "boolean", False, "false"
    ), ("latitude", "double precision"),
    ("description", "text"), ("address_line1", "varchar(255)", False), ("city", "varchar(100)", False), ("state_code", "char(2)", False), ("zip_code", "varchar(10)"), ("agent_id", "integer"),
]


def catalogs(spark: SparkSession) -> DataFrame:
    return catalog(spark, "users", USERS).union(catalog(spark, "agents", AGENTS)).union(catalog(spark, "listings", LISTINGS))


def listings_spec() -> TableSpec:
    return table_spec({
        "name": "listings", "optimize_column_order": True,
        "columns": {
            "id": {"type": "bigint"}, "agent_id": {"type": "bigint"}, "list_price": {"type": "numeric(18,4)", "rename": "list_price_precise"},
            "listed_at": {"type": "timestamptz"}, "created_at": {"type": "timestamptz"}
        },
        "add_columns": [{"name": "updated_at", "type": "timestamptz", "default": "now()"}],
    })


def counts(listings: int) -> tuple[int, int]:
    """Users and agents that go with so many listings."""
    return min(max(listings // 10, 50), 500), min(max(listings // 20, 10), 100)


def _pick(seed: int, what: str, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(len(values))) + 1).cast("int"))


def _number(seed: int, what: str, low: int, high: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(high - low + 1)) + low


def users(spark: SparkSession, listings: int, seed: int = 42) -> DataFrame:
    ids = spark.range(1, counts(listings)[0] + 1).withColumn("id", F.col("id").cast("int"))
    return ids.select(
        "id", (_number(seed, "admin", 1, 20) == 1).alias("is_admin"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"),
        _pick(seed, "first", ["Ana", "Ben", "Chi", "Dee", "Eli"]).alias("first_name"),
        _pick(seed, "last", ["Ash", "Birch", "Cedar", "Elm"]).alias("last_name")
    )


def agents(spark: SparkSession, listings: int, seed: int = 42) -> DataFrame:
    n_users, n = counts(listings)
    ids = spark.range(1, n + 1).withColumn("id", F.col("id").cast("int"))
    return ids.select(
        "id", _number(seed, "user", 1, n_users).cast("int").alias("user_id"),
        F.format_string("LIC-%06d", _number(seed, "licence", 1, 999_999)).alias("license_number"),
        (_number(seed, "active", 1, 10) > 1).alias("active"), (_number(seed, "rate", 200, 400) / 10_000).cast("decimal(5,4)").alias("commission_rate")
    )


def listings(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    ids = spark.range(1, n + 1).withColumn("id", F.col("id").cast("int"))
    feet = _number(seed, "feet", 400, 5000)
    price = (_number(seed, "price", 5_000_000, 200_000_000) / 100).cast("decimal(10,2)")
    return ids.select(
        "id", (_number(seed, "active", 1, 10) > 2).alias("active"), price.alias("list_price"), _number(seed, "beds", 1, 6).cast("smallint").alias("bedrooms"), feet.cast("int").alias("square_feet"),
        (price.cast("double") / feet).cast("float").alias("price_per_sqft"), _pick(
            seed, "city", ["Arden", "Brook", "Cove", "Dale"]
        ).alias("city"), _pick(seed, "state", ["CA", "NY", "TX", "WA"]).alias("state_code"),
        _number(seed, "agent", 1, counts(n)[1]).cast("int").alias("agent_id"),
    )
