"""Type registry, cast safety and the Spark type of each column type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alignment and size of the types of fixed length, with the names that they go by.
FIXED = {
    "bigint": (8, 8), "int8": (8, 8), "double precision": (8, 8), "float8": (8, 8), "timestamp": (8, 8), "timestamp without time zone": (8, 8),
    "timestamptz": (8, 8), "timestamp with time zone": (8, 8), "interval": (8, 16), "money": (8, 8),
    "integer": (4, 4), "int4": (4, 4), "int": (4, 4), "real": (4, 4), "float4": (4, 4), "date": (4, 4), "time": (4, 8), "time without time zone": (4, 8), "oid": (4, 4),
    "smallint": (2, 2), "int2": (2, 2), "boolean": (1, 1), "bool": (1, 1), '"char"': (1, 1),
}

# Internal name of each type that a spec can name, besides varchar and char with their lengths.
INTERNAL = {
    "bigint": "int8", "int8": "int8", "integer": "int4", "int4": "int4", "int": "int4", "smallint": "int2", "int2": "int2", "real": "float4", "float4": "float4",
    "double precision": "float8", "float8": "float8", "boolean": "bool", "bool": "bool", "text": "text", "date": "date", "timestamp": "timestamp",
    "timestamp without time zone": "timestamp", "timestamptz": "timestamptz", "timestamp with time zone": "timestamptz", "time": "time", "time without time zone": "time",
    "timetz": "timetz", "time with time zone": "timetz", "numeric": "numeric", "decimal": "numeric", "money": "money", "uuid": "uuid", "json": "json", "jsonb": "jsonb",
    "bytea": "bytea", "oid": "oid",
}

# Casts that lose nothing.
ALWAYS_SAFE = {
    "int2": "int4 int8 float4 float8 numeric", "int4": "int8 float4 float8 numeric", "int8": "float8 numeric", "float4": "float8 numeric", "float8": "numeric",
    "date": "timestamp timestamptz", "timestamp": "timestamptz", "bpchar": "text varchar", "varchar": "text", "name": "text", "json": "jsonb",
}

# Casts that may lose something and must be checked.
VALIDATED = {
    "int8": "int4 int2", "int4": "int2", "float8": "float4", "timestamptz": "timestamp", "numeric": "int8 int4", "text": "varchar bpchar", "varchar": "varchar bpchar", "bpchar": "varchar bpchar",
}
WARN_ONLY = {("float8", "float4"), ("timestamptz", "timestamp")}
RANGE = {"int2": (-(1 << 15), (1 << 15) - 1), "int4": (-(1 << 31), (1 << 31) - 1), "int8": (-(1 << 63), (1 << 63) - 1)}

SPARK = {
    "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "bool": "boolean", "text": "string", "varchar": "string", "bpchar": "string",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "time": "string", "timetz": "string", "money": "decimal(19,2)", "uuid": "string", "json": "string",
    "jsonb": "string", "bytea": "binary", "oid": "bigint", "name": "string",
}


@dataclass(frozen=True)
class Physical:
    """Alignment and size; size is None for variable length."""

    alignment: int
    size: int | None


def physical(spelling: str) -> Physical:
    """Never fails: what isn't of fixed length, known or not, is variable and aligned to 4."""
    found = FIXED.get(spelling.strip().lower())
    return Physical(*found) if found else Physical(4, None)


def internal(spelling: str) -> str:
    """Internal name of a type as a spec spells it."""
    low = spelling.strip().lower()
    base = low.split("(")[0].strip()
    if base in ("varchar", "character varying"):
        return "varchar"
    if base in ("char", "character", "bpchar"):
        return "bpchar"
    return INTERNAL.get(low) or INTERNAL.get(base) or base


def length(spelling: str) -> int | None:
    found = re.search(r"\((\d+)", spelling)
    return int(found[1]) if found else None


def is_known(spelling: str) -> bool:
    return internal(spelling) in {*INTERNAL.values(), "varchar", "bpchar"}


def cast_safety(source: str, target: str) -> str:
    """no_op, always_safe, validated or unsupported, for an internal source type and a target as a spec spells it."""
    to = internal(target)
    if source == to:
        return "validated" if to in ("bpchar", "varchar") and length(target) else "no_op"
    if to in ALWAYS_SAFE.get(source, "").split():
        return "always_safe"
    if source in ("bpchar", "varchar") and to in ("bpchar", "varchar"):
        return "validated" if length(target) else "always_safe"
    return "validated" if to in VALIDATED.get(source, "").split() else "unsupported"


def spark_type(spelling: str) -> str:
    """The Spark type of a column type."""
    to = internal(spelling)
    if to == "numeric":
        found = re.search(r"\((\d+)\s*(?:,\s*(\d+))?", spelling)
        return f"decimal({found[1]},{found[2] or 0})" if found else "decimal(38,18)"
    return SPARK.get(to, "string")


def cast_column(c: Column, source: str, target: str) -> Column:
    """The cast of a column of an internal source type: padding blanks of char go, and a real reaches numeric by its
    shortest decimal form."""
    to = internal(target)
    if source == "bpchar" and to in ("text", "varchar"):
        return F.rtrim(c)
    if source in ("float4", "float8") and to == "numeric":
        c = c.cast("string")
    return c.cast(spark_type(target))


def failing(c: Column, source: str, target: str) -> Column | None:
    """Rows that the cast would break; None where no row can be told. Nulls never fail."""
    to = internal(target)
    if to in ("varchar", "bpchar"):
        n = length(target)
        return F.length(c) > n if n else F.lit(False)
    if source.startswith("int") and to in RANGE:
        return ~c.between(*RANGE[to])
    if source == "numeric" and to in RANGE:
        low, high = RANGE[to]
        return (c != F.floor(c)) | (F.floor(c) < F.lit(low)) | (F.floor(c) > F.lit(high))
    return None


def of_spark(kind: str) -> str:
    """Internal name of a Spark type."""
    known = {
        "smallint": "int2", "int": "int4", "bigint": "int8", "float": "float4", "double": "float8", "boolean": "bool", "string": "text",
        "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "binary": "bytea"
    }
    return "numeric" if kind.startswith("decimal") else known.get(kind, kind)


def matrix(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """The class of each cast."""
    return spark.createDataFrame([(a, b, cast_safety(a, b)) for a, b in pairs], "source_type string, target_type string, safety string")
