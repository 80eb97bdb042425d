"""Identifier quoting, log positions and the rendering of sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved words that are always quoted.
RESERVED = """
all analyse analyze and any array as asc asymmetric authorization between binary both case cast check collate column
constraint create cross current_catalog current_date current_role current_time current_timestamp current_user default
deferrable desc distinct do else end except false fetch for foreign from grant group having ilike in initially inner
intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null offset
on only or order outer overlaps placing primary references returning right select session_user similar some symmetric
table tablesample then to trailing true union unique user using variadic verbose when where window with
""".split()


def quote_ident(name: Column) -> Column:
    """Bare where it is a plain lower-case word and not reserved, else double-quoted."""
    plain = name.rlike(r"^[a-z_][a-z0-9_$]*\z") & ~name.isin(RESERVED)
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_table(name: Column, schema: str = "public") -> Column:
    return F.concat(quote_ident(F.lit(schema)), F.lit("."), quote_ident(name))


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def shortened(text: Column, most: int = 40) -> Column:
    """At most ``most`` characters, the last three as dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def concurrently(definition: Column) -> Column:
    """An index definition that doesn't lock out writes."""
    return F.regexp_replace(definition, r"^CREATE (UNIQUE )?INDEX ", "CREATE $1INDEX CONCURRENTLY ")


def display_type(formatted: Column) -> Column:
    """Short names for verbose types; each is replaced once."""
    for long, short in (
        ("character varying", "varchar"), ("character\\(", "char("), ("timestamp without time zone", "timestamp"),
        ("timestamp with time zone", "timestamptz"), ("time without time zone", "time"), ("time with time zone", "timetz"),
    ):
        formatted = F.regexp_replace(formatted, f"^(.*?){long}", f"$1{short}")
    return formatted


def lsn_text(lsn: Column) -> Column:
    """A log position as two hexadecimal halves."""
    return F.format_string("%X/%X", F.shiftrightunsigned(lsn, 32), lsn.bitwiseAND(F.lit(0xFFFFFFFF)))


def lsn_number(text: Column) -> Column:
    """A log position from its text, null where it isn't one."""
    half = lambda i: F.conv(F.regexp_extract(text, r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})\z", i), 16, 10).cast("long")
    return F.when(text.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\z"), F.shiftleft(half(1), 32) + half(2))


def bytes_text(n: Column) -> Column:
    def of(unit: float, digits: int, name: str) -> Column:
        return F.format_string(f"%.{digits}f {name}", F.round(n / unit, digits))

    return F.when(
        n < 1024, F.concat(n.cast("string"), F.lit(" B"))
    ).when(n < 1 << 20, of(1024.0, 1, "KB")).when(n < 1 << 30, of(float(1 << 20), 1, "MB")).otherwise(of(float(1 << 30), 2, "GB"))


def duration_text(seconds: Column) -> Column:
    whole = lambda x: F.ceil(x).cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(
        seconds < 3600, F.concat(whole(seconds / 60.0), F.lit("m"))
    ).otherwise(F.concat(whole(seconds / 3600.0), F.lit("h")))


def count_text(n: Column) -> Column:
    """A whole number with its thousands apart: 1,234,567."""
    return F.format_number(n, 0)


def scale_text(size: Column) -> Column:
    """Bytes as MB or, from 1024 MB on, as GB, with a decimal."""
    mb = size / 1048576.0
    return F.when(mb >= 1024, F.concat(F.format_string("%.1f", F.round(mb / 1024.0, 1)), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.1f", F.round(mb, 1)), F.lit(" MB")))


def redacted(value: Column) -> Column:
    """A value as a report shows it: NULL, or at most 60 characters."""
    return F.when(value.isNull(), "NULL").when(F.length(value) > 60, F.concat(F.substring(value, 1, 57), F.lit("..."))).otherwise(value)


def listed(text: Column) -> Column:
    """Names separated by commas as an array; none in an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))
