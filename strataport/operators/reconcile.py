"""Reconciliation: counts, field-level comparison, sequences, preflight, readiness and cutover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import types as T
from ..plans.spec import TableSpec
from .project import apply_spec


def row_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per table: source_count, target_count, equal."""

    def side(i: int, name: str) -> DataFrame:
        each = [p[i].agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("table_name"), name) for t, p in pairs.items()]
        return reduce(DataFrame.unionByName, each)

    both = side(0, "source_count").join(side(1, "target_count"), "table_name", "full")
    return both.withColumn("equal", F.col("source_count").eqNullSafe(F.col("target_count")))


def hashed_sample(df: DataFrame, key: list[str], modulus: int, below: int) -> DataFrame:
    """The rows whose key's md5 falls in below / modulus: the same rows on every run and on both sides."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return df.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus < below)


def sample_fraction(estimated: int, size: int) -> float:
    """Share of rows to read for about ``size`` rows, thrice over: 1 where the table isn't larger."""
    return 1.0 if estimated <= size else round(min(max(size * 100.0 / estimated * 3, 0.01), 100.0), 6) / 100


def mismatches(source: DataFrame, target: DataFrame, spec: TableSpec, key: list[str]) -> DataFrame:
    """A row for each field that differs: key columns, column_name, kind (missing or differs). One join by key; values are
    compared in the target's types, nulls equal to nulls."""
    want, to = apply_spec(source, spec), spec.target_key(key)
    added = {a.name for a in spec.add_columns}
    columns = [c for c in want.columns if c not in to and c not in added]
    w, t = want.alias("w"), target.select("*", F.lit(True).alias("_here")).alias("t")
    both = w.join(t, reduce(lambda a, b: a & b, [F.col(f"w.{k}") == F.col(f"t.{k}") for k in to]), "left")
    fields = [F.when(
        F.col("t._here").isNotNull() & ~F.col(f"w.{c}").eqNullSafe(F.col(f"t.{c}")),
        F.struct(F.lit(c).alias("column_name"), F.lit("differs").alias("kind"))
    ) for c in columns]
    absent = F.when(F.col("t._here").isNull(), F.struct(F.lit(None).cast("string").alias("column_name"), F.lit("missing").alias("kind")))
    found = both.select(*[F.col(f"w.{k}").alias(k) for k in to], F.explode(F.array_compact(F.array(*fields, absent))).alias("m"))
    return found.select(*to, "m.column_name", "m.kind")


def sequence_plan(tables: dict[str, tuple[DataFrame, str, int]], buffer: int = 1_000) -> DataFrame:
    """Per table and its key column, with the source sequence's last value: max_key, last_value and target_value, the
    greater of both and a buffer."""
    each = [df.agg(F.coalesce(F.max(c).cast("long"), F.lit(0).cast("long")).alias("max_key")).select(
        F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "max_key", F.lit(last).cast("long").alias("last_value")
    ) for t, (df, c, last) in tables.items()]
    return reduce(DataFrame.unionByName, each).withColumn("target_value", F.greatest("last_value", "max_key") + F.lit(buffer).cast("long"))


def cutover_report(counts: DataFrame, sequences: DataFrame, lag: int | None = None) -> DataFrame:
    """Counts and sequences of each table, passed (all counts equal) and lag_drained (null if nobody looked), over all
    tables."""
    everything = Window.partitionBy(F.lit(0))  # a row for each table
    return counts.join(
        sequences.select("table_name", "target_value"), "table_name", "left"
    ).withColumns({"passed": F.every("equal").over(everything), "lag_drained": F.lit(None if lag is None else lag == 0).cast("boolean")})


# --- preflight ---------------------------------------------------------------------------------------------------------


def preflight(spark: SparkSession, facts: list[dict], setting: dict | None = None) -> DataFrame:
    """Checks in order: (ord, table_name, label, status, detail) for tables of which ``facts`` has: spec, exists, key,
    identity (d, f, i, n), target_exists, force, columns (name to internal type), failing (column to count), rows.
    ``setting``: slot, slot_exists, resume, log, log_readable, batch_size, rows_per_second."""
    rows: list[tuple] = []

    def add(table: str, label: str, status: str, detail: str = "") -> None:
        rows.append((len(rows), table, label, status, detail))

    if setting:
        add("", "change log", "info" if setting["log"] is None else "pass" if setting["log_readable"] else "fail", setting["log"] or "none: a copy without changes")
        good = setting["slot_exists"] == setting["resume"]
        add("", "slot", "pass" if good else "fail", f"{setting['slot']} {'exists' if setting['slot_exists'] else 'is free'}")
    for f in facts:
        spec: TableSpec = f["spec"]
        t = spec.name
        add(t, "table", "pass" if f.get("exists", True) else "fail")
        if not f.get("exists", True):
            continue
        key = f.get("key") or []
        add(t, "primary key", "pass" if key else "fail", ", ".join(key))
        dropped = [k for k in key if k in spec.drops]
        add(t, "primary key kept", "fail" if dropped else "pass", ", ".join(dropped))
        identity = f.get("identity", "d")
        add(t, "replica identity", "pass" if identity in ("d", "f", "i") else "fail" if identity == "n" else "warn", identity)
        add(t, "target table", "pass" if not f.get("target_exists") else "warn" if f.get("force") else "fail")
        unknown = [c for c in spec.columns if c not in f["columns"]]
        add(t, "spec columns", "fail" if unknown else "pass", ", ".join(unknown))
        for c, s in spec.columns.items():
            if s.drop or not s.type or c in unknown:
                continue
            safety, failing = T.cast_safety(f["columns"][c], s.type), (f.get("failing") or {}).get(c)
            warn = (f["columns"][c], T.internal(s.type)) in T.WARN_ONLY
            status = "fail" if safety == "unsupported" or (failing or 0) > 0 else "warn" if warn else "pass"
            add(t, f"cast {c}", status, safety if not failing else f"{failing} rows fail")
        for a in spec.add_columns:
            add(t, f"add {a.name}", "pass" if T.is_known(a.type) else "fail", a.type)
        if setting and f.get("rows") is not None:
            batches, minutes = copy_estimate(f["rows"], setting["batch_size"], setting["rows_per_second"])
            add(t, "copy", "info", f"{f['rows']} rows, {batches} pages, about {minutes if minutes < 60 else round(minutes / 60, 1)} {'min' if minutes < 60 else 'h'}")
    return spark.createDataFrame(rows, "ord int, table_name string, label string, status string, detail string")


def copy_estimate(rows: int, batch_size: int, rows_per_second: int | None = None) -> tuple[int, float]:
    """Pages and minutes (one decimal) that a copy takes: at its rate limit, else at 100 pages a minute."""
    batches = -(-rows // batch_size)
    return batches, round(rows / (60 * rows_per_second), 1) if rows_per_second else (batches + 5) // 10 / 10


def preflight_summary(items: DataFrame) -> DataFrame:
    """Counts by status, and passed: nothing failed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return items.agg(*map(count, ("pass", "warn", "fail", "info")), (F.count_if(F.col("status") == "fail") == 0).alias("passed"))


# --- readiness ---------------------------------------------------------------------------------------------------------

OBJECTS = "side string, table_name string, category string, name string, kind string, definition string, is_unique boolean, columns array<string>, privileges array<string>"


def objects(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Secondary objects of both sides: indexes, constraints (kind f, u, c), sequences, owners, grants and comments."""
    names = [x.split()[0] for x in OBJECTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], OBJECTS)


def grouped_grants(acl: DataFrame) -> DataFrame:
    """Per table and grantee the privileges in order; those of the owner are left out, grantee 0 is PUBLIC."""
    who = F.when(F.col("grantee") == "0", "PUBLIC").otherwise(F.col("grantee"))
    return acl.where("grantee != owner").groupBy("table_name", who.alias("grantee")).agg(F.sort_array(F.collect_set("privilege")).alias("privileges"))


def index_columns(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Per index its column names in key order; expressions (attnum 0) are left out."""
    each = keys.select("table_name", "index_name", F.posexplode("attnums").alias("pos", "attnum")).where("attnum != 0")
    named = each.join(columns.select("table_name", "attnum", "name"), ["table_name", "attnum"])
    ordered = named.groupBy("table_name", "index_name").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("c"))
    return ordered.select("table_name", "index_name", F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("columns"))


def readiness(both: DataFrame, spec: TableSpec) -> DataFrame:
    """Per source object: category, name, status (missing, present, needs_review, info), detail and DDL to make it."""
    table, none = X.quote_table(F.col("table_name")), F.lit(None).cast("string")
    src, tgt = both.where("side = 'source'"), both.where("side = 'target'")
    here = tgt.select(
        F.col("table_name").alias("t_table"), F.col("category").alias("t_category"), F.col("name").alias("t_name"),
        F.col("definition").alias("t_definition"), F.col("privileges").alias("t_privileges"), F.lit(True).alias("here")
    )
    drops, renames = F.array(*map(F.lit, spec.drops)).cast("array<string>"), spec.renames
    renamed = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else F.lit(None).cast("map<string,string>")
    named = F.when((F.col("category") == "comment") & renamed[F.col("name")].isNotNull(), renamed[F.col("name")]).otherwise(F.col("name"))
    src = src.withColumn(
        "name", F.when(F.col("category") == "comment", named).otherwise(F.col("name"))
    ).where(~((F.col("category") == "comment") & F.array_contains(drops, F.col("name"))))
    # an owner is compared by name, all else is found by it
    out = src.join(here, (F.col("table_name") == F.col("t_table")) & (F.col("category") == F.col("t_category")) & (F.col("name") == F.col("t_name")), "left")
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    lost = F.array_intersect(columns, drops)
    moved = F.filter(columns, lambda c: renamed[c].isNotNull())
    pairs = F.array_join(F.transform(moved, lambda c: F.concat(c, F.lit("->"), renamed[c])), ", ")
    review = F.when(
        F.size(lost) > 0, F.concat(F.lit("needs "), F.array_join(lost, ", "), F.lit(", which the spec drops"))
    ).when(F.size(moved) > 0, F.concat(F.lit("rewrite for "), pairs))
    kind = F.when(F.col("kind") == "f", "foreign key").when(F.col("kind") == "u", "unique constraint").when(F.col("kind") == "c", "check constraint")
    constraint = F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD CONSTRAINT "), X.quote_ident(F.col("name")), F.lit(" "), F.col("definition"), F.lit(";"))
    index = F.concat(X.concurrently(F.col("definition")), F.lit(";"))
    held = F.size(F.array_except(F.coalesce("privileges", F.array().cast("array<string>")), F.coalesce("t_privileges", F.array().cast("array<string>")))) == 0
    to = F.when(F.col("name") == "PUBLIC", "PUBLIC").otherwise(X.quote_ident(F.col("name")))
    listed = F.array_join("privileges", ", ")
    grant = F.concat(F.lit("GRANT "), listed, F.lit(" ON "), table, F.lit(" TO "), to, F.lit(";"))
    same = F.col("definition").eqNullSafe(F.col("t_definition"))
    on = F.when(F.col("name") == "(table)", F.concat(F.lit("TABLE "), table)).otherwise(F.concat(F.lit("COLUMN "), table, F.lit("."), X.quote_ident(F.col("name"))))
    comment = F.concat(F.lit("COMMENT ON "), on, F.lit(" IS "), X.quote_literal(F.col("definition")), F.lit(";"))
    owner = F.concat(F.lit("ALTER TABLE "), table, F.lit(" OWNER TO "), X.quote_ident(F.col("name")), F.lit(";"))
    c, present = F.col("category"), F.coalesce("here", F.lit(False))
    reviewed = c.isin("index", "constraint") & review.isNotNull()
    status = (
        F.when(c == "sequence", "info").when((c == "grant") & present & held, "present").when(c == "grant", "missing").when(
            (c == "comment") & present & same, "present"
        ).when(c == "comment", "missing")
        .when(present, "present").when(reviewed, "needs_review").otherwise("missing")
    )
    out = out.withColumn("status", status)
    s = F.col("status")
    ddl = F.when(s.isin("present", "info"), none).when(
        s == "needs_review",
        F.concat(F.lit("-- "), review, F.lit("\n-- "), F.when(c == "index", F.concat(F.col("definition"), F.lit(";"))).otherwise(constraint))
    ).when(c == "index", index).when(
        c == "constraint", F.concat(constraint, F.when(F.col("kind") == "f", "  -- once the tables it points to are there").otherwise(""))
    ).when(c == "owner", owner).when(c == "grant", grant).when(c == "comment", comment)
    detail = (
        F.when(c == "sequence", F.concat(F.col("kind"), F.lit(": cutover sets it"))).when(c == "grant", listed).when(c == "comment", X.shortened(F.col("definition")))
        .when(c == "owner", F.concat(F.lit("role "), F.col("name"))).when(s == "present", "found by name").when(s == "needs_review", review)
        .when(c == "index", F.when(F.col("is_unique"), "unique index").otherwise("index")).otherwise(kind)
    )
    return out.select("table_name", "category", "name", "status", detail.alias("detail"), ddl.alias("ddl"))
