"""The registered queries over the shared tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import types as T
from ..operators import catalogs as K
from ..operators import changelog as C
from ..operators import changes as H
from ..operators import monitor as M
from ..operators import paging as P
from ..operators import reconcile as R
from ..operators import schema as S
from ..operators.project import apply_spec, validate
from ..sources import demo, wal
from .spec import TableSpec, table_spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


ORDERS = table_spec({
    "name": "orders",
    "columns": {
        "o_custkey": {"type": "integer"}, "o_totalprice": {"type": "numeric(18,4)", "rename": "total_price"}, "o_orderstatus": {"rename": "status"},
        "o_orderpriority": {"type": "varchar(15)"}
    },
    "add_columns": [{"name": "migrated", "type": "boolean", "default": "false"}]
})
CUSTOMER = table_spec({"name": "customer", "columns": {"c_acctbal": {"type": "numeric(12,2)"}, "c_mktsegment": {"drop": True}}})
PART = table_spec({"name": "part", "optimize_column_order": True, "columns": {"p_size": {"type": "bigint"}, "p_retailprice": {"type": "real"}}})


# --- projections -------------------------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey::INTEGER AS o_custkey, o_orderstatus AS status, o_totalprice::DECIMAL(18,4)::DOUBLE AS total_price, o_orderdate, o_orderpriority, false AS migrated FROM orders")
def spec_project_orders(spark, d):
    return _double(apply_spec(_t(spark, d, "orders"), ORDERS), "total_price")


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(12,2)::DOUBLE AS c_acctbal FROM customer")
def spec_drop_customer(spark, d):
    return _double(apply_spec(_t(spark, d, "customer"), CUSTOMER), "c_acctbal")


@_query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice::REAL::DOUBLE AS p_retailprice, p_name, p_brand, p_type FROM part")
def spec_reorder_part(spark, d):
    df = _t(spark, d, "part")
    order = [r.name for r in S.layout(S.target_catalog(S.catalog_of(df, "part"), PART), optimal=True).orderBy("pos").collect()]  # a row for each column
    return _double(apply_spec(df, PART, order), "p_retailprice")


@_query("SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS as_bigint, l_linenumber::DOUBLE AS as_double, l_quantity::DECIMAL(18,4)::DOUBLE AS as_numeric FROM lineitem")
def cast_widen_suite(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", T.cast_column(n, "int4", "bigint").alias("as_bigint"),
        T.cast_column(n, "int4", "double precision").alias("as_double"),
        T.cast_column(q, "float8", "numeric(18,4)").cast("double").alias("as_numeric")
    )


@_query("SELECT o_orderkey, TRY_CAST(o_orderkey * 200000 AS INTEGER)::DOUBLE AS narrowed FROM orders")
def try_cast_lossy(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 200_000).try_cast("int").cast("double").alias("narrowed"))


# --- pages -------------------------------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def keyset_first_page(spark, d):
    return P.page(_t(spark, d, "orders"), ["o_orderkey"], 1000, columns=["o_orderkey", "o_custkey", "o_totalprice"])


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 999 ORDER BY o_orderkey LIMIT 1000")
def keyset_next_page(spark, d):
    return P.page(_t(spark, d, "orders"), ["o_orderkey"], 1000, [999], ["o_orderkey", "o_custkey", "o_totalprice"])


@_query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (5, 2) ORDER BY conv_id, turn LIMIT 50")
def keyset_composite_page(spark, d):
    return P.page(_t(spark, d, "conversations"), ["conv_id", "turn"], 50, [5, 2], ["conv_id", "turn", "role"])


_PAGES = "SELECT (rn - 1) // 1000 AS batch_no, min(o_orderkey) AS start_key, max(o_orderkey) AS end_key, count(*) AS row_count FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1"


def _pages(spark, d):
    return P.pages(_t(spark, d, "orders"), "o_orderkey", 1000)


@_query(f"SELECT *, sum(row_count) OVER (ORDER BY batch_no)::BIGINT AS rows_so_far FROM ({_PAGES})")
def keyset_pages_orders(spark, d):
    return _pages(spark, d)


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700")
def resume_remaining(spark, d):
    return _t(spark, d, "orders").where(P.after_key(["o_orderkey"], [700])).select("o_orderkey", "o_custkey")


_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey", "l_linenumber"]}


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, sum(n)::BIGINT AS row_count, count(*) AS key_count, sum(n) = count(*) AS is_unique FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)})" for t, k in _KEYS.items()))
def pk_uniqueness(spark, d):
    return reduce(DataFrame.unionByName, [P.key_uniqueness(_t(spark, d, t), k, t) for t, k in _KEYS.items()])


@_query(f"SELECT 'orders' AS table_name, count(*) AS batch_count, sum(row_count)::BIGINT AS total_rows, round(avg(row_count / (100 + batch_no % 7) * 1000), 1) AS avg_rows_per_sec, max_by(end_key, batch_no) AS last_key FROM ({_PAGES})")
def batch_stats(spark, d):
    return M.batch_stats(_pages(spark, d).withColumns({"table_name": F.lit("orders"), "duration_ms": 100 + F.col("batch_no") % 7}))


@_query(f"SELECT batch_no, greatest(row_count / 2000.0::DOUBLE - (100 + batch_no % 7) / 1000.0::DOUBLE, 0.0::DOUBLE) AS delay FROM ({_PAGES})")
def throttle_delay(spark, d):
    return _pages(spark, d).select("batch_no", P.throttle_delay(F.col("row_count"), 100 + F.col("batch_no") % 7, 2000).alias("delay"))


# --- cast safety -------------------------------------------------------------------------------------------------------


def _checks_sql(*checks: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, 'validated' AS safety, count(*) FILTER ({p})::BIGINT AS failing, {w} AS warn_only FROM {t}" for n, p, t, w in checks)


@_query(_checks_sql(
    ("key to integer", "o_orderkey * 200000 NOT BETWEEN -2147483648 AND 2147483647", "orders", "false"),
    ("key to smallint", "o_orderkey * 10 NOT BETWEEN -32768 AND 32767", "orders", "false")
))
def validate_bigint(spark, d):
    k = F.col("o_orderkey")
    return validate(_t(spark, d, "orders"), [("key to integer", k * 200_000, "int8", "integer"), ("key to smallint", k * 10, "int8", "smallint")])


@_query(_checks_sql(("quantity", "l_quantity <> floor(l_quantity)", "lineitem", "false"), ("price", "l_extendedprice <> floor(l_extendedprice)", "lineitem", "false")))
def validate_numeric_int(spark, d):
    as_numeric = lambda c: F.col(c).cast("decimal(18,2)")
    return validate(_t(spark, d, "lineitem"), [("quantity", as_numeric("l_quantity"), "numeric", "integer"), ("price", as_numeric("l_extendedprice"), "numeric", "bigint")])


@_query(_checks_sql(("priority 8", "length(o_orderpriority) > 8", "orders", "false"), ("priority 15", "length(o_orderpriority) > 15", "orders", "false")))
def validate_varchar_len(spark, d):
    c = F.col("o_orderpriority")
    return validate(_t(spark, d, "orders"), [("priority 8", c, "text", "varchar(8)"), ("priority 15", c, "varchar", "char(15)")])


@_query(
    "SELECT check_name, safety, failing::DOUBLE AS failing, warn_only FROM ("
    + _checks_sql(("key", "o_orderkey * 200000 NOT BETWEEN -2147483648 AND 2147483647", "orders", "false"), ("priority", "length(o_orderpriority) > 8", "orders", "false"))
    + " UNION ALL SELECT 'price', 'validated', NULL, true UNION ALL SELECT 'date', 'unsupported', NULL, false UNION ALL SELECT 'customer', 'always_safe', NULL, false)"
)
def validate_multi_one_pass(spark, d):
    return _double(validate(_t(spark, d, "orders"), [
        ("key", F.col("o_orderkey") * 200_000, "int8", "integer"), ("priority", F.col("o_orderpriority"), "text", "varchar(8)"), ("price", F.col("o_totalprice"), "float8", "real"),
        ("date", F.col("o_orderdate"), "timestamp", "integer"), ("customer", F.col("o_custkey"), "int8", "numeric"),
    ]), "failing")


# What the class of each cast must be.
_CASTS = {
    "always_safe": "int2>integer int2>bigint int2>real int2>float8 int2>numeric int4>bigint int4>real int4>float8 int4>numeric int8>float8 int8>decimal float4>float8 float4>numeric float8>numeric date>timestamp date>timestamptz timestamp>timestamptz bpchar>text bpchar>varchar bpchar>varchar(3) varchar>text name>text json>jsonb",
    "validated": "int8>integer int8>smallint int4>smallint float8>real timestamptz>timestamp numeric>bigint numeric>integer text>varchar(5) varchar>varchar(5) varchar>char(5) text>char(5) bpchar>char(5)",
    "no_op": "int4>int text>text numeric>numeric(10,2) varchar>varchar",
    "unsupported": "int8>real text>integer text>jsonb bool>integer uuid>text timestamp>date numeric>smallint",
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{p.split('>')[0]}', '{p.split('>')[1]}', '{c}')" for c, ps in _CASTS.items() for p in ps.split()) + ") AS m(source_type, target_type, safety)")
def cast_safety_matrix(spark, d):
    return T.matrix(spark, [tuple(p.split(">")) for ps in _CASTS.values() for p in ps.split()])


# --- merges ------------------------------------------------------------------------------------------------------------

_ODD = "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1"


def _pair(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return rows, rows.where("o_orderkey % 2 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@_query(f"{_ODD} UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def insert_absent_merge(spark, d):
    rows, target = _pair(spark, d)
    return P.insert_absent(target, rows, ["o_orderkey"])


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE o_totalprice + 1 END::DOUBLE AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0")
def upsert_merge(spark, d):
    rows, target = _pair(spark, d)
    return P.upsert(target, rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.5)), ["o_orderkey"])


@_query(f"SELECT * FROM ({_ODD}) WHERE o_orderkey % 5 <> 0")
def delete_by_key(spark, d):
    rows, target = _pair(spark, d)
    return P.delete_keys(target, rows.where("o_orderkey % 5 = 0"), ["o_orderkey"])


@_query(f"SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM ({_ODD})")
def partial_update(spark, d):
    rows, target = _pair(spark, d)
    changes = rows.where("o_orderkey % 7 = 0").select(
        "o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderstatus"),
        F.lit(False).alias("sent_o_totalprice"), F.lit(True).alias("sent_o_orderstatus")
    )
    return P.partial_update(target, changes, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


# --- change log --------------------------------------------------------------------------------------------------------


def _log(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "signup", "I").when(kind == "error", "D").when(kind == "view", "P").otherwise("U")
    return _t(spark, d, "events").select("user_id", F.col("event_id").alias("lsn"), op.alias("op"), "event_type", "value", "props")


_STATE = """
WITH e AS (SELECT *, event_id AS lsn FROM events),
d AS (SELECT user_id, max(lsn) AS ld FROM e WHERE event_type = 'error' GROUP BY user_id),
k AS (SELECT e.* FROM e LEFT JOIN d USING (user_id) WHERE event_type <> 'error' AND lsn > coalesce(ld, -1))
SELECT user_id, arg_max(value, lsn) AS value, arg_max(props, lsn) FILTER (event_type <> 'view') AS props
FROM k GROUP BY user_id HAVING count(*) FILTER (event_type <> 'view') > 0
"""


def _state(log, base=None):
    return C.compact(log, ["user_id"], ["value", "props"], sent={"value": F.lit(True), "props": F.lit(False)}, base=base)


@_query(_STATE)
def cdc_state_from_events(spark, d):
    return _state(_log(spark, d))


@_query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS ins, count(*) FILTER (event_type IN ('click', 'purchase', 'view')) AS upd, count(*) FILTER (event_type = 'error') AS del, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' WHEN 'view' THEN 'P' ELSE 'U' END AS last_op FROM events GROUP BY user_id")
def cdc_compact_counts(spark, d):
    return C.op_counts(_log(spark, d), ["user_id"])


@_query(_STATE)
def cdc_overlap_convergence(spark, d):
    """A copy taken half way, and the log from a quarter on: as if there had been no copy."""
    log = _log(spark, d)
    last = log.agg(F.max("lsn")).first()[0]
    copy = _state(log.where(F.col("lsn") <= last // 2))
    return _state(log.where(F.col("lsn") > last // 2), base=copy)


@_query("WITH t AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS txn FROM events) SELECT txn, count(*) AS n_events, max(event_id) FILTER (event_type = 'purchase') AS commit_lsn FROM t GROUP BY txn HAVING max(event_id) FILTER (event_type = 'purchase') IS NOT NULL")
def txn_assembly(spark, d):
    txns = C.transactions(_log(spark, d), F.col("event_type") == "purchase")
    return txns.groupBy("txn").agg(F.count(F.lit(1)).alias("n_events"), F.max("commit_lsn").alias("commit_lsn"))


@_query("SELECT event_id AS lsn, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS relation_version FROM events")
def relation_asof(spark, d):
    return _double(C.relation_as_of(_log(spark, d), "user_id", F.col("event_type") == "signup", F.col("lsn")).select("lsn", "user_id", "relation_version"), "relation_version")


@_query("SELECT event_type, count(*) AS n, event_type IN ('click', 'purchase') AS applied FROM events GROUP BY event_type")
def route_filter(spark, d):
    kept, skipped = C.route(_log(spark, d), ["click", "purchase"], "event_type")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("applied", F.lit(True)).union(skipped.withColumn("applied", F.lit(False)))


@_query("SELECT event_id AS lsn, event_type, max(event_id - event_id * 7 % 50) OVER (PARTITION BY event_type ORDER BY event_id) AS ack FROM events")
def ack_monotone(spark, d):
    return M.acknowledged(_log(spark, d), F.col("lsn") - F.col("lsn") * 7 % 50, "lsn", "event_type").select("lsn", "event_type", "ack")


@_query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def wal_decode_roundtrip(spark, d):
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    rows = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    )
    got = wal.decode(wal.encode_inserts(rows, 7, columns), [wal.Relation(7, "public", "orders", "d", tuple(columns))])
    return got.select(*[F.col("new")[i]["text"].alias(c) for i, c in enumerate(columns)])


USERS = table_spec({
    "name": "users", "columns": {"value": {"type": "numeric(18,4)", "rename": "amount"}, "user_id": {"rename": "uid"}},
    "add_columns": [{"name": "seen", "type": "boolean", "default": "true"}]
})
_USERS = wal.Relation(7, "public", "users", "d", ("user_id", "value", "props", "spare"))


def _binary_log(spark, d, relations=(_USERS,)):
    """The events as messages (seq, message), each a transaction of its own: signups insert, errors delete, clicks and
    purchases update, views send the value alone."""
    e = _t(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("k"), F.col("value").cast("decimal(18,4)").cast("string").alias("v"), "props")
    kind, none = F.col("event_type"), F.lit(None).cast("string")
    new = wal.tuple_of(wal.cell(F.col("k")), wal.cell(F.col("v")), wal.cell(F.col("props"), kind == "view"), wal.cell(none))
    old = wal.tuple_of(wal.cell(F.col("k")), wal.cell(none), wal.cell(none), wal.cell(none))
    row = F.when(kind == "signup", wal.insert_of(7, new)).when(kind == "error", wal.delete_of(7, old)).when(
        kind == "click", wal.update_of(7, new, old)
    ).otherwise(wal.update_of(7, new))
    at = F.col("event_id")
    each = F.array(wal.begin_of(at, F.lit(wal.EPOCH), at), row, wal.commit_of(at, at, F.lit(wal.EPOCH)))
    rows = e.select((at * 3 + 100).alias("first"), F.posexplode(each).alias("i", "message")).select((F.col("first") + F.col("i")).alias("seq"), "message")
    return spark.createDataFrame([(i, wal.relation(r)) for i, r in enumerate(relations)], "seq long, message binary").union(rows)


@_query(f"SELECT user_id AS uid, value::DECIMAL(18,4)::DOUBLE AS amount, props, true AS seen FROM ({_STATE.strip()}) ORDER BY 1")
def cdc_apply_spec(spark, d):
    """From bytes to the target's rows: decoded, routed, mapped by the spec, compacted."""
    source = _t(spark, d, "events").select("user_id", F.col("value").cast("decimal(18,4)").alias("value"), "props")
    plan = H.plan_of(USERS, source, ["user_id"])
    states = H.change_states(H.table_changes(wal.decode(_binary_log(spark, d)), plan), plan)
    return _double(C.living(states, plan.target_key, plan.values), "amount")


@_query("""
SELECT CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS kind, CASE event_type WHEN 'error' THEN 'K' WHEN 'click' THEN 'K' ELSE '' END AS old_kind, count(*) AS n, sum(event_id * 3 + 101)::BIGINT AS places,
  sum(CASE WHEN event_type = 'error' THEN 0 ELSE length(user_id::VARCHAR) + length(value::DECIMAL(18,4)::VARCHAR) + CASE WHEN event_type = 'view' THEN 0 ELSE coalesce(length(props), 0) END END)::BIGINT AS new_chars,
  sum(CASE WHEN event_type IN ('error', 'click') THEN length(user_id::VARCHAR) ELSE 0 END)::BIGINT AS old_chars, sum((event_type = 'view')::INT)::BIGINT AS unsent, 0::BIGINT AS positions
FROM events GROUP BY 1, 2
UNION ALL SELECT k, '', count(*), sum(event_id * 3 + 100 + i)::BIGINT, 0, 0, 0, sum(event_id)::BIGINT FROM events, (VALUES ('B', 0), ('C', 2)) AS v(k, i) GROUP BY 1
UNION ALL SELECT 'R', '', 1, 0, 0, 0, 0, 0""")
def wal_decode_all_kinds(spark, d):
    got = wal.decode(_binary_log(spark, d))
    chars = lambda c: F.sum(F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0))), F.lit(0))).cast("long")
    unsent = F.sum(F.coalesce(F.size(F.filter("new", lambda x: x["state"] == "u")), F.lit(0))).cast("long")
    return got.groupBy("kind", F.coalesce("old_kind", F.lit("")).alias("old_kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("places"), chars("new").alias("new_chars"), chars("old").alias("old_chars"),
        unsent.alias("unsent"), F.coalesce(F.sum("lsn"), F.lit(0)).alias("positions")
    )


@_query("SELECT 'public.orders' AS relation, true AS applied, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 'audit.orders', false, count(*) FILTER (o_orderkey % 3 <> 0) FROM orders")
def route_namespace(spark, d):
    """Two schemas with a table of one name: only the planned one's changes are applied."""
    relations = [wal.Relation(1, "public", "orders", "d", ("o_orderkey",)), wal.Relation(2, "audit", "orders", "d", ("o_orderkey",))]
    orders = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("r"),
        F.col("o_orderkey").cast("string").alias("k")
    )
    decoded = wal.decode(orders.select("seq", wal.insert_of(F.col("r"), wal.tuple_of(wal.cell(F.col("k")))).alias("message")), relations)
    plan = H.plan_of(TableSpec("orders"), _t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    name = F.concat_ws(".", "namespace", "name")
    _, skipped = C.route(decoded.withColumn("relation_name", name), ["public.orders"], "relation_name")
    ours = H.of_table(decoded, plan).groupBy(name.alias("relation")).agg(F.lit(True).alias("applied"), F.count(F.lit(1)).alias("n"))
    return ours.union(skipped.select("relation_name", F.lit(False), "skipped"))


@_query("SELECT max(event_id * 3 + 102) - max(event_id * 3 + 102) FILTER (event_id * 3 + 102 <= 12000) AS lag FROM events")
def slot_lag(spark, d):
    """The log's end less the position that was applied last."""
    log = _binary_log(spark, d)
    applied = log.where((F.substring("message", 1, 1) == F.lit(b"C")) & (F.col("seq") <= 12_000)).agg(F.max("seq").alias("applied"))
    return log.agg(F.max("seq").alias("end")).crossJoin(applied).select((F.col("end") - F.col("applied")).alias("lag"))  # one row each


@_query("SELECT event_id, upper(printf('%x', (event_id * 1048576) >> 32)) || '/' || upper(printf('%x', (event_id * 1048576) & 4294967295)) AS lsn_text, event_id * 1048576 AS lsn_number FROM events")
def lsn_format_parse(spark, d):
    df = _t(spark, d, "events").select("event_id", X.lsn_text(F.col("event_id") * 1_048_576).alias("lsn_text"))
    return df.withColumn("lsn_number", X.lsn_number(F.col("lsn_text")))


_READINGS = "SELECT event_id AS taken_at, event_id * 7919 % 1000003 AS bytes, event_type AS slot FROM events"


def _readings(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("taken_at"), (F.col("event_id") * 7919 % 1_000_003).alias("bytes"), F.col("event_type").alias("slot"))


@_query(f"""
WITH r AS ({_READINGS}),
w AS (SELECT *, first_value(bytes) OVER x AS b0, first_value(taken_at) OVER x AS a0, count(*) OVER x AS n FROM r WINDOW x AS (PARTITION BY slot ORDER BY taken_at ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
t AS (SELECT taken_at, bytes, slot, CASE WHEN n >= 2 AND taken_at > a0 THEN (bytes - b0)::DOUBLE / (taken_at - a0)::DOUBLE END AS trend FROM w)
SELECT *, CASE WHEN trend < 0 THEN floor(bytes / -trend) END::DOUBLE AS eta_seconds FROM t""")
def lag_trend_eta(spark, d):
    return _double(M.lag_trend(_readings(spark, d), slot="slot"), "eta_seconds")


@_query(f"SELECT taken_at, CASE WHEN bytes = 0 THEN 'caught_up' WHEN bytes <= 500000 THEN 'ready' ELSE 'behind' END AS readiness FROM ({_READINGS})")
def lag_ready(spark, d):
    return _readings(spark, d).select("taken_at", M.readiness(F.col("bytes"), 500_000).alias("readiness"))


@_query(_STATE)
def stream_events_available_now(spark, d):
    """The events, one file stream in whole transactions (each event its own), applied to a snapshot store."""
    from uuid import uuid4

    from ..sources.session import shared_dir
    from ..sources.store import SnapshotStore
    from ..streaming.apply import LogApplier, apply_available

    root = f"{shared_dir(spark)}/strataport/stream-{uuid4().hex}"
    store = SnapshotStore(spark, f"{root}/store")
    schema = _t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    kind = F.col("event_type")
    op = F.when(kind == "signup", "I").when(kind == "error", "D").when(kind == "view", "P").otherwise("U")
    log = stream.select("user_id", F.col("event_id").alias("lsn"), op.alias("op"), "value", "props", F.lit(True).alias("is_commit"))
    apply_available(log, LogApplier(store, "users", ["user_id"], ["value", "props"], sent={"value": F.lit(True), "props": F.lit(False)}), f"{root}/checkpoint")
    return store.read("users")


# --- schema ------------------------------------------------------------------------------------------------------------


def _values(*catalogs: tuple[str, list[tuple]]) -> str:
    """Catalog rows as SQL."""
    out = []
    for table, columns in catalogs:
        for i, (name, kind, *_) in enumerate(columns, 1):
            p = T.physical(kind)
            out.append(f"('{table}', {i}, '{name}', '{kind}', {p.alignment}, {p.size if p.size else 'NULL'})")
    return f"(VALUES {', '.join(out)}) AS c(table_name, attnum, name, kind, align, size)"


_DEMO = (("users", demo.USERS), ("agents", demo.AGENTS), ("listings", demo.LISTINGS))


def _fold(order: str, source: str = _values(*_DEMO)) -> str:
    return f"""
WITH RECURSIVE o AS (SELECT table_name, name, CASE WHEN size IS NULL THEN 4 ELSE align END AS a, coalesce(size, 4) AS s, row_number() OVER (PARTITION BY table_name ORDER BY {order}) AS pos FROM {source}),
f AS (SELECT table_name, pos, name, 0 AS off, 0 AS pad, s FROM o WHERE pos = 1
      UNION ALL SELECT o.table_name, o.pos, o.name, f.off + f.s + (o.a - (f.off + f.s) % o.a) % o.a, (o.a - (f.off + f.s) % o.a) % o.a, o.s FROM f JOIN o ON o.table_name = f.table_name AND o.pos = f.pos + 1)
SELECT table_name, pos::INTEGER AS pos, name, off::INTEGER AS "offset", pad::INTEGER AS padding, s::INTEGER AS size FROM f"""


_BEST = "size IS NULL, CASE WHEN size IS NULL THEN 0 ELSE -align END, CASE WHEN size IS NULL THEN 0 ELSE -size END, attnum"


def _padding(source: str = _values(*_DEMO)) -> str:
    side = lambda order, n: f"(SELECT table_name, sum(padding + size)::BIGINT AS {n}_bytes, sum(padding)::BIGINT AS {n}_padding FROM ({_fold(order, source)}) GROUP BY table_name)"
    return f"SELECT *, current_bytes - optimal_bytes AS saved_bytes, round((current_bytes - optimal_bytes) * 100.0::DOUBLE / current_bytes, 1) AS saved_pct, current_bytes = optimal_bytes AS already_optimal FROM {side('attnum', 'current')} JOIN {side(_BEST, 'optimal')} USING (table_name)"


@_query(_fold("attnum"))
def layout_current(spark, d):
    return S.layout(demo.catalogs(spark))


@_query(_fold(_BEST))
def layout_optimal(spark, d):
    return S.layout(demo.catalogs(spark), optimal=True)


@_query(_padding())
def padding_report(spark, d):
    return S.padding_report(demo.catalogs(spark))


_NEGATIVE = [("note", "text"), ("flag", "boolean")]


@_query(_padding(_values(("negative", _NEGATIVE))))
def padding_negative(spark, d):
    return S.padding_report(S.catalog(spark, "negative", _NEGATIVE))


_MIGRATED = [(
    ("list_price_precise" if n == "list_price" else n),
    {"id": "bigint", "agent_id": "bigint", "list_price": "numeric(18,4)", "listed_at": "timestamptz", "created_at": "timestamptz"}.get(n, k)
) for n, k, *_ in demo.LISTINGS] + [("updated_at", "timestamptz")]


@_query(f"""
WITH s AS (SELECT sum(padding + size)::BIGINT AS b, sum(padding)::BIGINT AS p FROM ({_fold('attnum', _values(('listings', demo.LISTINGS)))})),
t AS (SELECT sum(padding + size)::BIGINT AS b, sum(padding)::BIGINT AS p FROM ({_fold('attnum', _values(('listings', _MIGRATED)))}))
SELECT s.b AS source_bytes, s.p AS source_padding, t.b AS target_bytes, t.p AS target_padding, t.b - s.b AS delta_bytes, round(abs(t.b - s.b) * 100.0::DOUBLE / s.b, 1) AS delta_pct FROM s, t""")
def diff_padding_summary(spark, d):
    source = S.catalog(spark, "listings", demo.LISTINGS)
    both = S.padding_report(source.withColumn("table_name", F.lit("s")).unionByName(S.target_catalog(source, demo.listings_spec()).withColumn("table_name", F.lit("t"))))
    pick = lambda side, c: F.max(F.when(F.col("table_name") == side, F.col(c)))
    one = both.agg(*[pick(s, f"current_{c}").alias(f"{n}_{c}") for s, n in (("s", "source"), ("t", "target")) for c in ("bytes", "padding")])
    delta = F.col("target_bytes") - F.col("source_bytes")
    return one.withColumns({"delta_bytes": delta, "delta_pct": F.round(F.abs(delta) * 100.0 / F.col("source_bytes"), 1)})


_OLD = [("id", "integer"), ("active", "boolean"), ("list_price", "numeric(10,2)"), ("status_code", "varchar(10)"), ("legacy_notes", "text")]
_MULTI = TableSpec(
    "items",
    table_spec({
        "name": "items",
        "columns": {"id": {"type": "bigint"}, "list_price": {"type": "numeric(18,4)", "rename": "price"}, "status_code": {"rename": "status"}, "legacy_notes": {"drop": True}}
    }).columns,
    table_spec({"name": "items", "add_columns": [{"name": "updated_at", "type": "timestamptz"}]}).add_columns
)
_NEW = [("id", "bigint"), ("price", "numeric(18,4)"), ("status", "varchar(10)"), ("new_col", "text")]
_CHANGES = "(VALUES ('id', 'bigint', NULL, false), ('list_price', 'numeric(18,4)', 'price', false), ('status_code', NULL, 'status', false), ('legacy_notes', NULL, NULL, true)) AS k(name, to_type, to_name, gone)"
_STATUS = "CASE WHEN lower(s_type) <> lower(t_type) AND s_name <> t_name THEN 'type_and_renamed' WHEN lower(s_type) <> lower(t_type) THEN 'type_changed' WHEN s_name <> t_name THEN 'renamed' ELSE 'unchanged' END"
_OUT = 'table_name, ord::INTEGER AS ord, status, s_name AS source_name, s_type AS source_type, t_name AS target_name, t_type AS target_type'


@_query(f"""
WITH j AS (SELECT 'items' AS table_name, attnum AS ord, c.name AS s_name, kind AS s_type, coalesce(gone, false) AS gone, coalesce(to_name, c.name) AS t_name, coalesce(to_type, kind) AS t_type FROM {_values(('items', _OLD))} LEFT JOIN {_CHANGES} ON k.name = c.name),
r AS (SELECT table_name, ord, CASE WHEN gone THEN 'dropped' ELSE {_STATUS} END AS status, s_name, s_type, CASE WHEN NOT gone THEN t_name END AS t_name, CASE WHEN NOT gone THEN t_type END AS t_type FROM j
      UNION ALL SELECT 'items', 10001, 'added', NULL, NULL, 'updated_at', 'timestamptz')
SELECT {_OUT} FROM r""")
def schema_diff_synth(spark, d):
    return S.diff_synthesized(S.catalog(spark, "items", _OLD), _MULTI)


@_query(f"""
WITH s AS (SELECT attnum, c.name AS s_name, kind AS s_type, coalesce(to_name, c.name) AS link FROM {_values(('items', _OLD))} LEFT JOIN {_CHANGES} ON k.name = c.name),
t AS (SELECT attnum AS t_at, name AS t_name, kind AS t_type FROM {_values(('items', _NEW))}),
r AS (SELECT 'items' AS table_name, coalesce(attnum, t_at + 10000) AS ord, CASE WHEN s_name IS NULL THEN 'added' WHEN t_name IS NULL THEN 'dropped' ELSE {_STATUS} END AS status, s_name, s_type, t_name, t_type FROM s FULL JOIN t ON link = t_name)
SELECT {_OUT} FROM r""")
def schema_diff_live(spark, d):
    return S.diff_live(S.catalog(spark, "items", _OLD), S.catalog(spark, "items", _NEW), _MULTI)


_DDL = [
    ("id", "integer", False, "nextval('x')"), ("order", "character varying(20)", False), ("MyCol", "numeric(10,2)", True),
    ("created_at", "timestamp without time zone", False, "now()")
]


@_query("""
SELECT 'items' AS table_name, pos::INTEGER AS pos, line FROM (VALUES
(1, '  id          integer        NOT NULL'), (2, '  "order"     varchar(20)    NOT NULL'), (3, '  "MyCol"     numeric(10,2)'),
(4, '  created_at  timestamp      NOT NULL  DEFAULT now()'), (5, '  PRIMARY KEY (id, "order")')) AS v(pos, line)""")
def ddl_columns(spark, d):
    return S.ddl_lines(S.catalog(spark, "items", _DDL), ["id", "order"])


_NAMES = ["plain", "order", "MixedCase", 'in"side', "with space", "_x$1", "9lives", ""]


@_query("""
SELECT * FROM (VALUES ('plain', 'plain'), ('order', '"order"'), ('MixedCase', '"MixedCase"'), ('in"side', '"in""side"'), ('with space', '"with space"'), ('_x$1', '_x$1'), ('9lives', '"9lives"'), ('', '""')) AS v(name, quoted)""")
def quote_ident_suite(spark, d):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").withColumn("quoted", X.quote_ident(F.col("name")))


@_query("""
SELECT event_id, printf('%,d', event_id * 7919) AS counted, CASE WHEN event_id % 7 = 0 THEN 'NULL' WHEN length(repeat(event_type, 1 + event_id % 20)) > 60 THEN left(repeat(event_type, 1 + event_id % 20), 57) || '...' ELSE repeat(event_type, 1 + event_id % 20) END AS shown,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 3 END AS names FROM events""")
def report_texts(spark, d):
    """Counts, values and lists as reports show them."""
    e, i = _t(spark, d, "events"), F.col("event_id")
    value = F.when(i % 7 != 0, F.expr("repeat(event_type, cast(1 + event_id % 20 as int))"))
    names = F.when(i % 3 == 0, "").otherwise(F.expr("substring(repeat('a,', cast(1 + event_id % 3 as int)), 1, cast(1 + 2 * (event_id % 3) as int))"))
    return e.select("event_id", X.count_text(i * 7919).alias("counted"), X.redacted(value).alias("shown"), F.size(X.listed(names)).alias("names"))


# --- reconciliation ----------------------------------------------------------------------------------------------------


def _copied(spark, d):
    """A source and a target in which every 97th row's status is wrong and every 1009th is missing."""
    source = _t(spark, d, "orders")
    target = apply_spec(source, ORDERS).where("o_orderkey % 1009 <> 0")
    return source, target.withColumn("status", F.when(F.col("o_orderkey") % 97 == 0, "?").otherwise(F.col("status")))


@_query("SELECT 'orders' AS table_name, count(*) AS source_count, count(*) FILTER (o_orderkey % 1009 <> 0) AS target_count, count(*) = count(*) FILTER (o_orderkey % 1009 <> 0) AS equal FROM orders")
def verify_counts(spark, d):
    return R.row_counts({"orders": _copied(spark, d)})


_MISMATCH = "SELECT o_orderkey, CASE WHEN o_orderkey % 1009 <> 0 THEN 'status' END AS column_name, CASE WHEN o_orderkey % 1009 = 0 THEN 'missing' ELSE 'differs' END AS kind FROM orders WHERE o_orderkey % 1009 = 0 OR o_orderkey % 97 = 0"


@_query(_MISMATCH)
def verify_fields(spark, d):
    source, target = _copied(spark, d)
    return R.mismatches(source, target, ORDERS, ["o_orderkey"])


@_query(f"SELECT * FROM ({_MISMATCH}) WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000 < 300")
def verify_sample_hash(spark, d):
    source, target = _copied(spark, d)
    return R.mismatches(R.hashed_sample(source, ["o_orderkey"], 1000, 300), target, ORDERS, ["o_orderkey"])


_SEQUENCES = {"orders": ("o_orderkey", 10), "customer": ("c_custkey", 5_000_000), "part": ("p_partkey", 0)}


def _sequences(spark, d):
    return R.sequence_plan({t: (_t(spark, d, t), c, last) for t, (c, last) in _SEQUENCES.items()})


_SEQUENCE_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce(max({c}), 0) AS max_key, {last}::BIGINT AS last_value, greatest(coalesce(max({c}), 0), {last}) + 1000 AS target_value FROM {t}" for t, (c, last) in _SEQUENCES.items())


@_query(_SEQUENCE_SQL)
def sequence_plan(spark, d):
    return _sequences(spark, d)


@_query(f"""
WITH c AS (SELECT 'orders' AS table_name, count(*) AS source_count, count(*) FILTER (o_orderkey % 1009 <> 0) AS target_count FROM orders UNION ALL SELECT 'customer', count(*), count(*) FROM customer)
SELECT c.*, source_count = target_count AS equal, target_value, bool_and(source_count = target_count) OVER () AS passed, true AS lag_drained FROM c LEFT JOIN ({_SEQUENCE_SQL}) s USING (table_name)""")
def cutover_report(spark, d):
    customer = _t(spark, d, "customer")
    return R.cutover_report(R.row_counts({"orders": _copied(spark, d), "customer": (customer, customer)}), _sequences(spark, d), 0)


def _object_rows() -> list[dict]:
    s = lambda **x: {"side": "source", "table_name": "members", **x}
    return [
        s(category="index", name="members_email_idx", definition="CREATE INDEX members_email_idx ON public.members USING btree (email)", is_unique=False, columns=["email"]),
        s(
            category="index", name="members_status_idx", definition="CREATE UNIQUE INDEX members_status_idx ON public.members USING btree (status)",
            is_unique=True, columns=["status"]
        ),
        s(category="index", name="members_org_idx", definition="CREATE UNIQUE INDEX members_org_idx ON public.members USING btree (org_id)", is_unique=True, columns=["org_id"]),
        s(category="constraint", name="members_check", kind="c", definition="CHECK ((email <> ''::text))", columns=["email"]),
        s(category="constraint", name="members_org_fk", kind="f", definition="FOREIGN KEY (org_id) REFERENCES orgs(id)", columns=["org_id"]),
        s(category="constraint", name="members_old", kind="u", definition="UNIQUE (old)", columns=["old"]),
        s(category="sequence", name="id", kind="identity"),
        s(category="owner", name="admin"), s(category="grant", name="PUBLIC", privileges=["SELECT"]), s(category="grant", name="Writer", privileges=["INSERT", "UPDATE"]),
        s(
            category="comment", name="(table)", definition="it's members"
        ), s(category="comment", name="status", definition="x" * 41), s(category="comment", name="old", definition="gone"),
        {"side": "target", "table_name": "members", "category": "index", "name": "members_org_idx"}, {
            "side": "target", "table_name": "members", "category": "grant", "name": "Writer", "privileges": ["INSERT"]
        },
        {"side": "target", "table_name": "members", "category": "comment", "name": "(table)", "definition": "it's members"},
    ]


_MEMBERS = table_spec({"name": "members", "columns": {"status": {"rename": "state"}, "old": {"drop": True}, "org_id": {"type": "bigint"}}})


@_query("""
SELECT 'members' AS table_name, * FROM (VALUES
('index', 'members_email_idx', 'missing', 'index', 'CREATE INDEX CONCURRENTLY members_email_idx ON public.members USING btree (email);'),
('index', 'members_status_idx', 'needs_review', 'rewrite for status->state', '-- rewrite for status->state' || chr(10) || '-- CREATE UNIQUE INDEX members_status_idx ON public.members USING btree (status);'),
('index', 'members_org_idx', 'present', 'found by name', NULL),
('constraint', 'members_check', 'missing', 'check constraint', 'ALTER TABLE public.members ADD CONSTRAINT members_check CHECK ((email <> ''''::text));'),
('constraint', 'members_org_fk', 'missing', 'foreign key', 'ALTER TABLE public.members ADD CONSTRAINT members_org_fk FOREIGN KEY (org_id) REFERENCES orgs(id);  -- once the tables it points to are there'),
('constraint', 'members_old', 'needs_review', 'needs old, which the spec drops', '-- needs old, which the spec drops' || chr(10) || '-- ALTER TABLE public.members ADD CONSTRAINT members_old UNIQUE (old);'),
('sequence', 'id', 'info', 'identity: cutover sets it', NULL),
('owner', 'admin', 'missing', 'role admin', 'ALTER TABLE public.members OWNER TO admin;'),
('grant', 'PUBLIC', 'missing', 'SELECT', 'GRANT SELECT ON public.members TO PUBLIC;'),
('grant', 'Writer', 'missing', 'INSERT, UPDATE', 'GRANT INSERT, UPDATE ON public.members TO "Writer";'),
('comment', '(table)', 'present', 'it''s members', NULL),
('comment', 'state', 'missing', repeat('x', 37) || '...', 'COMMENT ON COLUMN public.members.state IS ''' || repeat('x', 41) || ''';')) AS v(category, name, status, detail, ddl)""")
def readiness_manifest(spark, d):
    return R.readiness(R.objects(spark, _object_rows()), _MEMBERS)


@_query("SELECT * FROM (VALUES ('t', 'PUBLIC', 'SELECT'), ('t', 'bob', 'INSERT,UPDATE')) AS v(table_name, grantee, privileges)")
def grants_grouped(spark, d):
    acl = spark.createDataFrame(
        [("t", "amy", "0", "SELECT"), ("t", "amy", "bob", "UPDATE"), ("t", "amy", "bob", "INSERT"), ("t", "amy", "amy", "DELETE")],
        "table_name string, owner string, grantee string, privilege string"
    )
    return R.grouped_grants(acl).withColumn("privileges", F.array_join("privileges", ","))


@_query("SELECT * FROM (VALUES ('users', 'by_name', 'last_name,first_name'), ('users', 'by_expr', 'email')) AS v(table_name, index_name, columns)")
def index_columns_ordered(spark, d):
    keys = spark.createDataFrame([("users", "by_name", [5, 4]), ("users", "by_expr", [0, 3])], "table_name string, index_name string, attnums array<int>")
    return R.index_columns(keys, S.catalog(spark, "users", demo.USERS))


@_query("SELECT 10::BIGINT AS pass_count, 1::BIGINT AS warn_count, 4::BIGINT AS fail_count, 0::BIGINT AS info_count, false AS passed")
def preflight_summary(spark, d):
    score = table_spec({"name": "a", "columns": {"id": {"type": "bigint"}, "score": {"type": "integer"}, "rating": {"type": "real"}}})
    lost = table_spec({"name": "b", "columns": {"id": {"drop": True}, "nope": {"type": "integer"}}})
    return R.preflight_summary(R.preflight(
        spark,
        [
            {"spec": score, "key": ["id"], "columns": {"id": "int4", "score": "int8", "rating": "float8"}, "failing": {"score": 1}},
            {"spec": lost, "key": ["id"], "columns": {"id": "int4"}, "identity": "n"}
        ]
    ))


# --- catalog scans -----------------------------------------------------------------------------------------------------


def _catalog(spark, d) -> K.Catalog:
    """A catalog with a table of five columns for each order."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("oid"), F.concat(F.lit("t"), "o_orderkey").alias("table_name"),
        F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("owner")
    )
    i, n = F.col("oid"), F.lit(None)
    grant = lambda who, p: F.struct(who.alias("grantee"), F.lit(p).alias("privilege"))
    acl = F.array(grant(F.col("owner"), "SELECT"), grant(F.lit("0"), "SELECT"), grant(F.lit("r1"), "UPDATE"), grant(F.lit("r1"), "INSERT"))
    relations = o.select(
        i, F.lit("public").alias("namespace"), "table_name", "owner", F.when(i % 2 == 0, "d").otherwise("f").alias("identity"),
        F.when(i % 5 == 0, -1).when(i % 7 != 0, i * 10).cast("long").alias("estimate"), F.when(i % 3 == 0, acl).alias("acl")
    )
    a = o.select(i.alias("relid"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attnum"))
    r, k = F.col("relid"), F.col("attnum")
    attributes = a.select(
        "relid", "attnum", F.concat(F.lit("c"), "attnum").alias("name"), ((k == 5) & (r % 2 == 0)).alias("dropped"),
        F.when((k == 1) & (r % 3 == 0), "a").otherwise("").alias("identity"),
        F.when((k == 2) & (r % 4 == 0), "nextval('s')").when(k == 3, "now()").alias("default"),
        F.when((k == 4) & (r % 6 == 0), "fourth").alias("comment")
    )
    x = o.select(i.alias("relid"), F.explode(F.array(*map(F.lit, range(3)))).alias("j"))
    j = F.col("j")
    indexes = x.select(
        (r * 10 + j).alias("indexrelid"), "relid", F.concat(F.lit("i"), "j").alias("name"), (j < 2).alias("is_unique"), (j == 0).alias("is_primary"),
        F.when(j == 0, F.array(F.lit(2), F.lit(1))).when(j == 1, F.array(F.lit(3))).otherwise(F.array(F.lit(4), F.lit(0), F.lit(1))).alias("attnums"),
        F.concat(F.lit("d"), "j").alias("definition")
    )
    constraints = x.select(
        "relid", F.concat(F.lit("k"), "j").alias("name"), F.element_at(F.array(*map(F.lit, "puc")), j + 1).alias("kind"),
        F.array(F.lit(3), F.lit(1)).alias("attnums"), F.when((j == 1) & (r % 2 == 0), r * 10 + 1).otherwise(0).alias("index_id"),
        F.concat(F.lit("def"), "j").alias("definition")
    )
    sequences = o.select(
        (i * 10 + 9).alias("oid"), F.concat(F.lit("s"), "oid").alias("name"), i.alias("relid"), F.lit(1).alias("attnum"),
        F.when(i % 4 == 0, "n").when(i % 4 == 1, "a").otherwise("i").alias("deptype"), (i * 2).alias("last_value"), (i % 2 == 0).alias("is_called")
    )
    return K.Catalog(relations, attributes, indexes, constraints, sequences, o.where(i % 9 == 0).select(i.alias("relid"), F.lit("table").alias("comment")))


@_query("SELECT 't' || o_orderkey AS table_name, i AS name, i <> 'i2' AS is_unique, columns, def AS definition FROM orders, (VALUES ('i1', 'c3', 'd1'), ('i2', 'c4,c1', 'd2')) AS v(i, columns, def) WHERE i = 'i2' OR o_orderkey % 2 = 1")
def catalog_indexes(spark, d):
    return K.indexes(_catalog(spark, d)).withColumn("columns", F.array_join("columns", ","))


@_query("SELECT 't' || o_orderkey AS table_name, 'k' || j AS name, CASE j WHEN 1 THEN 'u' ELSE 'c' END AS kind, 'c3,c1' AS columns, 'def' || j AS definition FROM orders, (VALUES (1), (2)) AS v(j)")
def catalog_constraints(spark, d):
    return K.constraints(_catalog(spark, d)).withColumn("columns", F.array_join("columns", ","))


@_query("SELECT 't' || o_orderkey AS table_name, 'c1' AS name, 'identity' AS kind FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 't' || o_orderkey, 'c2', 'serial' FROM orders WHERE o_orderkey % 4 = 0")
def catalog_identities(spark, d):
    return K.identities(_catalog(spark, d))


@_query("SELECT 't' || o_orderkey AS table_name, 'PUBLIC' AS grantee, 'SELECT' AS privileges FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 't' || o_orderkey, 'r1', 'INSERT,UPDATE' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 5 <> 1")
def catalog_grants(spark, d):
    return K.grants(_catalog(spark, d)).withColumn("privileges", F.array_join("privileges", ","))


@_query("SELECT 't' || o_orderkey AS table_name, '' AS name, 'table' AS comment FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 't' || o_orderkey, 'c4', 'fourth' FROM orders WHERE o_orderkey % 6 = 0")
def catalog_comments(spark, d):
    return K.comments(_catalog(spark, d)).withColumn("name", F.coalesce("name", F.lit("")))


@_query("SELECT 't' || o_orderkey AS table_name, 'c1' AS column_name, 's' || o_orderkey AS sequence_name, o_orderkey * 2 - o_orderkey % 2 AS last_value FROM orders WHERE o_orderkey % 4 <> 0")
def catalog_sequences(spark, d):
    return K.owned_sequences(_catalog(spark, d))


@_query("SELECT 't' || o_orderkey AS table_name, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey * 10 END AS estimated_rows FROM orders")
def catalog_estimates(spark, d):
    return K.estimates(_catalog(spark, d))


@_query("SELECT 't' || o_orderkey AS table_name, CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'f' END AS identity FROM orders")
def catalog_replica_identity(spark, d):
    return K.replica_identities(_catalog(spark, d))


@_query("SELECT 't' || o_orderkey AS table_name, 'c2,c1' AS columns FROM orders")
def catalog_primary_keys(spark, d):
    return K.primary_keys(_catalog(spark, d)).withColumn("columns", F.array_join("columns", ","))


@_query("SELECT 't' || o_orderkey AS table_name, name FROM orders, (VALUES ('c1'), ('c2')) AS v(name)")
def catalog_key_members(spark, d):
    return K.key_members(_catalog(spark, d))


@_query("SELECT 't' || o_orderkey AS table_name, attnum::INTEGER AS attnum, 'c' || attnum AS name, coalesce(CASE WHEN attnum = 2 AND o_orderkey % 4 = 0 THEN 'nextval(''s'')' WHEN attnum = 3 THEN 'now()' END, '') AS \"default\" FROM orders, (VALUES (1), (2), (3), (4), (5)) AS v(attnum) WHERE NOT (attnum = 5 AND o_orderkey % 2 = 0)")
def catalog_defaults(spark, d):
    return K.column_defaults(_catalog(spark, d)).withColumn("default", F.coalesce("default", F.lit("")))


@_query("SELECT 't' || o_custkey AS table_name FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey IN (SELECT o_orderkey FROM orders)")
def drop_if_exists(spark, d):
    names = _t(spark, d, "orders").select(F.concat(F.lit("t"), "o_custkey").alias("table_name")).distinct()
    return K.droppable(names, _catalog(spark, d))


@_query("SELECT o_custkey AS publication, list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O', 'P'] AS reusable FROM orders GROUP BY o_custkey")
def publication_reuse(spark, d):
    return K.same_tables(_t(spark, d, "orders").select(F.col("o_custkey").alias("publication"), F.col("o_orderstatus").alias("table_name")), ["O", "P", "F"])


@_query("SELECT category, status, count(*) AS n FROM (SELECT 'owner' AS category, CASE WHEN o_custkey % 5 = 2 THEN 'missing' ELSE 'present' END AS status FROM orders UNION ALL SELECT 'index', CASE WHEN o_orderkey % 2 = 1 THEN 'missing' ELSE 'present' END FROM orders) GROUP BY 1, 2")
def catalog_readiness(spark, d):
    """Owners and the second indexes against a target that lacks some: one join for all tables."""
    source = K.secondary_objects(_catalog(spark, d), "source").where("category = 'owner' or (category = 'index' and name = 'i2')")
    lost = F.when(F.col("category") == "owner", F.col("name") == "r2").otherwise(F.substring("table_name", 2, 20).cast("long") % 2 == 1)
    target = source.where(~lost).withColumn("side", F.lit("target"))
    return R.readiness(source.unionByName(target), TableSpec("any")).groupBy("category", "status").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_orderkey, (o_orderkey * 1000 + 9999) // 10000 AS pages, round(((o_orderkey * 1000 + 9999) // 10000) / 100.0, 1)::DOUBLE AS minutes FROM orders WHERE o_orderkey <= 200")
def copy_estimates(spark, d):
    """Planning estimates for tables of some sizes."""
    sizes = range(201)
    known = spark.createDataFrame([(k, *R.copy_estimate(k * 1000, 10_000)) for k in sizes], "o_orderkey long, pages long, minutes double")
    return known.join(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


# --- the example application's reads -----------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def app_page(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(40).limit(20)


@_query("SELECT count(*) AS n, max(o_orderkey) AS max_key FROM orders")
def app_stats(spark, d):
    return _t(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("max_key"))


@_query("SELECT * FROM (VALUES ('users', 500::BIGINT, 500::BIGINT), ('agents', 100::BIGINT, 100::BIGINT), ('listings', 10000::BIGINT, 10000::BIGINT)) AS v(table_name, n, n_keys)")
def demo_rows(spark, d):
    of = lambda name, df: df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_keys"))
    return of("users", demo.users(spark, 10_000)).union(of("agents", demo.agents(spark, 10_000))).union(of("listings", demo.listings(spark, 10_000)))
