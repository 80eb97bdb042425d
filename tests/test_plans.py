"""Specs, types and the query catalogue against DuckDB."""

import math

import duckdb
import pytest

from strataport.errors import SpecError
from strataport.functions import types as T
from strataport.plans import catalogue
from strataport.plans.spec import load_config, table_spec

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(([plain(v) for v in r] for r in got.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(([plain(v) for v in r] for r in duck.execute(f"SELECT {names} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()), key=str)
    assert rows == want


def test_config():
    c = load_config("""
source: {host: a, database: b, user: c}
migrate:
  max_rows_per_second: 5
  tables:
    - name: Big-Table
      columns: {id: {type: bigint}, x: {rename: y}, z: ~}
      add_columns: [{name: n, type: text, default: "'q'"}]
verify: {sample_size: 7}
""")
    assert (c.source.port, c.target, c.sample_size, c.sequence_buffer, c.lag_drain_timeout) == (5432, None, 7, 1000, 300)
    m = c.migrate
    assert (m.slot, m.batch_size, m.lag_threshold_bytes, m.max_rows_per_second) == ("slot_big_table", 10_000, 1_048_576, 5)
    assert m.tables[0].renames == {"x": "y"} and m.tables[0].target_key(["id", "x"]) == ["id", "y"]
    with pytest.raises(SpecError) as e:
        load_config("source: {host: '', database: b, user: c, port: 0}\nmigrate: {batch_size: 0, tables: [{name: t, columns: {a: {drop: true, type: int}}}]}\ncutover: {sequence_buffer: -1}")
    for part in ("source.host", "source.port", "batch_size", "t.a", "sequence_buffer"):
        assert part in str(e.value)
    with pytest.raises(SpecError):
        table_spec({"columns": {}})


def test_types():
    assert T.physical("Interval") == T.Physical(8, 16) and T.physical("uuid") == T.Physical(4, None) and T.physical("time") == T.Physical(4, 8)
    assert T.internal("character varying(9)") == "varchar" and T.internal("char(2)") == "bpchar" and T.internal("decimal(3,1)") == "numeric"
    assert T.is_known("timestamptz") and not T.is_known("circle")
    assert T.spark_type("numeric(18,4)") == "decimal(18,4)" and T.spark_type("numeric") == "decimal(38,18)" and T.spark_type("smallint") == "smallint"
