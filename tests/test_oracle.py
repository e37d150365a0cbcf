"""A part of the registered queries against their SQL in DuckDB, where the tables are at hand."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["counter_rate", "net_rate", "rolling_peak", "query_digest", "changed_variables", "classify_variable", "findings_table", "read_status", "read_sockets", "series_payload", "densify_devices", "counter_or_gauge", "tag_categories", "select_counters", "default_counters", "diagnostics", "files_to_findings", "nested_captures", "merged_counters", "many_windows", "aligned_series", "rules_from_files"]


def plain(value):
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float, decimal.Decimal)) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got, want = queries[name](spark, SF), db.sql(sql[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
