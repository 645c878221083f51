import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = ["rules_conn", "beacon_periodic", "dns_burst_nxdomain", "incidents_by_source", "correlated_incidents",
           "flow_assembly", "alert_validation", "composite_evaluation", "composite_detectors", "range_intel", "dga_gate", "flow_threshold",
           "alert_table_merge", "topic_roundtrip"]


def _normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expected = con.execute(entry_points.oracle_sql()[name]).df()
    got = entry_points.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _normal(got) == _normal(expected)


def test_every_statement_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and rows[0].risk_score >= rows[-1].risk_score


def test_filters_and_columns_reach_the_scan(spark, sf):
    from hawkgrid.sources.adapters import table

    events = table(spark, sf, "events").where("value > 10").select("event_id")
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in plan and "props" not in plan
