"""Every core query against its SQL counterpart on the smallest data; streams; plans."""

import glob
import os

import duckdb
import pytest

from marginalia.plans import catalog
from marginalia.streaming import events

SQL = catalog.oracle_sql()


def shown(v):
    if isinstance(v, float):
        return repr(v + 0.0) if v else "0.0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    t = catalog.queries()[name](spark, data).toArrow()
    if name not in SQL:
        return
    con = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.sql(SQL[name])
    cols = sorted(t.column_names)
    assert sorted(r.columns) == cols
    at = [list(r.columns).index(c) for c in cols]
    want = sorted("|".join(shown(x[i]) for i in at) for x in r.fetchall())
    got = sorted("|".join(map(shown, x)) for x in zip(*(t[c].to_pylist() for c in cols)))
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty_dir, name):
    n = catalog.queries()[name](spark, empty_dir).count()
    assert n == 0 or name in ("cer_total", "warning_ratio", "delete_paper", "papers_cube", "batch_report", "review_dashboard", "section_choice")  # reports with a row of totals or a head


def test_flagship(spark, data):
    assert catalog.flagship(spark, data).count() > 0


def test_session_state_expires(spark, data):
    """Sessions that ended hold a user's events in order: as many as there are at most, opened with the user's first."""
    out = events.run_to_end(events.expiring_state(events.read_stream(spark, data)), "append")
    rows = out.collect()
    assert out.columns[:3] == ["user_id", "opened", "n"] and rows
    log = {r.user_id: (r.n, r.first) for r in spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "unix_millis(cast(ts as timestamp)) as t").groupBy("user_id").agg({"*": "count", "t": "min"}).withColumnsRenamed({"count(1)": "n", "min(t)": "first"}).collect()}
    per = {}
    for r in rows:
        per.setdefault(r.user_id, []).append((r.opened, r.n))
    for user, seen in per.items():
        n, first = log[user]
        assert sum(k for _, k in seen) <= n and min(seen)[0] == first and len({o for o, _ in seen}) == len(seen)


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = catalog.queries()["scan_table"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(published_year), GreaterThanOrEqual(published_year,2015)]" in plan
    assert "abstract" not in plan.split("ReadSchema")[1]
