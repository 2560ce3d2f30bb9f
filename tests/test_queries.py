"""Every query with SQL against DuckDB on the small tables; the others against what they must hold."""

import math

import duckdb
import pytest

from loomline.plans import evidence_queries, hold_queries, payload_queries, review_queries, transcript_queries  # noqa: F401  add their queries to those of plans
from loomline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return int(value) if type(value).__name__ == "Decimal" else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, data, name):
    got = plans.QUERIES[name](spark, data)
    want = duck.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_holes_and_cover_make_up_the_timeline(spark, data):
    holes = {r.user_id: r.n for r in plans.i2_holes(spark, data).selectExpr("user_id", "end - start AS l").groupBy("user_id").sum("l").withColumnRenamed("sum(l)", "n").collect()}
    for r in plans.i3_covered_seconds(spark, data).collect():
        assert abs(r.covered + holes.get(r.user_id, 0.0) - r.duration) < 1e-6


def test_partition_has_no_fault(spark, data):
    from loomline.operators import intervals

    parts = plans.i6_partition(spark, data).select("user_id", "start", "end")
    assert intervals.tiling_faults(parts, plans.timelines(spark, data), ["user_id"]).count() == 0
