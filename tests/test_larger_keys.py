"""Queries against their SQL on keys that only larger tables hold."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_catalogue import clean


@pytest.fixture
def same(spark, tmp_path):
    """Holds a query against its SQL over tables given as SQL; returns the number of rows."""

    def check(name, **tables):
        db = duckdb.connect()
        for t, sql in tables.items():
            db.execute(f"CREATE TABLE {t} AS {sql}")
            db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
        r = db.execute(entry.oracle_sql()[name])
        names = sorted(c[0] for c in r.description)
        at = [[c[0] for c in r.description].index(n) for n in names]
        want = sorted((tuple(clean(x[k]) for k in at) for x in r.fetchall()), key=repr)
        got = sorted((tuple(clean(x[n]) for n in names) for x in entry.queries()[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == want
        return len(got)

    return check


def test_spheroid_near_the_antipode(same):
    # 88967 is a few kilometres from the antipode, 61078 within microns of a rounding border
    assert same("geo_spheroid", customer="SELECT unnest([4820, 50644, 61078, 66055, 88967, 1, NULL])::BIGINT AS c_custkey") == 7


def test_recursion_of_more_rows_than_spark_allows(same, spark):
    name, rows = "spark.sql.cteRecursionRowLimit", "SELECT unnest(range(-40, 400) || [7, 7, NULL])::BIGINT AS c_custkey"
    before = spark.conf.get(name)
    spark.conf.set(name, 500)
    try:
        assert same("rel_recursion", customer=rows) == 440 - 30
    finally:
        spark.conf.set(name, before)


def test_knn_broadcasts_no_rows_by_cell(spark):
    from geoquern.operators import frame

    own = spark.range(50).selectExpr("id AS s", "id * 7 % 50 / 1.0D AS sx", "id * 3 % 50 / 1.0D AS sy")
    pts = spark.range(400).selectExpr("id AS c", "id * 37 % 400 / 8.0D AS cx", "id * 11 % 400 / 8.0D AS cy")
    df = frame.knn(own, pts, 3, "s", "c", ("sx", "sy"), ("cx", "cy"))
    assert "BroadcastHashJoin [cell" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 150
    assert "BroadcastHashJoin [cell" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_rectangles_meet_the_points_once(same, monkeypatch):
    from geoquern.operators import frame

    seen, join = [], frame.spatial_join
    monkeypatch.setattr(frame, "spatial_join", lambda left, *args, **named: seen.append(left.count()) or join(left, *args, **named))
    # the rectangles come again after 2100 keys; a key twice, one without a value
    keys = "SELECT (k + 2100 * g)::BIGINT AS p_partkey, '' AS p_brand FROM range(1, 21) a(k), range(30) b(g) UNION ALL SELECT unnest([5, NULL]), ''"
    assert same("geo_spatial_join", part=keys, customer="SELECT unnest(range(6000))::BIGINT AS c_custkey") > 300
    assert seen == [20 + 1]  # and that of no value


def test_costly_shapes_are_made_once_each_on_all_cores(same, spark, tmp_path):
    # shapes come again after 2100 keys; a key twice
    keys = "SELECT unnest([3, 4, 2103, 2104, 4203, 21003, 3])::BIGINT AS s_suppkey"
    assert same("geo_shapes", supplier=keys) == 7
    plan = entry.queries()["geo_shapes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    evaluated, below = plan.rindex("ArrowEvalPython"), plan.rfind("Aggregate")
    assert below > evaluated and "Repartition 4, true" in plan[evaluated:]
    spark.createDataFrame([(None,), (3,)], "s_suppkey long").write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert {r["k"] for r in entry.queries()["geo_shapes"](spark, f"{tmp_path}/none").collect()} == {None, 3}
