"""Registration, plans, operators, sources and streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from geoquern.core import codec
from geoquern.core import model as M
from geoquern.functions import FUNCTIONS, native
from geoquern.functions.register import call, register_all
from geoquern.index import quadtree
from geoquern.operators import aggregate as agg
from geoquern.operators import frame
from geoquern.plans.rewrite import fold, implied_box
from geoquern.sources import readers
from geoquern.streaming import geofence


@pytest.fixture(scope="module")
def sql(spark):
    register_all(spark)
    return lambda q: spark.sql(q).first()[0]


def test_sql_functions(sql):
    assert sql("SELECT ST_AsText(ST_Buffer(ST_GeomFromText('POLYGON((0 0,1 0,1 1,0 1,0 0))'), 1, 'join=mitre'))") == "POLYGON((-1 -1,2 -1,2 2,-1 2,-1 -1))"
    assert sql("SELECT ST_Within(ST_MakePoint(1, 1), ST_MakeEnvelope(0, 0, 2, 2))") is True
    assert sql("SELECT st_srid(ST_GeomFromText('POINT(1 2)', 4326))") == 4326
    assert sql("SELECT ST_Area(CAST(NULL AS BINARY))") is None
    assert sql("SELECT try_ST_GeomFromText('nonsense')") is None
    assert sql("SELECT ST_AsText(ST_Union_Agg(g)) FROM (SELECT ST_MakeEnvelope(x, 0, x + 1, 1) AS g FROM VALUES (0), (1) AS t(x))") == "POLYGON((0 0,2 0,2 1,0 1,0 0))"
    assert sql("SELECT route_dijkstra_cost(s, t, c, 1L, 3L) FROM VALUES (1L, 2L, 1.5D), (2L, 3L, 2.0D) AS e(s, t, c)") == 3.5
    assert sql("SELECT count(*) FROM ST_Dump(ST_GeomFromText('MULTIPOINT(1 1,2 2,3 3)'))") == 3
    with pytest.raises(Exception, match="collect_list"):
        sql("SELECT ST_Collect(ST_MakePoint(1, 1))")
    with pytest.raises(Exception, match="invalid WKT"):
        sql("SELECT ST_GeomFromText('POINT(')")


def test_every_function_is_registered(spark, sql):
    names = {r[0].lower() for r in spark.sql("SHOW FUNCTIONS").collect()}
    assert {n.lower() for n in FUNCTIONS} <= names


def test_window_query_reaches_the_scan(spark, tmp_path):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 37).cast("double").alias("y")).withColumn("geom", call("ST_MakePoint", "x", "y"))
    frame.prepare_points(df, "x", "y").write.parquet(str(tmp_path / "t"))
    own = spark.read.parquet(str(tmp_path / "t"))
    window = fold("ST_MakeEnvelope", 10.0, 10.0, 20.5, 15.0)
    out = frame.window_query(own, window)
    plan = out._jdf.queryExecution().optimizedPlan().toString() + spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(bbox.maxx,10.0)" in plan
    assert out.count() == df.where("x BETWEEN 10 AND 20.5 AND y BETWEEN 10 AND 15").count()
    assert implied_box("ST_Disjoint", window) is None


def test_spatial_join_matches_brute_force(spark):
    k = F.col("id")
    a = spark.range(150).select(k.alias("ka"), (k * 37 % 100).cast("double").alias("x"), (k * 53 % 90).cast("double").alias("y"), (1 + k % 13).cast("double").alias("w"))
    a = a.select("ka", native.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("bbox"))
    b = spark.range(150).select(k.alias("kb"), (k * 41 % 100).cast("double").alias("x"), (k * 59 % 90).cast("double").alias("y"), F.when(k % 30 == 0, 60.0).otherwise(0.5 + (k % 3).cast("double")).alias("w"))
    b = b.select("kb", native.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("bbox_right"))
    got = frame.box_join(a, b, "bbox", "bbox_right")
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = sorted((r.ka, r.kb) for r in got.select("ka", "kb").collect())
    want = sorted((r.ka, r.kb) for r in a.crossJoin(b).where(native.boxes_overlap(F.col("bbox"), F.col("bbox_right"))).collect())
    assert pairs == want and len(set(pairs)) == len(pairs)


def test_fit_cell_column_agrees(spark):
    rows = [(float(x), float(y), float(x) + w, float(y) + w) for x in (-180, -3, 0, 17) for y in (-90, -1, 45) for w in (0.0, 0.001, 1.0, 40.0)]
    df = spark.createDataFrame(rows, "minx double, miny double, maxx double, maxy double")
    got = df.select(quadtree.fit_cell_column(native.box(*(F.col(c) for c in df.columns))), *df.columns).collect()
    assert all(r[0] == quadtree.fit_cell(tuple(r[1:])) for r in got)


def test_native_forms_agree(spark):
    df = spark.range(100).select((F.col("id") * 3.7 % 360 - 180).alias("x"), (F.col("id") * 1.9 % 160 - 80).alias("y"))
    p, q = call("ST_Point", "x", "y", F.lit(4326)), F.lit(fold("ST_Point", 1.0, 2.0, 4326))
    x, y = F.col("x"), F.col("y")
    rows = df.select(
        call("ST_Distance", p, q), native.distance(x, y, F.lit(1.0), F.lit(2.0)), call("ST_Azimuth", p, q), native.azimuth(x, y, F.lit(1.0), F.lit(2.0)),
        call("ST_GeoHash", p, F.lit(6)), native.geohash(x, y, 6), call("ST_SRID", p), native.srid(p), call("ST_SetSRID", p, F.lit(3857)), native.set_srid(p, 3857),
    ).collect()
    for r in rows:
        assert r[0] == pytest.approx(r[1]) and r[2] == pytest.approx(r[3]) and r[4] == r[5] and r[6] == r[7] and r[8] == r[9]


def test_dissolve_and_dump(spark):
    df = spark.range(64).select((F.col("id") % 2).alias("k"), call("ST_MakeEnvelope", (F.col("id") % 8).cast("double"), F.floor(F.col("id") / 8).cast("double"), (F.col("id") % 8 + 1).cast("double"), (F.floor(F.col("id") / 8) + 1).cast("double")).alias("geom"))
    out = agg.dissolve(df, "k", batch=5)
    assert sorted(r[0] for r in out.select(call("ST_Area", "geom")).collect()) == [32.0, 32.0]
    assert frame.dump(out).count() == 8


def test_topology_and_paths(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 1.0004, 0.0, 2.0, 0.0), (3, 2.0, 0.0, 2.0, 2.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    edges, nodes = frame.create_topology(lines, 0.01)
    assert nodes.count() == 4
    e = edges.select("id", "source", "target", F.lit(1.0).alias("cost"), F.lit(0).alias("g"))
    ask = spark.createDataFrame([(0, 1, 4)], "g int, start_vid long, end_vid long")
    assert agg.shortest_paths(e, ask, "g").first()["path"][-1]["agg_cost"] == 3.0


def test_geojson_and_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 1}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    df = readers.read_geojson(spark, str(tmp_path / "f.json"))
    assert df.select(call("ST_AsText", "geom")).first()[0] == "POINT(1 2)"
    line = json.loads(readers.to_geojson(df, id_col="id", properties=["properties"]).first()[0])
    assert line["geometry"]["coordinates"] == [1, 2] and line["id"] == "a"
    readers.write_features(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("bbox.minx = 1").count() == 1


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE parks(fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
        c.execute("CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT)")
        c.execute("INSERT INTO gpkg_geometry_columns VALUES ('parks', 'geom')")
        c.executemany("INSERT INTO parks VALUES (?, ?, ?)", [(k, f"p{k}", codec.encode(M.point(k, k, 4326))) for k in range(1, 21)] + [(21, "none", None)])
    readers.register_sources(spark)
    df = spark.read.format("geopackage").option("table", "parks").load(path)
    assert df.count() == 21
    assert df.where("name = 'p7'").select(call("ST_X", "geom")).first()[0] == 7.0


def test_stream_geofence(spark, data, tmp_path):
    k = F.col("id")
    x0 = (k * 60 - 180).cast("double")
    zones = spark.range(6).select(k.alias("zone"), call("ST_MakeEnvelope", x0, F.lit(-50.0), x0 + 45, F.lit(50.0)).alias("geom"), native.box(x0, F.lit(-50.0), x0 + 45, F.lit(50.0)).alias("bbox"))
    cells = geofence.zone_cells(zones, 15.0).cache()
    table = spark.read.parquet(f"{data}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))

    def hits(src):
        own = src.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 360000 / 1000.0 - 180).cast("double").alias("lon"), (F.col("event_id") * 104729 % 170000 / 1000.0 - 85).cast("double").alias("lat"))
        return geofence.windowed_counts(geofence.geofence(own, cells, 15.0))

    q = hits(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fence").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("fence").collect())) == sorted(map(tuple, hits(table).collect()))


def test_relate_matches_jts(spark):
    """DE-9IM of the catalogue against an independent library on Spark's class path (driver only)."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    shapes = [
        "POINT(5 5)", "POINT(10 5)", "POINT(0 0)", "MULTIPOINT((5 5),(20 20))", "LINESTRING(0 0,10 10)", "LINESTRING(0 10,10 0)", "LINESTRING(0 0,10 0)", "LINESTRING(-5 5,15 5)", "LINESTRING(10 0,10 10)",
        "LINESTRING(2 2,8 2,8 8,2 2)", "MULTILINESTRING((0 0,5 5),(5 5,9 1))", "POLYGON((0 0,10 0,10 10,0 10,0 0))", "POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,8 2,8 8,2 8,2 2))", "POLYGON((2 2,8 2,8 8,2 8,2 2))",
        "POLYGON((10 0,20 0,20 10,10 10,10 0))", "POLYGON((5 5,15 5,15 15,5 15,5 5))", "POLYGON((0 0,10 0,5 5,0 0))", "MULTIPOLYGON(((0 0,3 0,3 3,0 3,0 0)),((6 6,9 6,9 9,6 9,6 6)))", "POLYGON((3 3,4 3,4 4,3 4,3 3))",
    ]
    read = {s: reader.read(s) for s in shapes}
    for a in shapes:
        for b in shapes:
            own = FUNCTIONS["ST_Relate"].call(codec.encode(codec.parse_wkt(a)), codec.encode(codec.parse_wkt(b)))
            assert own == read[a].relate(read[b]).toString(), (a, b)


def test_overlay_and_buffers_match_jts(spark):
    """Areas of random stars against an independent library (driver only)."""
    import math
    import random

    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    random.seed(11)

    def star(n):
        cx, cy = random.uniform(-5, 5), random.uniform(-5, 5)
        pts = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in ((k, random.uniform(1, 8)) for k in range(n))]
        return "POLYGON((" + ",".join(f"{x!r} {y!r}" for x, y in [*pts, pts[0]]) + "))"

    f = lambda n, *a: FUNCTIONS[n].call(*a)
    for _ in range(25):
        a, b = star(random.randint(4, 11)), star(random.randint(4, 11))
        ga, gb, ja, jb = f("ST_GeomFromText", a), f("ST_GeomFromText", b), reader.read(a), reader.read(b)
        for name, other in (("ST_Intersection", ja.intersection(jb)), ("ST_Union", ja.union(jb)), ("ST_Difference", ja.difference(jb)), ("ST_SymDifference", ja.symDifference(jb))):
            out = f(name, ga, gb)
            assert f("ST_Area", out) == pytest.approx(other.getArea(), rel=1e-9, abs=1e-9)
            assert f("ST_IsValid", out)
        assert f("ST_Relate", ga, gb) == ja.relate(jb).toString()
        assert f("ST_Distance", ga, gb) == pytest.approx(ja.distance(jb), abs=1e-9)
        assert f("ST_Area", f("ST_ConvexHull", ga)) == pytest.approx(ja.convexHull().getArea())
        for r in (0.5, 2.0, -0.4):
            assert f("ST_Area", f("ST_Buffer", ga, r)) == pytest.approx(ja.buffer(r, 8).getArea(), rel=0.01, abs=0.02)


def test_bounded_costs_on_long_paths(spark, tmp_path):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = [(k, k + 1, 1.0) for k in range(70)] + [(0, 70, 70.5), (0, 71, 90.0)]
    edges = spark.createDataFrame(chain, "source long, target long, cost double")
    assert sorted(map(tuple, agg.bounded_costs(edges, 0, 80.0).collect())) == [(k, float(k)) for k in range(71)]
    with pytest.raises(ValueError):
        agg.bounded_costs(edges, 0, 80.0, rounds=3)


def test_join_cells_follow_the_boxes(spark):
    """10,000 small boxes and points within one degree: candidates stay near the hits, whatever the unit."""
    import re

    k = F.col("id")
    x, y = (F.pmod(F.xxhash64(k), F.lit(1_000_003)) / 1_000_003.0), (F.pmod(F.xxhash64(k, F.lit(1)), F.lit(1_000_003)) / 1_000_003.0)
    for unit in (1.0, 1e5):
        boxes = spark.range(10_000).select(k.alias("a"), native.box(x * unit, y * unit, (x + 0.002) * unit, (y + 0.002) * unit).alias("bbox"))
        points = spark.range(10_000, 20_000).select(k.alias("b"), native.box(x * unit, y * unit, x * unit, y * unit).alias("bbox_right"))
        hits = frame.box_join(boxes, points, "bbox", "bbox_right")
        text = hits._jdf.queryExecution().optimizedPlan().toString()
        keyed = re.search(r"Join Inner.*", text)[0]
        assert "_key" in keyed
        n = hits.count()
        ls = frame.join_levels({r[0]: r[1] for r in boxes.groupBy(frame._level(F.col("bbox")).alias("l")).count().collect()}, frame.LEVELS - 1)
        size = frame.BASE / 2 ** max(ls)
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        grid = points.groupBy(cell("bbox_right.minx").alias("i"), cell("bbox_right.miny").alias("j")).count()
        touched = boxes.select(F.explode(frame._cells(F.col("bbox"), F.lit(max(ls)))).alias("c")).select(F.col("c.i").alias("i"), F.col("c.j").alias("j"))
        candidates = touched.join(grid, ["i", "j"]).agg(F.sum("count")).first()[0]
        assert n > 100 and candidates <= 40 * n
        pairs = {(r.a, r.b) for r in hits.select("a", "b").collect()}
        own = [(r.a, r.bbox) for r in boxes.where("a < 200").collect()]
        places = [(r.b, r.bbox_right) for r in points.collect()]
        assert {p for p in pairs if p[0] < 200} == {(a, b) for a, s in own for b, t in places if s.minx <= t.minx <= s.maxx and s.miny <= t.miny <= s.maxy}


def test_join_levels_are_few():
    assert frame.join_levels({3: 5, 9: 1}, 47) == [3, 9]
    levels = frame.join_levels({k: 10 for k in range(30)}, 20)
    assert levels[0] == 0 and len(levels) <= frame.SIDE_LEVELS and max(levels) <= 20


def test_box_join_of_all_sizes(spark):
    k = F.col("id")
    size = F.pow(F.lit(1.7), k % 23)
    df = spark.range(400).select(k.alias("a"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"), size.alias("s"))
    left = df.select("a", native.box(F.col("x"), F.col("y"), F.col("x") + F.col("s") / 1e3, F.col("y") + F.col("s") / 1e3).alias("bbox"))
    right = df.select(F.col("a").alias("b"), native.box(F.col("y"), F.col("x"), F.col("y") + F.col("s") / 1e2, F.col("x") + F.col("s") / 1e4).alias("other"))
    got = [(r.a, r.b) for r in frame.box_join(left, right, "bbox", "other").select("a", "b").collect()]
    l, r = [(x.a, x.bbox) for x in left.collect()], [(x.b, x.other) for x in right.collect()]
    want = {(i, j) for i, s in l for j, t in r if s.minx <= t.maxx and t.minx <= s.maxx and s.miny <= t.maxy and t.miny <= s.maxy}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n,k", [(0, 3), (2, 3), (900, 1), (900, 7)])
def test_knn_matches_brute_force(spark, n, k):
    """Points in two crowds and a few far ones; queries in the crowds, between them and outside."""
    i = F.col("id")
    x = F.when(i % 3 == 0, (i * 7919 % 1009) / 1e5).when(i % 3 == 1, 50 + (i * 31 % 997) / 1e3).otherwise((i * 17 % 101).cast("double"))
    points = spark.range(n).select(i.alias("p"), x.cast("double").alias("px"), ((i * 104729 % 1013) / 1e4 + i % 2).cast("double").alias("py"))
    queries = spark.range(60).select(i.alias("q"), (i * 13 % 120 - 10).cast("double").alias("qx"), (i % 5 - 2).cast("double").alias("qy"))
    got = sorted((r.q, r.rank, r.p) for r in frame.knn(queries, points, k, "q", "p", ("qx", "qy"), ("px", "py")).collect())
    ps = [(r.p, r.px, r.py) for r in points.collect()]
    want = []
    for r in queries.collect():
        near = sorted((((r.qx - a) ** 2 + (r.qy - b) ** 2) ** 0.5, p) for p, a, b in ps)[:k]
        want += [(r.q, j + 1, p) for j, (_, p) in enumerate(near)]
    assert got == sorted(want)


def test_feature_table(spark, tmp_path):
    from geoquern.sources.table import FeatureTable

    k = F.col("id")
    features = spark.range(2000).select(k, (k % 50).cast("double").alias("x"), (F.floor(k / 50)).cast("double").alias("y")).select("id", call("ST_MakePoint", "x", "y").alias("geom"), F.lit("old").alias("name"))
    t = FeatureTable(spark, str(tmp_path / "features"))
    assert t.stats()["features"] == 0 and t.read() is None and t.delete(spark.range(1)) is None
    t.load(features)
    window = fold("ST_MakeEnvelope", 9.5, 9.5, 20.5, 15.0)
    hits = t.query(window)
    assert hits.count() == 11 * 6 and t.stats()["extent"] == "POLYGON((0 0,0 39,49 39,49 0,0 0))"
    plan = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [" in plan and "bbox.minx" in plan
    moved = spark.createDataFrame([(510, "new"), (5000, "new"), (5000, "new")], "id long, name string").withColumn("geom", call("ST_MakePoint", F.lit(12.0), F.lit(12.0)))
    t.upsert(moved)
    assert t.stats()["features"] == 2001 and t.query(window).where("name = 'new'").count() == 2
    t.delete(spark.range(0, 1000))
    assert t.stats()["features"] == 1001 and t.versions() == [1, 2, 3]
    (tmp_path / "features" / "v=4").mkdir()  # a writer that was lost
    assert t.stats()["version"] == 3
    t.vacuum()
    assert t.versions() == [3]
    t.clear()
    assert t.versions() == [] and t.stats()["features"] == 0


def test_scan_of_a_feature_table_skips_row_groups(spark, tmp_path):
    """The pruned scan end to end: fewer rows leave the scan than the table holds."""
    k = F.col("id")
    points = spark.range(40_000).select(k, (k % 200 - 100).cast("double").alias("x"), (F.floor(k / 200) % 160 - 80).cast("double").alias("y")).withColumn("geom", call("ST_MakePoint", "x", "y"))
    readers.write_features(points.select("id", "geom"), str(tmp_path / "t"), partitions=16)
    own = spark.read.parquet(str(tmp_path / "t"))
    window = fold("ST_MakeEnvelope", 10.0, 10.0, 14.0, 13.0)
    hits = frame.window_query(own, window)
    assert hits.count() == 5 * 4
    hits.collect()
    node = hits._jdf.queryExecution().executedPlan()
    stack, read = [node], []
    while stack:
        n = stack.pop()
        name = n.nodeName()
        if name.startswith("Scan parquet"):
            read.append(n.metrics().apply("numOutputRows").value())
        for attr in ("executedPlan", "inputPlan", "plan"):
            try:
                stack.append(getattr(n, attr)())
            except Exception:  # noqa: BLE001  not that kind of node
                pass
        children = n.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert read and max(read) < 10_000


def test_edge_lists_and_tiles(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,source,target,cost,reverse_cost\n1,1,2,1.5,\n2,2,3,2.0,-1\n3,3,1,0.5,0.25\n")
    edges = readers.read_edges(spark, str(tmp_path / "e.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in edges.schema] == [("id", "bigint"), ("source", "bigint"), ("target", "bigint"), ("cost", "double"), ("reverse_cost", "double")]
    assert sorted(map(tuple, edges.collect())) == [(1, 1, 2, 1.5, None), (2, 2, 3, 2.0, -1.0), (3, 3, 1, 0.5, 0.25)]
    asked = spark.createDataFrame([(0, 1, 3)], "g int, start_vid long, end_vid long")
    path = agg.shortest_paths(edges.withColumn("g", F.lit(0)), asked, "g", reverse="reverse_cost").first().path
    assert path[-1].agg_cost == 0.25 and [s.edge for s in path] == [3, -1]
    tiles = spark.range(20).select(F.lit(3).alias("z"), (F.col("id") % 5).alias("x"), F.floor(F.col("id") / 5).alias("y"), F.encode(F.col("id").cast("string"), "UTF-8").alias("tile"))
    readers.write_tiles(tiles, str(tmp_path / "tiles"), ["z", "x", "y"])
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.count() == 20 and back.where("x = 2 AND y = 3").first().tile == b"17"


def test_bounded_costs_with_steps(spark, tmp_path):
    """Costs both ways and the steps that reach the nodes, against the search in one task."""
    import random

    from geoquern.core import route

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(7)
    rows = [(i, rng.randrange(30), rng.randrange(30), rng.choice([-1.0, 0.0, 1.5, 2.25, rng.random()]), rng.choice([-1.0, 0.5, rng.random() * 3])) for i in range(90)]
    edges = spark.createDataFrame(rows, "id long, source long, target long, cost double, back double")
    out = agg.bounded_costs(edges, 3, 4.0, reverse="back", steps=True).collect()
    want = {r[4]: r[7] for r in route.driving_distance(rows, 3, 4.0)}
    assert {r.node: r.agg_cost for r in out} == pytest.approx(want)
    known = {(i, s, t, c) for i, s, t, c, _ in rows} | {(i, t, s, b) for i, s, t, _, b in rows}
    cost = {r.node: r.agg_cost for r in out}
    for r in out:
        assert (r.node == 3 and r.pred is None and r.edge == -1) or ((r.edge, r.pred, r.node, r.cost) in known and cost[r.pred] + r.cost == pytest.approx(r.agg_cost))


def test_rows_of_vertices_and_pieces(spark):
    df = spark.createDataFrame([(1, "LINESTRING(0 0,1 1,2 0)"), (2, "POLYGON((0 0,8 0,8 8,4 1,0 8,0 0))"), (3, None)], "id int, t string").withColumn("geom", call("ST_GeomFromText", "t"))
    got = frame.dump_points(df.where("id <> 2")).select("id", "path", call("ST_AsText", "geom").alias("p")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "POINT(0 0)"), (1, 2, "POINT(1 1)"), (1, 3, "POINT(2 0)")]
    pieces = frame.subdivide(df.where("id > 1"), 5)
    assert pieces.agg(F.sum(call("ST_Area", "geom"))).first()[0] == pytest.approx(36.0) and pieces.where(call("ST_NPoints", "geom") > 5).count() == 0
    plan = pieces._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
