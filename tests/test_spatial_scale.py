"""Spatial search and triangulation in many leaves and tiles, against all pairs and one tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import spatial, triangulation


def unit(p):
    b, a = np.radians(np.asarray(p, float).T)
    return np.column_stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])


def kilometres(cells, stations):
    return 2 * 6371.0088 * np.arcsin(np.minimum(np.linalg.norm(unit(cells)[:, None] - unit(stations)[None], axis=2) / 2, 1))


def frames(spark, cells, stations):
    return (
        spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(cells)], "row int, col int, lat double, lon double"),
        spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(stations)], "station_id int, lat double, lon double"),
    )


CITY = np.random.default_rng(5)
PLACES = {
    "spread": CITY.uniform((-89, -179), (89, 179), (600, 2)),
    "one town and one far away": np.vstack([CITY.normal((35, 139), 0.05, (700, 2)), [[-50.0, -120.0]]]),
    "a line": np.column_stack([np.linspace(-60, 60, 300), np.full(300, 10.0)]),
    "three": np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]]),
}


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_stations(spark, place, k):
    stations = PLACES[place]
    cells = np.vstack([CITY.uniform((-90, -180), (90, 180), (150, 2)), stations[::50], [[90.0, 0.0], [35.0, 139.0], [0.0, 180.0]]])
    frame, table = frames(spark, cells, stations)
    frame = frame.union(spark.createDataFrame([(9999, 0, None, 1.0)], frame.schema))
    got = {}
    for r in spatial.nearest_stations(frame, table, k).collect():
        got.setdefault(r.row, []).append((r["rank"], r.station_id, r.distance_km))
    km = kilometres(cells, stations)
    assert len(got) == len(cells)
    for i, d in enumerate(km):
        rows = sorted(got[i])
        want = np.sort(d)[: min(k, len(stations))]
        assert [x[2] for x in rows] == pytest.approx(want.tolist(), abs=1e-5)
        assert [d[x[1]] for x in rows] == pytest.approx(want.tolist(), abs=1e-5)


def test_search_looks_at_few_pairs(spark):
    """Cells around the globe, all stations in a town: the visited leaves' stations, not all of them."""
    stations = np.vstack([CITY.normal((35, 139), 0.05, (4000, 2)), [[-50.0, -120.0]]])
    cells = np.vstack([CITY.uniform((-80, -180), (80, 180), (100, 2)), CITY.normal((35, 139), 0.05, (400, 2))])
    frame, table = frames(spark, cells, stations)
    levels = spatial.station_tree(table)
    assert levels[-1].count() == 1 and levels[0].select(F.explode("kids")).count() == 4001
    assert levels[0].select(F.max(F.size("kids"))).first()[0] <= 64
    plan = spatial.nearest_stations(frame, table, 1)
    plan.collect()
    node = plan._jdf.queryExecution().executedPlan()
    assert "CartesianProduct" not in node.toString() and "BroadcastNestedLoopJoin" not in node.toString()


def test_inverse_distance_without_a_radius(spark):
    stations, cells = PLACES["spread"], CITY.uniform((-80, -180), (80, 180), (60, 2))
    frame, table = frames(spark, cells, stations)
    plan = spatial.idw_plan(frame, table, spatial.IDWConfig(4, allow_extrapolation=True))
    km = kilometres(cells, stations)
    got = {}
    for r in plan.collect():
        got.setdefault(r.row, {})[r.station_id] = r.weight
    for i, d in enumerate(km):
        near = np.argsort(d)[:4]
        w = d[near] ** -2.0
        assert got[i] == pytest.approx(dict(zip(near.tolist(), (w / w.sum()).tolist(), strict=True)), rel=1e-6)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_values_that_are_not_finite_stop(spark, bad):
    stations = spark.createDataFrame([(1, 35.0, 135.0, 1.0), (2, 35.0, 136.0, bad)], "station_id int, lat double, lon double, value double")
    with pytest.raises(Exception, match="not finite"):
        spatial.interpolate_surface(spark, stations, spatial.Grid(134, 34, 137, 36, (2, 2)), "nearest", spatial.NearestConfig(allow_extrapolation=True)).collect()


RNG = np.random.default_rng(8)
POINTS = {
    "uniform": RNG.uniform(0, 1000, (2000, 2)),
    "clustered": np.vstack([RNG.normal(0, 1, (700, 2)), RNG.normal(300, 20, (300, 2)), RNG.uniform(-800, 800, (60, 2))]),
    "lattice": np.array([(x, y) for x in range(20) for y in range(20)], float) * 10,
    "ring": np.column_stack([np.cos(np.arange(200) * np.pi / 100), np.sin(np.arange(200) * np.pi / 100)]) * 100,
}


@pytest.mark.parametrize("kind", POINTS)
def test_tiles_give_one_triangulation(spark, kind):
    p = POINTS[kind]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "station_id long, x double, y double")
    find = lambda size: sorted((r.s0, r.s1, r.s2) for r in triangulation.triangulate(df, size).collect())
    tiled, whole = find(100), find(10**6)
    assert tiled == whole and len(set(tiled)) == len(tiled)
    tri = np.array(whole)
    # They cover the hull once.
    area = np.abs(triangulation._turn(p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]])).sum() / 2
    _, hull = triangulation.delaunay(p + RNG.uniform(-1e-6, 1e-6, p.shape))
    assert area == pytest.approx(abs((p[hull[:, 0], 0] * p[hull[:, 1], 1] - p[hull[:, 0], 1] * p[hull[:, 1], 0]).sum()) / 2, rel=1e-6)


def test_a_task_searches_few_cells(spark, monkeypatch):
    """Cells of one partition are dealt to many tasks, and each cell's nearest stay the same."""
    stations = spark.range(300).selectExpr("id as station_id", "30 + (id * 0.618D) % 7 as lat", "130 + (id * 0.414D) % 9 as lon")
    cells = spark.range(0, 900, 1, 1).selectExpr("cast(id as int) as row", "0 as col", "30 + (id * 0.732D) % 7 as lat", "130 + (id * 0.236D) % 9 as lon")
    want = sorted(map(tuple, spatial.nearest_stations(cells, stations, 4).collect()))
    monkeypatch.setattr(spatial, "CELLS", 50)
    found = spatial.nearest_stations(cells, stations, 4)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 3600
    sizes = [r["n"] for r in found.select(F.spark_partition_id().alias("p"), "row").distinct().groupBy("p").agg(F.count("row").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) <= 120


def test_cells_of_triangles_are_dealt_to_tasks(spark, monkeypatch):
    """A small file of cells is one partition, which broadcast joins with triangles would keep."""
    dealt, real = [], spatial.dealt_cells
    monkeypatch.setattr(spatial, "CELLS", 16)
    monkeypatch.setattr(spatial, "dealt_cells", lambda cells, parts: dealt.append((cells.columns, parts)) or real(cells, parts))
    stations = spark.range(300).selectExpr("id as station_id", "35 + (id * 0.618D) % 1 as lat", "135 + (id * 0.414D) % 1 as lon")
    cells = spark.range(0, 100, 1, 1).selectExpr("cast(id as int) as row", "0 as col", "35 + (id * 0.732D) % 1 as lat", "135 + (id * 0.236D) % 1 as lon")
    plan = spatial.linear_plan(cells, stations, spatial.Grid(135.0, 35.0, 136.0, 36.0, (1, 1)))
    assert (["row", "col", "x", "y"], 7) in dealt
    assert plan.select("row").distinct().count() == 100
