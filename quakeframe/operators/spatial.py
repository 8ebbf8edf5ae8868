"""Station values on grids: nearest, inverse-distance and linear interpolation.

A plan is a weight table (row, col, station_id, weight) that later frames of values join
and sum.  Neighbours are found in a tree of boxes on the unit sphere: stations are packed
into leaves of even size, sixteen nodes make one above.  A cell first goes down to the
nearest box that holds enough stations, which bounds its distance, and then visits the boxes
within that bound alone, so what it looks at doesn't grow with the stations around it or
with its distance from them.  Every level is one equi-join on the node's number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..plans.storage import written
from .tiles import even_tiles
from .triangulation import triangulate

#: Stations of a leaf at least, as far as there are so many; children of a node are 2**FAN.
LEAF, FAN = 16, 4
#: Cells that a task searches for, however they are stored.
CELLS = 8192


@dataclass(frozen=True)
class Grid:
    """Bounds in degrees and shape (rows from the south, columns from the west); cells are pixels, coordinates their centres."""

    west: float
    south: float
    east: float
    north: float
    shape: tuple[int, int]

    def __post_init__(self) -> None:
        ok = -180 <= self.west < self.east <= 180 and -90 <= self.south < self.north <= 90
        if not ok or min(self.shape) < 1:
            raise ValueError("bounds must increase within the globe and the shape be positive")

    @classmethod
    def from_bounds(cls, west: float, south: float, east: float, north: float, shape: tuple[int, int] | None = None, resolution_km: float | None = None, max_cells: int = 750_000) -> Grid:
        """By shape (an error above max_cells) or by about a resolution (coarsened to max_cells); sizes round half to even."""
        if (shape is None) == (resolution_km is None):
            raise ValueError("give either a shape or a resolution")
        if shape is not None:
            if shape[0] * shape[1] > max_cells:
                raise ValueError(f"{shape[0]} x {shape[1]} cells are over max_cells={max_cells}")
            return cls(west, south, east, north, tuple(shape))
        if not resolution_km > 0:
            raise ValueError("the resolution must be greater than zero")
        degree = geo.EARTH_RADIUS_KM * math.pi / 180
        height, width = (north - south) * degree, (east - west) * degree * math.cos(math.radians((south + north) / 2))
        rows, cols = max(1, round(height / resolution_km)), max(1, round(width / resolution_km))
        if rows * cols > max_cells:
            shrink = math.sqrt(max_cells / (rows * cols))
            rows, cols = max(1, math.floor(rows * shrink)), max(1, math.floor(cols * shrink))
        return cls(west, south, east, north, (rows, cols))

    @property
    def cell_count(self) -> int:
        return self.shape[0] * self.shape[1]

    @property
    def center(self) -> tuple[float, float]:
        return (self.west + self.east) / 2, (self.south + self.north) / 2

    @property
    def corners(self) -> list[tuple[float, float]]:
        """North-west, north-east, south-east, south-west, as images are placed."""
        return [(self.west, self.north), (self.east, self.north), (self.east, self.south), (self.west, self.south)]

    def latitude(self, row: Column) -> Column:
        return self.south + (row + 0.5) * ((self.north - self.south) / self.shape[0])

    def longitude(self, col: Column) -> Column:
        return self.west + (col + 0.5) * ((self.east - self.west) / self.shape[1])

    def cells(self, spark: SparkSession) -> DataFrame:
        """(row, col, lat, lon), made by Spark from the cell numbers."""
        number = spark.range(self.cell_count).select(F.floor(F.col("id") / self.shape[1]).cast("int").alias("row"), (F.col("id") % self.shape[1]).cast("int").alias("col"))
        return number.select("row", "col", self.latitude(F.col("row")).alias("lat"), self.longitude(F.col("col")).alias("lon"))


@dataclass(frozen=True)
class IDWConfig:
    neighbors: int
    power: float = 2.0
    max_distance_km: float | None = None
    minimum_neighbors: int = 1
    exact_tolerance_m: float = 1.0
    allow_extrapolation: bool = False

    def __post_init__(self) -> None:
        if self.neighbors < 1 or not 1 <= self.minimum_neighbors <= self.neighbors or not self.power > 0 or self.exact_tolerance_m < 0:
            raise ValueError("neighbors, minimum_neighbors, power or exact_tolerance_m is out of range")
        need_radius(self.max_distance_km, self.allow_extrapolation)

    @classmethod
    def suzuki_2017_pga(cls) -> IDWConfig:
        """Four stations within 50 km, all four needed, inverse square."""
        return cls(neighbors=4, power=2.0, max_distance_km=50.0, minimum_neighbors=4)


@dataclass(frozen=True)
class NearestConfig:
    max_distance_km: float | None = None
    allow_extrapolation: bool = False

    def __post_init__(self) -> None:
        need_radius(self.max_distance_km, self.allow_extrapolation)


@dataclass(frozen=True)
class LinearConfig:
    maximum_extent_km: float = 2000.0


def need_radius(radius: float | None, extrapolate: bool) -> None:
    if radius is None and not extrapolate:
        raise ValueError("max_distance_km is needed unless allow_extrapolation is set")
    if radius is not None and not (radius > 0 and math.isfinite(radius)):
        raise ValueError("max_distance_km must be finite and greater than zero")


def check_stations(stations: DataFrame, minimum: int = 1) -> DataFrame:
    """(station_id, lat, lon) with coordinates in range and no two stations at one point; else the query stops."""
    lat, lon = F.col("lat"), F.col("lon")
    good = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    many = F.count(F.lit(1)).over(Window.partitionBy("lat", "lon")) > 1
    flag = F.when(~good, F.raise_error(F.lit("a station's coordinates are out of range"))).when(many, F.raise_error(F.lit("two stations share a point"))).otherwise(lat)
    out = stations.select("station_id", flag.alias("lat"), "lon")
    if minimum > 1 and stations.limit(minimum).count() < minimum:
        raise ValueError(f"at least {minimum} stations are needed")
    return out


_BOX = ("x0", "x1", "y0", "y1", "z0", "z1")


def _least_chord(box: Column) -> Column:
    """From the cell (cx, cy, cz) to a box."""
    gaps = [F.greatest(box[f"{a}0"] - F.col(f"c{a}"), F.col(f"c{a}") - box[f"{a}1"], F.lit(0.0)) for a in "xyz"]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def _greatest_chord(box: Column) -> Column:
    gaps = [F.greatest(F.abs(box[f"{a}0"] - F.col(f"c{a}")), F.abs(box[f"{a}1"] - F.col(f"c{a}"))) for a in "xyz"]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def station_tree(stations: DataFrame, leaf: int = LEAF) -> list[DataFrame]:
    """Levels of (node, kids), written: kids are stations in leaves, and boxes with the number of their stations above; the last level is one node."""
    xyz = [x.alias(n) for x, n in zip(geo.unit_xyz(F.col("lon"), F.col("lat")), "xyz", strict=True)]
    rows = stations.select("station_id", "lat", "lon", *xyz)
    tiles = even_tiles(rows, "lat", "lon", leaf, rows.count())
    dealt = tiles.deal(rows, "lat", "lon", code=True)
    member = F.collect_list(F.struct("station_id", "x", "y", "z")).alias("kids")
    extent = [f(a).alias(f"{a}{k}") for a in "xyz" for k, f in ((0, F.min), (1, F.max))]
    level = written(dealt.groupBy(F.col("code").alias("node")).agg(member, F.count(F.lit(1)).alias("n"), *extent))
    levels = [level.select("node", "kids")]
    for _ in range(max(1, -(-2 * tiles.bits // FAN))):
        kid = F.collect_list(F.struct("node", "n", *_BOX)).alias("kids")
        wider = [f(f"{a}{k}").alias(f"{a}{k}") for a in "xyz" for k, f in ((0, F.min), (1, F.max))]
        level = written(level.withColumn("up", F.shiftright("node", FAN)).groupBy(F.col("up").alias("node")).agg(kid, F.sum("n").alias("n"), *wider))
        levels.append(level.select("node", "kids"))
    return levels


def cell_parts(cells: DataFrame) -> int:
    return max(1, math.ceil(cells.count() / CELLS))


def dealt_cells(cells: DataFrame, parts: int) -> DataFrame:
    return cells.repartition(parts, "row", "col")


def nearest_stations(cells: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """(row, col, station_id, distance_km, rank): the k nearest stations of each cell that has coordinates, all if there are fewer; ties by the smallest id."""
    levels = station_tree(stations, max(LEAF, 4 * k))
    xyz = [x.alias(n) for x, n in zip(geo.unit_xyz(F.col("lon"), F.col("lat")), ("cx", "cy", "cz"), strict=True)]
    # Broadcast joins keep the partitions of their left side, and a small file of cells is one.
    parts = cell_parts(cells)
    at = dealt_cells(cells.where("lat is not null and lon is not null").select("row", "col", *xyz), parts)
    keep = ["row", "col", "cx", "cy", "cz"]
    slack = lambda c: c * (1 + 1e-9) + 1e-12
    apart = lambda s: geo.chord((F.col("cx"), F.col("cy"), F.col("cz")), (s["x"], s["y"], s["z"]))

    first = levels[-1].first()  # one node of at most sixteen boxes
    top = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in kid.asDict().items()]) for kid in first["kids"]]) if first else None

    def meet(rows: DataFrame, level: DataFrame, how: str) -> DataFrame:
        return rows.withColumn("kids", top) if level is levels[-1] else rows.join(level, "node", how)

    if top is None:
        return cells.select("row", "col", F.lit(None).cast(dict(stations.dtypes)["station_id"]).alias("station_id"), F.lit(0.0).alias("distance_km"), F.lit(1).alias("rank")).limit(0)

    # Down to the nearest box with k stations; the sphere's diameter bounds all.
    down = at.withColumns({"node": F.lit(0).cast("long"), "bound": F.lit(2.0)})
    for level in reversed(levels[1:]):
        full = F.filter("kids", lambda b: b["n"] >= k)
        best = F.array_min(F.transform(full, lambda b: F.struct(_least_chord(b).alias("near"), b["node"].alias("node"), _greatest_chord(b).alias("far"))))
        down = meet(down, level, "left").withColumn("best", best)
        down = down.select(*keep, F.col("best.node").alias("node"), F.least("bound", F.coalesce("best.far", F.lit(2.0))).alias("bound"))
    kth = F.get(F.sort_array(F.transform("kids", apart)), F.lit(k - 1))
    down = meet(down, levels[0], "left").select(*keep, slack(F.least("bound", F.coalesce(kth, F.lit(2.0)))).alias("bound"))
    # All boxes within the bound, then their stations.
    found = dealt_cells(written(down), parts).withColumn("node", F.lit(0).cast("long"))
    for level in reversed(levels[1:]):
        found = meet(found, level, "inner").select(*keep, "bound", F.explode(F.filter("kids", lambda b: _least_chord(b) <= F.col("bound"))).alias("b")).select(*keep, "bound", "b.node")
    met = F.transform("kids", lambda s: F.struct(s["station_id"].alias("station_id"), apart(s).alias("chord")))
    found = meet(found, levels[0], "inner").select("row", "col", F.explode(F.filter(met, lambda s: s["chord"] <= F.col("bound"))).alias("s"))
    found = found.select("row", "col", "s.station_id", geo.chord_to_km(F.col("s.chord")).alias("distance_km"))
    order = Window.partitionBy("row", "col").orderBy("distance_km", "station_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_plan(cells: DataFrame, stations: DataFrame, config: NearestConfig) -> DataFrame:
    """(row, col, station_id, weight, nearest_km, neighbor_count): the nearest station, ties by the smallest id.

    Unsupported cells keep the true distance to the nearest station and have no station.
    """
    best = nearest_stations(cells, stations, 1).select("row", "col", F.struct("distance_km", "station_id").alias("n"))
    inside = F.lit(True) if config.max_distance_km is None else F.col("n.distance_km") <= config.max_distance_km
    best = cells.select("row", "col").join(best, ["row", "col"], "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
    return best.select(
        "row", "col", F.when(F.col("inside"), F.col("n.station_id")).alias("station_id"), F.when(F.col("inside"), 1.0).otherwise(0.0).alias("weight"),
        F.coalesce("n.distance_km", F.lit(float("inf"))).alias("nearest_km"), F.col("inside").cast("int").alias("neighbor_count"),
    )


def idw_plan(cells: DataFrame, stations: DataFrame, config: IDWConfig) -> DataFrame:
    """(row, col, station_id, weight, nearest_km, neighbor_count); unsupported cells have one row without a station.

    A station within the exact tolerance takes its cell alone.  Without a neighbour in the
    radius the nearest distance is infinite.
    """
    cell = Window.partitionBy("row", "col")
    ranked = nearest_stations(cells, stations, config.neighbors)
    if config.max_distance_km is not None:
        ranked = ranked.where(F.col("distance_km") <= config.max_distance_km)
    ranked = ranked.withColumns({"neighbor_count": F.count(F.lit(1)).over(cell).cast("int"), "nearest_km": F.min("distance_km").over(cell)})
    exact = F.col("nearest_km") <= config.exact_tolerance_m / 1000
    raw = F.when(exact, F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).otherwise(F.pow(F.greatest("distance_km", F.lit(1e-300)), F.lit(-config.power)))
    ranked = ranked.withColumn("supported", exact | (F.col("neighbor_count") >= config.minimum_neighbors)).withColumn("raw", raw)
    ranked = ranked.withColumn("weight", F.col("raw") / F.sum("raw").over(cell))
    used = ranked.where("(supported and weight > 0) or (not supported and rank = 1)")
    used = used.select("row", "col", F.when(F.col("supported"), F.col("station_id")).alias("station_id"), F.when(F.col("supported"), F.col("weight")).otherwise(0.0).alias("weight"), "nearest_km", "neighbor_count")
    out = cells.select("row", "col").join(used, ["row", "col"], "left")
    return out.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "nearest_km": F.coalesce("nearest_km", F.lit(float("inf"))), "neighbor_count": F.coalesce("neighbor_count", F.lit(0))})


# -- triangles -------------------------------------------------------------------------


def linear_plan(cells: DataFrame, stations: DataFrame, grid: Grid, config: LinearConfig | None = None) -> DataFrame:
    """Barycentric weights of the station triangle that holds each cell, on an azimuthal plane about the grid's centre.

    Triangles are laid on squares of about their own size, of as many sizes as there are;
    a cell looks into the one square of each size that holds it.
    """
    config = config or LinearConfig()
    lon0, lat0 = grid.center
    x, y = geo.azimuthal_equidistant(F.col("lon"), F.col("lat"), lon0, lat0)
    points = stations.select("station_id", x.alias("x"), y.alias("y"))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.hypot("x", "y")).alias("far")).first()
    if size.n < 3:
        raise ValueError("linear interpolation takes 3 stations at least")
    distance = lambda a, b, c, d: 2 * geo.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))
    extent = max(size.far, *(distance(*map(math.radians, (lon0, lat0, a, b))) for a, b in grid.corners))
    if extent > config.maximum_extent_km:
        raise ValueError(f"stations and grid span {extent:.0f} km from their centre, over maximum_extent_km={config.maximum_extent_km:.0f}")
    shapes = triangulate(points)
    wide = F.greatest(*[F.expr(f"greatest({a}0, {a}1, {a}2) - least({a}0, {a}1, {a}2)") for a in "xy"])
    shapes = shapes.withColumn("level", F.ceil(F.log2(wide)).cast("int"))
    sizes = [r[0] for r in shapes.select("level").distinct().collect()]  # powers of two, a few dozen at most
    if not sizes:
        raise ValueError("the stations can't be triangulated: they lie on a line; use idw or nearest")
    tile = F.pow(F.lit(2.0), F.col("level"))
    span = lambda names: F.sequence(F.floor(F.least(*names) / tile), F.floor(F.greatest(*names) / tile))
    placed = shapes.select("*", F.explode(span(("x0", "x1", "x2"))).alias("tx")).select("*", F.explode(span(("y0", "y1", "y2"))).alias("ty"))
    # Broadcast joins keep the partitions of their left side, and a small file of cells is one.
    dealt = dealt_cells(cells.select("row", "col", x.alias("x"), y.alias("y")), cell_parts(cells))
    at = dealt.select("row", "col", "x", "y", F.explode(F.array(*map(F.lit, sizes))).alias("level"))
    at = at.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    met = at.join(placed, ["level", "tx", "ty"])
    det = F.expr("(y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)")
    met = met.withColumn("w0", F.expr("(y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)") / det).withColumn("w1", F.expr("(y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)") / det)
    met = met.withColumn("w2", 1 - F.col("w0") - F.col("w1")).where("least(w0, w1, w2) >= -1e-12")
    one = met.groupBy("row", "col").agg(F.min_by(F.array(*[F.struct(F.col(f"s{k}").alias("station_id"), F.col(f"w{k}").alias("weight")) for k in range(3)]), F.struct("s0", "s1", "s2")).alias("v"))
    rows_of = one.select("row", "col", F.inline("v"))
    near = nearest_plan(cells, stations, NearestConfig(allow_extrapolation=True)).select("row", "col", "nearest_km")
    out = near.join(rows_of, ["row", "col"], "left")
    return out.select("row", "col", "station_id", F.coalesce("weight", F.lit(0.0)).alias("weight"), "nearest_km", F.when(F.col("station_id").isNull(), 0).otherwise(3).alias("neighbor_count"))


def build_plan(spark: SparkSession, stations: DataFrame, grid: Grid, method: str = "idw", config: IDWConfig | NearestConfig | LinearConfig | None = None) -> DataFrame:
    kinds = {"idw": IDWConfig, "nearest": NearestConfig, "linear": LinearConfig}
    if method not in kinds:
        raise ValueError(f"unknown method {method!r}")
    if config is None and method == "linear":
        config = LinearConfig()
    if not isinstance(config, kinds[method]):
        raise TypeError(f"method {method!r} takes a {kinds[method].__name__}")
    stations, cells = check_stations(stations, 3 if method == "linear" else 1), grid.cells(spark)
    if method == "idw":
        return idw_plan(cells, stations, config)
    return nearest_plan(cells, stations, config) if method == "nearest" else linear_plan(cells, stations, grid, config)


def apply_plan(plan: DataFrame, values: DataFrame, transform: str = "identity") -> DataFrame:
    """(row, col, value, supported, nearest_km, neighbor_count) from (station_id, value); unsupported cells are null."""
    value = F.col("value").cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    stop = F.raise_error(F.concat(F.lit("the value of station "), F.col("station_id").cast("string"), F.lit(" is not finite"))).cast("double")
    values = values.withColumn("value", F.when(bad, stop).otherwise(value))
    moved = values.select("station_id", geo.forward_transform(F.col("value"), transform).alias("_v"))
    joined = plan.join(moved, "station_id", "left")
    missing = F.raise_error(F.concat(F.lit("no value for station "), F.col("station_id").cast("string")))
    part = F.when(F.col("station_id").isNotNull() & F.col("_v").isNull(), missing.cast("double")).otherwise(F.col("weight") * F.col("_v"))
    out = joined.groupBy("row", "col").agg(F.sum(part).alias("value"), F.max(F.col("station_id").isNotNull()).alias("supported"), F.max("nearest_km").alias("nearest_km"), F.max("neighbor_count").alias("neighbor_count"))
    return out.withColumn("value", F.when(F.col("supported"), geo.inverse_transform(F.col("value"), transform)))


def interpolate_surface(spark: SparkSession, stations: DataFrame, grid: Grid, method: str = "idw", config=None, transform: str = "identity") -> DataFrame:
    """stations: (station_id, lat, lon, value)."""
    return apply_plan(build_plan(spark, stations, grid, method, config), stations, transform)


def sample_nearest(surface: DataFrame, grid: Grid, points: DataFrame) -> DataFrame:
    """points (lat, lon, ...) with the value of the cell whose row and column centres are nearest, each on its own (ties: the lower)."""

    def index(value: Column, low: float, high: float, n: int) -> Column:
        at = (value - low) / ((high - low) / n)
        return F.least(F.greatest(F.ceil(at) - 1, F.lit(0)), F.lit(n - 1)).cast("int")

    placed = points.withColumn("row", index(F.col("lat"), grid.south, grid.north, grid.shape[0])).withColumn("col", index(F.col("lon"), grid.west, grid.east, grid.shape[1]))
    return placed.join(surface.select("row", "col", "value"), ["row", "col"], "left")


def surface_metadata(method: str, config, transform: str = "identity", metric_name: str = "generic", unit: str | None = None, component_definition: str | None = None, stations: Sequence | None = None) -> dict:
    """What a surface was made with, as written beside it."""
    parameters = {k: str(v) for k, v in vars(config).items()}
    return {"method": method, "transform": transform, "metric_name": metric_name, "unit": unit, "component_definition": component_definition, "station_count": None if stations is None else len(stations), "parameters": parameters}
