"""Delaunay triangulation of any number of points in tiles.

A tile triangulates its own points with those of a margin around it.  A triangle with a
point of the tile stands if no point lies in its circle.  Circles within the margin are
known to be empty; the others, and the half planes beyond edges of the hull, are asked of
the tiles that they touch, which answer with the point farthest inside.  Tiles that get an
answer take the points in and triangulate again, until none is left to ask.  A triangle is
given by the tile of its smallest point.

Points are moved by up to a millimetre, each by a hash of its id, for the triangulation
alone: points on one circle get the same diagonal from every tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written
from .tiles import Tiles, even_tiles

#: Points of a tile, its margin as a share of its sides, and how far points are moved (km).
TILE, MARGIN, MOVE_KM = 2048, 0.25, 1e-6
INFINITE = -1


def _circles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of each triangle's circle."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]]
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b**2).sum(axis=1), (c**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.column_stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb]) / d[:, None]
    return np.column_stack([u + a, (u**2).sum(axis=1)])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the area of a, b, c, positive if they turn left."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Positive where p lies in the circle of a, b, c (turning left); from differences to p, so that flat triangles are judged right."""
    a, b, c = a - p, b - p, c - p
    aa, bb, cc = ((q**2).sum(axis=-1) for q in (a, b, c))
    return aa * (b[..., 0] * c[..., 1] - b[..., 1] * c[..., 0]) - bb * (a[..., 0] * c[..., 1] - a[..., 1] * c[..., 0]) + cc * (a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0])


def _flat(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Triangles whose circle can't be told well from rounded numbers."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    longest = np.maximum.reduce([((x - y) ** 2).sum(axis=1) for x, y in ((a, b), (b, c), (c, a))])
    return np.abs(_turn(a, b, c)) < 1e-5 * longest


def delaunay(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (turning left) and edges of the hull (the outside on their left) of points in the plane.

    Points come from west to east.  Each removes the triangles whose circle holds it, and
    the hull's edges that it lies outside of, and joins to the rim of the hole.  Triangles
    whose circle ends west of the next point are done and leave the search, unless they are flat.
    """
    order = np.lexsort((points[:, 1], points[:, 0]))
    p = points[order] - points.mean(axis=0) if len(points) else points
    n = len(p)
    third = 2
    while third < n and abs(_turn(p[0], p[1], p[third])) <= 1e-9 * MOVE_KM:
        third += 1
    if third >= n:
        return np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    a, b, c = (0, 1, third) if _turn(p[0], p[1], p[third]) > 0 else (1, 0, third)
    tri = np.array([[a, b, c], [b, a, INFINITE], [c, b, INFINITE], [a, c, INFINITE]])
    circle = np.vstack([_circles(p, tri[:1]), np.full((3, 3), np.nan)])
    done = []
    for k in [*range(2, third), *range(third + 1, n)]:
        real = tri[:, 2] != INFINITE
        bad = np.zeros(len(tri), bool)
        inner, rim = np.flatnonzero(real), np.flatnonzero(~real)
        bad[inner] = _in_circle(p[tri[inner, 0]], p[tri[inner, 1]], p[tri[inner, 2]], p[k]) > 0
        bad[rim] = _turn(p[tri[rim, 0]], p[tri[rim, 1]], p[k]) > 0
        hole = tri[bad]
        edges = np.concatenate([hole[:, [0, 1]], hole[:, [1, 2]], hole[:, [2, 0]]])
        code = (edges[:, 0] + 1) * (n + 2) + edges[:, 1] + 1
        back = (edges[:, 1] + 1) * (n + 2) + edges[:, 0] + 1
        edges = edges[~np.isin(back, code)]
        new = np.column_stack([edges, np.full(len(edges), k)])
        # The infinite point last, the turn kept.
        first, second = new[:, 0] == INFINITE, new[:, 1] == INFINITE
        new[first] = new[first][:, [1, 2, 0]]
        new[second] = new[second][:, [2, 0, 1]]
        made = np.full((len(new), 3), np.nan)
        inner = new[:, 2] != INFINITE
        made[inner] = _circles(p, new[inner])
        made[np.flatnonzero(inner)[_flat(p, new[inner])]] = np.nan
        tri, circle = np.vstack([tri[~bad], new]), np.vstack([circle[~bad], made])
        if k % 16 == 0:
            with np.errstate(invalid="ignore"):
                over = circle[:, 0] + np.sqrt(circle[:, 2]) < p[k, 0]
            if over.any():
                done.append(tri[over])
                tri, circle = tri[~over], circle[~over]
    whole = np.concatenate([*done, tri])
    real = whole[:, 2] != INFINITE
    return order[whole[real]], order[whole[~real][:, :2]]


def _tile_answer(pdf: pd.DataFrame, rects: np.ndarray, boxes: np.ndarray, whole: np.ndarray) -> tuple[list, list]:
    """Triangles of a tile's points, and what it must ask of other tiles.

    rects: each tile's rectangle with its margin; boxes: the extent of each tile's points;
    whole: the extent of all.
    """
    tile = int(pdf["tile"].iloc[0])
    pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
    p, own, key = pdf[["jx", "jy"]].to_numpy(float), pdf["own"].to_numpy(bool), pdf["key"].to_numpy()
    tri, hull = delaunay(p)
    mine = own[tri].any(axis=1)
    tri = tri[mine]
    tri_sorted = np.sort(tri, axis=1)  # rows stand by key
    given = own[tri_sorted[:, 0]]
    xy = pdf[["x", "y"]].to_numpy(float)
    triangles = []
    for t in tri_sorted[given]:
        triangles.append((tile, *key[t].tolist(), *xy[t].ravel().tolist()))
    # Circles, cut to the extent of all points, that reach over the margin.
    middle = p.mean(axis=0) if len(p) else np.zeros(2)
    circle = _circles(p - middle, tri) + np.array([*middle, 0.0]) if len(tri) else np.zeros((0, 3))
    r = np.sqrt(circle[:, 2])
    low = np.maximum(circle[:, :2] - r[:, None], whole[[0, 2]])
    high = np.minimum(circle[:, :2] + r[:, None], whole[[1, 3]])
    x0, x1, y0, y1 = rects[tile]
    inside = (low[:, 0] >= x0) & (high[:, 0] < x1) & (low[:, 1] >= y0) & (high[:, 1] < y1)
    inside |= (low > high).any(axis=1)
    flat = _flat(p, tri)
    inside &= ~flat
    asked = []
    known = (boxes[:, 0] >= x0) & (boxes[:, 1] < x1) & (boxes[:, 2] >= y0) & (boxes[:, 3] < y1)
    number = 0
    for k in np.flatnonzero(~inside).tolist():
        cx, cy, rr = circle[k].tolist()
        dx = np.maximum(np.maximum(boxes[:, 0] - cx, cx - boxes[:, 1]), 0)
        dy = np.maximum(np.maximum(boxes[:, 2] - cy, cy - boxes[:, 3]), 0)
        touched = ~known & (flat[k] | (dx * dx + dy * dy < rr * (1 + 1e-6))) & np.isfinite(boxes[:, 0])
        corners = p[tri[k]].ravel().tolist()
        asked += [(tile, number, other, *corners) for other in np.flatnonzero(touched).tolist()]
        number += 1
    for a, b in hull[own[hull].any(axis=1)].tolist():
        # Outside: -(y_b - y_a) (x - x_a) + (x_b - x_a) (y - y_a) > 0.
        nx, ny = -(p[b, 1] - p[a, 1]), p[b, 0] - p[a, 0]
        most = nx * np.where(nx > 0, boxes[:, 1], boxes[:, 0]) + ny * np.where(ny > 0, boxes[:, 3], boxes[:, 2])
        touched = ~known & (most >= nx * p[a, 0] + ny * p[a, 1]) & np.isfinite(boxes[:, 0])
        asked += [(tile, number, other, *p[a].tolist(), *p[b].tolist(), math.nan, math.nan) for other in np.flatnonzero(touched).tolist()]
        number += 1
    return triangles, asked


def triangulate(points: DataFrame, size: int = TILE, margin: float = MARGIN) -> DataFrame:
    """(s0, s1, s2, x0, y0, ..., y2) of the triangles over points (station_id, x, y), s0 < s1 < s2, written."""
    kind = dict(points.dtypes)["station_id"]
    move = lambda salt: F.pmod(F.xxhash64(F.col("station_id"), F.lit(salt)), F.lit(2_000_001)) / 1e6 - 1
    rows = points.select("station_id", "x", "y", (F.col("x") + move(1) * MOVE_KM).alias("jx"), (F.col("y") + move(2) * MOVE_KM).alias("jy"))
    rows = written(rows)
    n = rows.count()
    tiles = even_tiles(rows, "jx", "jy", size, n)
    dealt = written(tiles.deal(rows, "jx", "jy"))
    discard(rows)
    extent = {r["tile"]: (r[1], r[2], r[3], r[4]) for r in dealt.groupBy("tile").agg(F.min("jx"), F.max("jx"), F.min("jy"), F.max("jy")).collect()}  # a row for each tile
    plain = tiles.rectangles()
    boxes = np.array([extent.get(k, (math.inf, -math.inf, math.inf, -math.inf)) for k in range(len(plain))])
    filled = boxes[[k in extent for k in range(len(plain))]]
    whole = np.array([filled[:, 0].min(), filled[:, 1].max(), filled[:, 2].min(), filled[:, 3].max()]) if len(filled) else np.zeros(4)
    with np.errstate(invalid="ignore"):
        width, height = np.where(np.isfinite(boxes[:, 1] - boxes[:, 0]), boxes[:, 1] - boxes[:, 0], 0), np.where(np.isfinite(boxes[:, 3] - boxes[:, 2]), boxes[:, 3] - boxes[:, 2], 0)
    rects = plain + margin * np.column_stack([-width, width, -height, height])
    spark = points.sparkSession
    near = list(_neighbours(tiles, rects, boxes))
    around = spark.createDataFrame(near, "tile int, other int, a double, b double, c double, d double") if near else None
    owned = dealt.select("tile", F.col("station_id").alias("key"), "x", "y", "jx", "jy", F.lit(True).alias("own"))
    members = owned
    if around is not None:
        there = dealt.withColumnRenamed("tile", "other")
        halo = there.join(around, "other").where("jx >= a and jx < b and jy >= c and jy < d")
        members = owned.union(halo.select("tile", F.col("station_id").alias("key"), "x", "y", "jx", "jy", F.lit(False).alias("own")))
    members = written(members)
    out_kind = f"tile int, s0 {kind}, s1 {kind}, s2 {kind}, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, number int, other int, ax double, ay double, bx double, by double, cx double, cy double"
    names = [part.strip().split(" ")[0] for part in out_kind.split(",")]

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        triangles, asked = _tile_answer(pdf, rects, boxes, whole)
        made = pd.DataFrame(triangles, columns=names[:10])
        more = pd.DataFrame(asked, columns=["tile", *names[10:]])
        if not asked:
            return made.reindex(columns=names)
        return (pd.concat([made, more]) if triangles else more).reindex(columns=names)

    found, todo, extra, parts = None, members, None, len(plain)
    while True:
        # Tiles are few bytes and much work: a task for about each, which adaptive execution doesn't merge.
        step = written(todo.repartition(parts, "tile").groupBy("tile").applyInPandas(answer, out_kind))
        conflicts = written(_conflicts(step, dealt, rects, spark, extra))
        again = conflicts.select("tile").distinct()
        stands = step.where("number is null").select(*names[:10])
        if conflicts.isEmpty():
            found = stands if found is None else found.union(stands)
            break
        stands = stands.join(again, "tile", "left_anti")
        found = stands if found is None else found.union(stands)
        extra = written(conflicts if extra is None else extra.union(conflicts))
        todo, parts = members.join(again, "tile", "left_semi").union(extra.join(again, "tile", "left_semi")), again.count()
    area = F.abs(F.expr("(x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)"))
    longest = F.greatest(*[F.expr(f"pow(x{a} - x{b}, 2) + pow(y{a} - y{b}, 2)") for a, b in ((0, 1), (1, 2), (2, 0))])
    out = written(found.where(area > 1e-11 * longest + 10 * MOVE_KM * F.sqrt(longest)).select(*names[1:10]))
    discard(members, dealt)
    return out


def _neighbours(tiles: Tiles, rects: np.ndarray, boxes: np.ndarray) -> Iterator[tuple]:
    """(tile, other, margin of the tile) where the margin reaches the other's points."""
    first = tiles.first
    for tile, (a, b, c, d) in enumerate(rects.tolist()):
        if not np.isfinite(boxes[tile]).all():
            continue
        for strip in range(int(np.searchsorted(tiles.u, a, "right")), int(np.searchsorted(tiles.u, b, "left")) + 1):
            cuts = tiles.v[strip]
            for other in range(first[strip] + int(np.searchsorted(cuts, c, "right")), first[strip] + int(np.searchsorted(cuts, d, "left")) + 1):
                if other != tile and boxes[other, 0] < b and boxes[other, 1] >= a and boxes[other, 2] < d and boxes[other, 3] >= c:
                    yield tile, other, a, b, c, d


def _conflicts(step: DataFrame, dealt: DataFrame, rects: np.ndarray, spark, extra: DataFrame | None) -> DataFrame:
    """Points of other tiles that lie in a circle or half plane which a tile asked about, the farthest inside of each tile."""
    asked = step.where("number is not null").select("tile", "number", "other", "ax", "ay", "bx", "by", "cx", "cy")
    margins = spark.createDataFrame([(k, *r) for k, r in enumerate(rects.tolist())], "tile int, a double, b double, c double, d double")
    square = lambda q: f"(({q}x - jx) * ({q}x - jx) + ({q}y - jy) * ({q}y - jy))"
    minor = lambda q, r: f"(({q}x - jx) * ({r}y - jy) - ({q}y - jy) * ({r}x - jx))"
    inside = F.expr(f"{square('a')} * {minor('b', 'c')} - {square('b')} * {minor('a', 'c')} + {square('c')} * {minor('a', 'b')}")
    beyond = F.expr("(bx - ax) * (jy - ay) - (by - ay) * (jx - ax)")
    depth = F.when(F.col("cx").isNull(), beyond).otherwise(inside)
    over = depth > 0
    met = asked.join(margins, "tile").join(dealt.withColumnRenamed("tile", "other"), "other").where(over).where("not (jx >= a and jx < b and jy >= c and jy < d)")
    if extra is not None:
        met = met.join(extra.select("tile", F.col("key").alias("station_id")), ["tile", "station_id"], "left_anti")
    deepest = met.groupBy("tile", "number", "other").agg(F.max_by(F.struct("station_id", "x", "y", "jx", "jy"), F.struct(depth, "station_id")).alias("s"))
    return deepest.select("tile", F.col("s.station_id").alias("key"), "s.x", "s.y", "s.jx", "s.jy", F.lit(False).alias("own")).distinct()
