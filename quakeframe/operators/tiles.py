"""Tiles of about equally many points: strips by one coordinate, cut by the other.

Cut points are approximate quantiles, which Spark aggregates in part before it shuffles, so
tiles follow the points however clustered they are.  The driver sees the cuts alone, one
number for each tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiles:
    """cuts of u between strips, and of v within each strip; tile numbers run through the strips."""

    u: list[float]
    v: list[list[float]]

    @property
    def first(self) -> list[int]:
        """The number of each strip's first tile."""
        return np.cumsum([0, *(len(c) + 1 for c in self.v)]).tolist()

    def rectangles(self) -> np.ndarray:
        """(u low, u high, v low, v high) of each tile, half open, without end at the rims."""
        rows = []
        for a, b, cuts in zip([-math.inf, *self.u], [*self.u, math.inf], self.v, strict=True):
            rows += [(a, b, c, d) for c, d in zip([-math.inf, *cuts], [*cuts, math.inf], strict=True)]
        return np.array(rows)

    def deal(self, points: DataFrame, u: str, v: str, code: bool = False) -> DataFrame:
        """points with their tile's number, or with ``code``, which interleaves the bits of the strip and the place in it."""
        spark = points.sparkSession
        strips = spark.createDataFrame([(k, n, c) for k, (n, c) in enumerate(zip(self.first[:-1], self.v, strict=True))], "_strip int, _first int, _cuts array<double>")
        below = lambda cuts, x: F.size(F.filter(cuts, lambda c: c <= x))
        own = F.array(*map(F.lit, self.u)) if self.u else F.array().cast("array<double>")
        placed = points.withColumn("_strip", below(own, F.col(u))).join(F.broadcast(strips), "_strip")  # as many strips as the root of the tiles
        place = below(F.col("_cuts"), F.col(v))
        if not code:
            return placed.withColumn("tile", F.col("_first") + place).drop("_strip", "_first", "_cuts")
        bit = lambda c, b, to: F.shiftleft(F.shiftright(c, b).bitwiseAND(1).cast("long"), to)
        mixed = sum((bit(F.col("_strip"), b, 2 * b + 1) + bit(place, b, 2 * b) for b in range(self.bits)), F.lit(0).cast("long"))
        return placed.withColumn("code", mixed).drop("_strip", "_first", "_cuts")

    @property
    def bits(self) -> int:
        """Bits of the greatest strip or place."""
        return max(len(self.u), *(len(c) for c in self.v)).bit_length()


def even_tiles(points: DataFrame, u: str, v: str, size: int, n: int) -> Tiles:
    """Tiles of about ``size`` of the n points."""
    if n <= size:
        return Tiles([], [[]])
    strips = max(1, math.ceil(math.sqrt(math.ceil(n / size))))
    cuts = _quantiles(points, u, strips)
    strip = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(u))) if cuts else F.lit(0)
    placed = points.select(strip.alias("strip"), F.col(v).alias("v"))
    counts = {r["strip"]: r["count"] for r in placed.groupBy("strip").count().collect()}  # a row for each strip
    most = max((math.ceil(c / size) for c in counts.values()), default=1)
    found: dict[int, list[float]] = {}
    if most > 1:
        part = F.percentile_approx("v", [k / most for k in range(1, most)], 20 * most).alias("cuts")
        for r in placed.groupBy("strip").agg(part).collect():
            wanted = math.ceil(counts[r["strip"]] / size)
            picked = [r["cuts"][k * most // wanted - 1] for k in range(1, wanted)]
            found[r["strip"]] = sorted(set(picked))
    return Tiles(cuts, [found.get(k, []) for k in range(len(cuts) + 1)])


def _quantiles(points: DataFrame, column: str, parts: int) -> list[float]:
    if parts < 2:
        return []
    found = points.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(found or []))
