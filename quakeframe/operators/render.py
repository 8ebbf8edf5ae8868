"""Surfaces as colours, and the data frames behind the figures and maps (drawing itself is left to the caller)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import response, scale
from . import design
from .motion import record_window, resultant, thin

PALETTE_SIZE = 256


def hex_to_rgb(color: Column) -> list[Column]:
    """Three channels of #rrggbb."""
    return [F.conv(F.substring(color, p, 2), 16, 10).cast("int") for p in (2, 4, 6)]


def palette(spark: SparkSession, stops: list[tuple[float, str]]) -> DataFrame:
    """(index, r, g, b): 256 steps linear between (position, #rrggbb) stops."""
    at = np.linspace(0, 1, PALETTE_SIZE)
    channels = [np.interp(at, [p for p, _ in stops], [int(c[k : k + 2], 16) for _, c in stops]) for k in (1, 3, 5)]
    rows = [(k, *(int(round(c[k])) for c in channels)) for k in range(PALETTE_SIZE)]
    return spark.createDataFrame(rows, "index int, r int, g int, b int")


def on_land(surface: DataFrame, land: DataFrame | None) -> DataFrame:
    """Supported cells, of the land cells (row, col) if those are given."""
    visible = surface.where("supported")
    return visible if land is None else visible.join(land.select("row", "col"), ["row", "col"], "left_semi")


def land_cells(cells: DataFrame, raster: DataFrame, west: float, south: float, resolution: float) -> DataFrame:
    """Cells whose centre's nearest raster point (half to even) is in the land raster (r, c); outside its coverage: none."""
    r, c = F.rint((F.col("lat") - south) / resolution).cast("long"), F.rint((F.col("lon") - west) / resolution).cast("long")
    return cells.withColumn("r", r).withColumn("c", c).join(raster.select("r", "c"), ["r", "c"], "left_semi").select("row", "col")


def surface_colors(surface: DataFrame, colors: DataFrame, cmin: float, cmax: float, transform: str = "identity", opacity: float = 0.6, land: DataFrame | None = None) -> DataFrame:
    """(row, col, r, g, b, a) of visible cells: the value's place between cmin and cmax, clipped, rounded half to even."""
    if not cmin < cmax or not 0 <= opacity <= 1 or (transform == "log" and cmin <= 0):
        raise ValueError("cmin must be less than cmax (and positive for log) and opacity lie between zero and one")
    move = F.ln if transform == "log" else (lambda c: c)
    low, high = move(F.lit(float(cmin))), move(F.lit(float(cmax)))
    value = F.greatest(F.col("value"), F.lit(float(cmin))) if transform == "log" else F.col("value")
    place = F.least(F.greatest((move(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    index = F.rint(place * (PALETTE_SIZE - 1)).cast("int")
    seen = on_land(surface, land).withColumn("index", index)
    return seen.join(F.broadcast(colors), "index").select("row", "col", "r", "g", "b", F.lit(round(opacity * 255)).alias("a"))  # 256 rows


def class_colors(surface: DataFrame, colors: dict[float, str], opacity: float = 0.6, land: DataFrame | None = None) -> DataFrame:
    """(row, col, r, g, b, a) of cells whose value equals a class up to 1e-9."""
    chosen = F.lit(None).cast("string")
    for value, color in colors.items():
        chosen = F.when(F.abs(F.col("value") - value) <= 1e-9, F.lit(color)).otherwise(chosen)
    seen = on_land(surface, land).withColumn("color", chosen).where("color is not null")
    return seen.select("row", "col", *[c.alias(n) for c, n in zip(hex_to_rgb(F.col("color")), "rgb", strict=True)], F.lit(round(opacity * 255)).alias("a"))


def encode_png(rgba: np.ndarray) -> bytes:
    """A PNG file of (rows, cols, 4) bytes, top row first; for an image of one grid, which its max_cells bounds."""
    rows, cols, _ = rgba.shape
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), rgba.reshape(rows, cols * 4).astype(np.uint8)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def colors_to_png(colors: DataFrame, shape: tuple[int, int]) -> bytes:
    """One grid's colours (bounded by the grid's cells) as an image with north on top."""
    image = np.zeros((*shape, 4), np.uint8)
    for r in colors.select("row", "col", "r", "g", "b", "a").toLocalIterator():
        image[shape[0] - 1 - r["row"], r["col"]] = (r["r"], r["g"], r["b"], r["a"])
    return encode_png(image)


# -- frames behind figures -------------------------------------------------------------


def acceleration_frame(df: DataFrame, rate: float, most: int = 20_000) -> DataFrame:
    """Time, components and the sample of each record's greatest resultant, thinned."""
    marked = df.withColumn("resultant", resultant([c for c in ("c0", "c1", "c2") if c in df.columns]))
    first = F.max_by("i", F.struct("resultant", -F.col("i"))).over(record_window())
    return thin(marked.withColumn("peak_sample", first).withColumn("time_s", F.col("i") / F.lit(float(rate))), most)


def amplitude_duration_frame(curve: DataFrame, count: int, most: int = 20_000) -> DataFrame:
    """The curve thinned, with the point of the duration rule marked."""
    return thin(curve.withColumn("selected", F.col("rank") == count), most, "rank")


def response_frame(spark: SparkSession, made: design.Design, frequencies: DataFrame | None = None, points: int = 4096) -> DataFrame:
    """(frequency_hz, re, im, amplitude, phase_rad) from 0 up to Nyquist, or over a given column frequency_hz."""
    grid = frequencies if frequencies is not None else spark.range(points).select((F.col("id") * (made.nyquist_hz / points)).alias("frequency_hz"))
    re, im = response.cascade_response(F.col("frequency_hz"), made.rate, list(made.sections))
    return response.unwrapped_phase(grid.select("frequency_hz", re.alias("re"), im.alias("im")))


def stages_frame(spark: SparkSession, made: design.Design, frequencies: DataFrame) -> DataFrame:
    """(stage, frequency_hz, amplitude) of each analog factor and of the whole."""
    out = None
    for name, _, section in (*made.stages, ("combined", None, None)):
        sections = list(made.sections) if section is None else [section]
        re, im = response.cascade_response(F.col("frequency_hz"), made.rate, sections)
        part = frequencies.select(F.lit(name).alias("stage"), "frequency_hz", F.hypot(re, im).alias("amplitude"))
        out = part if out is None else out.unionByName(part)
    return out


def geometric_frequencies(spark: SparkSession, low: float, high: float, points: int) -> DataFrame:
    step = (high / low) ** (1 / max(points - 1, 1))
    return spark.range(points).select((F.lit(float(low)) * F.pow(F.lit(step), F.col("id").cast("double"))).alias("frequency_hz"))


def components_frame(spark: SparkSession, low: float = 0.01, high: float = 100.0, points: int = 2000) -> DataFrame:
    parts = response.measured_filter_components(F.col("frequency_hz"))
    return geometric_frequencies(spark, low, high, points).select("frequency_hz", *[p.alias(n) for p, n in zip(parts, ("period_effect", "high_cut", "low_cut", "combined"), strict=True)])


def intensity_bands(spark: SparkSession, low: float, high: float) -> DataFrame:
    """Class intervals clipped to an axis range."""
    rows = scale.intensity_intervals(spark).where((F.col("upper") > low) & (F.col("lower") < high))
    return rows.withColumn("lower", F.greatest("lower", F.lit(float(low)))).withColumn("upper", F.least("upper", F.lit(float(high))))


def map_frame(stations: DataFrame, kind: str = "intensity") -> DataFrame:
    """Stations with their class; drawn as one group per class."""
    name = {"intensity": scale.classify_intensity, "long_period": scale.classify_long_period}[kind]
    return stations.withColumn("class", name(F.col("value")))


def map_layout(stations: DataFrame) -> DataFrame:
    """Mean centre and span in degrees."""
    return stations.agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("span_deg"))


def color_values(stations: DataFrame, transform: str = "identity") -> DataFrame:
    """Adds color_value: the value, or its logarithm to base ten."""
    bad = F.raise_error(F.lit("a log colour scale needs values greater than zero")).cast("double")
    return stations.withColumn("color_value", F.when(F.col("value") <= 0, bad).otherwise(F.log10("value")) if transform == "log" else F.col("value"))
