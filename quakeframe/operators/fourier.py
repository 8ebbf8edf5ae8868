"""Filters defined over a whole record's discrete Fourier transform, for records of any length.

A transform of n samples becomes a circular convolution with a chirp over M >= 2n - 1 places,
M a power of two, and that a matrix of M1 x M2 places: columns are transformed, turned and
dealt to rows in square tiles, rows transformed, multiplied with the chirp's and transformed
back, and dealt to columns again.  A task holds TILE columns or rows, about TILE times the
root of M numbers.  The gain is applied between a transform and its inverse; it is real and
even, so two components travel as one complex series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64


class Plan:
    """Sides of the matrix for n samples, tile width, and the chirp exp(-i pi j^2 / n)."""

    def __init__(self, n: int, tile: int = TILE):
        bits = max((2 * n - 2).bit_length(), 2)
        self.n, self.rows, self.columns = n, 1 << bits // 2, 1 << bits - bits // 2
        self.size, self.tile = 1 << bits, min(tile, 1 << bits // 2)

    def chirp(self, j: np.ndarray) -> np.ndarray:
        return np.exp(-1j * np.pi * ((j * j) % (2 * self.n)) / self.n)

    def places(self, part: int) -> np.ndarray:
        """Places j of a part of the columns, as (rows, tile)."""
        return np.arange(self.rows)[:, None] * self.columns + (part * self.tile + np.arange(self.tile))[None]

    def kernel(self, j: np.ndarray) -> np.ndarray:
        """What is convolved with: the conjugate chirp of the distance from place 0, around the circle."""
        apart = np.minimum(j, self.size - j)
        return np.where(apart < self.n, np.conj(self.chirp(apart)), 0)

    def turn(self, row: np.ndarray, column: np.ndarray, sign: int) -> np.ndarray:
        return np.exp(sign * 2j * np.pi * ((row * column) % self.size) / self.size)

    def columns_out(self, part: int, a: np.ndarray) -> list[tuple[int, bytes]]:
        """(row part, tile) of columns (channels, rows, tile) with the kernel's channel added, transformed along the rows."""
        j = self.places(part)
        both = np.concatenate([a, self.kernel(j)[None]])
        k = np.arange(self.rows)[:, None]
        out = np.fft.fft(both, axis=1) * self.turn(k, j[:1], -1)
        return [(p, np.ascontiguousarray(out[:, p * self.tile : (p + 1) * self.tile]).tobytes()) for p in range(self.rows // self.tile)]

    def rows_through(self, part: int, a: np.ndarray) -> list[tuple[int, bytes]]:
        """(column part, tile) of rows (channels and kernel, tile, columns): convolved and turned back."""
        whole = np.fft.fft(a, axis=2)
        back = np.fft.ifft(whole[:-1] * whole[-1:], axis=2)
        k = (part * self.tile + np.arange(self.tile))[:, None]
        back *= self.turn(k, np.arange(self.columns)[None], 1)
        return [(p, np.ascontiguousarray(back[:, :, p * self.tile : (p + 1) * self.tile]).tobytes()) for p in range(self.columns // self.tile)]


def filter_whole(df: DataFrame, names: list[str], gain: Callable[[np.ndarray], np.ndarray], rate: float, tile: int = TILE) -> DataFrame:
    """(record_id, i, names) of records numbered from 0 without gaps, each component's transform times gain(frequency)."""
    kind = dict(df.dtypes)["record_id"]
    channels = (len(names) + 1) // 2
    bad = lambda c: F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    each = df.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("i").alias("last"), F.min("i").alias("first"), F.array(*[F.count(c) for c in names]).alias("have"), sum((bad(c) for c in names), F.lit(0)).alias("bad")
    )
    sound = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("bad") == 0) & F.forall("have", lambda h: (h == 0) | (h == F.col("n"))) & F.exists("have", lambda h: h > 0)
    stop = F.raise_error(F.concat(F.lit("record "), F.col("record_id").cast("string"), F.lit(" isn't numbered from 0 without gaps, or a sample is missing or not finite")))
    each = each.select("record_id", F.when(sound, F.col("n")).otherwise(stop.cast("long")).alias("n"))
    bits = F.greatest(F.ceil(F.log2(F.greatest(2 * F.col("n") - 1, F.lit(1)))), F.lit(2)).cast("int")
    half = F.floor(bits / 2)
    rows, columns = F.pow(F.lit(2.0), half).cast("int"), F.pow(F.lit(2.0), bits - half).cast("int")
    width = F.least(rows, F.lit(tile))
    each = each.withColumns({"columns": columns, "width": width})
    fresh = [F.col(c).alias(c) for c in ("record_id", "n")]  # of their own, as both sides of the first step come from one table
    parts = each.select(*fresh, F.explode(F.sequence(F.lit(0), (F.col("columns") / F.col("width")).cast("int") - 1)).alias("part"))
    samples = df.select("record_id", F.col("i").cast("long"), *names).join(each, "record_id")
    samples = samples.withColumn("part", F.floor((F.col("i") % F.col("columns")) / F.col("width")).cast("int"))
    tiles = f"record_id {kind}, n long, part int, other int, tile binary"
    made: dict[int, Plan] = {}

    def plan(n: int) -> Plan:
        if n not in made:
            made[n] = Plan(int(n), tile)
        return made[n]

    def sent(pdf: pd.DataFrame, part: int, out: list[tuple[int, bytes]]) -> pd.DataFrame:
        """Tiles on their way: part is where they go, other where they come from."""
        return pd.DataFrame({"record_id": pdf["record_id"].iloc[0], "n": pdf["n"].iloc[0], "part": [p for p, _ in out], "other": part, "tile": [t for _, t in out]})

    def begin(parts: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
        p, part = plan(parts["n"].iloc[0]), int(parts["part"].iloc[0])
        a = np.zeros((channels, p.rows, p.tile), complex)
        i = samples["i"].to_numpy()
        x = np.nan_to_num(samples[names].to_numpy(float))
        row, column = i // p.columns, i % p.columns - part * p.tile
        for c in range(len(names)):
            a[c // 2, row, column] += x[:, c] * (1j if c % 2 else 1)
        return sent(parts, part, p.columns_out(part, a * p.chirp(p.places(part))))

    def gathered(pdf: pd.DataFrame, shape: tuple[int, int, int], axis: int) -> np.ndarray:
        pdf = pdf.sort_values("other")
        return np.concatenate([np.frombuffer(t, complex).reshape(shape) for t in pdf["tile"]], axis=axis)

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        p, part = plan(pdf["n"].iloc[0]), int(pdf["part"].iloc[0])
        return sent(pdf, part, p.rows_through(part, gathered(pdf, (channels + 1, p.tile, p.tile), 2)))

    def transformed(pdf: pd.DataFrame) -> tuple[Plan, int, np.ndarray, np.ndarray]:
        """The transform at a part of the columns, zero beyond n."""
        p, part = plan(pdf["n"].iloc[0]), int(pdf["part"].iloc[0])
        j = p.places(part)
        c = np.fft.ifft(gathered(pdf, (channels, p.tile, p.tile), 1), axis=1)
        return p, part, j, np.where(j < p.n, c * p.chirp(j), 0)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        p, part, j, x = transformed(pdf)
        f = np.minimum(j, np.maximum(p.n - j, 0)) * rate / p.n
        return sent(pdf, part, p.columns_out(part, np.conj(x * gain(f)) * p.chirp(j)))

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        p, _, j, x = transformed(pdf)
        y, keep = np.conj(x) / p.n, j < p.n
        out = pd.DataFrame({"record_id": pdf["record_id"].iloc[0], "i": j[keep]})
        for c, name in enumerate(names):
            out[name] = (y[c // 2].imag if c % 2 else y[c // 2].real)[keep]
        return out

    keys = ["record_id", "n", "part"]
    first = parts.groupBy("record_id", "part").cogroup(samples.groupBy("record_id", "part")).applyInPandas(begin, tiles)
    back = first.groupBy(*keys).applyInPandas(through, tiles).groupBy(*keys).applyInPandas(weigh, tiles)
    again = back.groupBy(*keys).applyInPandas(through, tiles).groupBy(*keys)
    out = again.applyInPandas(end, f"record_id {kind}, i long, " + ", ".join(f"{c} double" for c in names))
    empty = df.groupBy("record_id").agg(*[(F.count(c) > 0).alias(f"_has_{c}") for c in names])
    return out.join(empty, "record_id").select("record_id", "i", *[F.when(F.col(f"_has_{c}"), F.col(c)).alias(c) for c in names])
