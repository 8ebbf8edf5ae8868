"""Operators for plain SQL text: ``register(spark)`` adds them to a session.

* ``oscillator_spectrum(samples, rate, damping, periods)``, a table function: period_s, sd_cm
  and sv_cm_s of one component's samples (an array of gal), for a LATERAL join;
* ``intensity_filter(rate, name)``, a table function: the sections of a causal intensity filter;
* ``duration_threshold(amplitude, count)``, an aggregate: the count-th largest value, null if
  there are fewer;
* the source ``published_table``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import design, kernels
from .sources import published


class OscillatorSpectrum:
    def __init__(self) -> None:
        self.banks: dict[tuple, kernels.BankFilter] = {}

    def eval(self, samples: list, rate: float, damping: float, periods: list) -> Iterator[tuple]:
        key = (rate, damping, tuple(periods))
        if key not in self.banks:
            self.banks[key] = kernels.BankFilter(design.oscillator_bank(tuple(periods), damping, rate))
        x = np.asarray(samples, float)[:, None]
        if not len(x):
            return
        bank, peak = self.banks[key], np.zeros((2, len(periods)))
        for _, y in bank.run(x, bank.start(x[0])):
            peak = np.maximum(peak, np.abs(y[..., 0]).max(axis=2))
        for k, t in enumerate(periods):
            yield t, float(peak[0, k]), float(peak[1, k])


class IntensityFilter:
    def eval(self, rate: float, name: str) -> Iterator[tuple]:
        for k, section in enumerate(design.design_realtime_filter(rate, name).sections):
            yield k, *map(float, section)


def duration_threshold(amplitude: pd.Series, count: pd.Series) -> float:
    values = amplitude.dropna().to_numpy()
    k = int(count.iloc[0])
    return float(np.partition(values, len(values) - k)[len(values) - k]) if 1 <= k <= len(values) else None


def register(spark: SparkSession) -> None:
    published.register(spark)
    spark.udtf.register("oscillator_spectrum", F.udtf(OscillatorSpectrum, returnType="period_s double, sd_cm double, sv_cm_s double"))
    spark.udtf.register("intensity_filter", F.udtf(IntensityFilter, returnType="section int, b0 double, b1 double, b2 double, a0 double, a1 double, a2 double"))
    spark.udf.register("duration_threshold", F.pandas_udf(duration_threshold, "double"))
