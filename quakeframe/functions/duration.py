"""The cumulative-duration rule: seconds to samples."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FractionalDurationWarning

POLICIES = ("ceil", "nearest", "floor")


def duration_sample_count(duration_s: float, rate: float, policy: str = "ceil", warn: bool = True) -> int:
    """Samples that a duration asks for, at least one; ``nearest`` rounds halves up."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if not (math.isfinite(duration_s) and duration_s > 0 and math.isfinite(rate) and rate > 0):
        raise ValueError("duration and sampling rate must be finite and greater than zero")
    exact = duration_s * rate
    if warn and abs(exact - round(exact)) > 1e-9 * max(1.0, exact):
        warnings.warn(f"{duration_s} s at {rate} Hz is {exact:g} samples; {policy} is applied", FractionalDurationWarning, stacklevel=2)
    count = {"ceil": math.ceil(exact - 1e-12), "nearest": math.floor(exact + 0.5), "floor": math.floor(exact + 1e-12)}[policy]
    if count < 1:
        raise ValueError("the duration is shorter than one sample")
    return count


def sample_count_column(duration_s: Column, rate: Column, policy: str = "ceil") -> Column:
    """The same for columns; a count under one stops the query."""
    exact = duration_s * rate
    count = {"ceil": F.ceil(exact - 1e-12), "nearest": F.floor(exact + 0.5), "floor": F.floor(exact + 1e-12)}[policy]
    return F.when(count < 1, F.raise_error(F.lit("the duration is shorter than one sample"))).otherwise(count).cast("long")


def time_axis(index: Column, rate: Column | float, start_s: float = 0.0) -> Column:
    return index / (F.lit(float(rate)) if isinstance(rate, int | float) else rate) + F.lit(float(start_s))
