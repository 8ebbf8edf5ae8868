"""Frequency responses as Column expressions; complex numbers are (re, im) pairs of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The high-cut polynomial in (f / 10 Hz) squared.
HIGH_CUT = (1.0, 0.694, 0.241, 0.0557, 0.009664, 0.00134, 0.000155)
LOW_CUT_HZ = 0.5


def measured_filter_components(f: Column) -> tuple[Column, Column, Column, Column]:
    """Period effect, high cut, low cut and their product; at 0 Hz the period effect is infinite and the product 0."""
    y = (f / 10) * (f / 10)
    polynomial = F.lit(HIGH_CUT[-1])
    for c in reversed(HIGH_CUT[:-1]):
        polynomial = polynomial * y + c
    period = F.when(f > 0, 1 / F.sqrt(f)).otherwise(F.lit(float("inf")))
    high = 1 / F.sqrt(polynomial)
    low = F.sqrt(-F.expm1(-F.pow(f / LOW_CUT_HZ, F.lit(3.0))))
    return period, high, low, F.when(f > 0, period * high * low).otherwise(F.lit(0.0))


def measured_filter_response(f: Column) -> Column:
    return measured_filter_components(f)[3]


Complex = tuple[Column, Column]


def multiply(p: Complex, q: Complex) -> Complex:
    return p[0] * q[0] - p[1] * q[1], p[0] * q[1] + p[1] * q[0]


def divide(p: Complex, q: Complex) -> Complex:
    size = q[0] * q[0] + q[1] * q[1]
    return (p[0] * q[0] + p[1] * q[1]) / size, (p[1] * q[0] - p[0] * q[1]) / size


def section_response(f: Column, rate: float, section: tuple[float, ...]) -> Complex:
    """H of one biquad (b0, b1, b2, a0, a1, a2) at e^(i 2 pi f / rate)."""
    w = f * (2 * math.pi / rate)
    b0, b1, b2, a0, a1, a2 = section
    c1, s1, c2, s2 = F.cos(w), F.sin(w), F.cos(w * 2), F.sin(w * 2)
    return divide((b1 * c1 + b2 * c2 + b0, -(b1 * s1 + b2 * s2)), (a1 * c1 + a2 * c2 + a0, -(a1 * s1 + a2 * s2)))


def cascade_response(f: Column, rate: float, sections: list[tuple[float, ...]]) -> Complex:
    out: Complex = (F.lit(1.0), F.lit(0.0))
    for section in sections:
        out = multiply(out, section_response(f, rate, section))
    return out


def analog_amplitude(f: Column, p) -> Column:
    """Amplitude of the 2012 prototype at continuous frequency; 0 at 0 Hz. p: design.Filter2012."""
    w = f * (2 * math.pi)

    def first(a: float, b: float, hz: float) -> Column:  # (a w0 + s) / (w0 + b s)
        w0 = 2 * math.pi * hz
        return F.sqrt((F.lit((a * w0) ** 2) + w * w) / (F.lit(w0**2) + w * w * b**2))

    def second(hz: float, h: float) -> Column:  # |w0^2 + 2 h w0 s + s^2|
        w0 = 2 * math.pi * hz
        return F.sqrt(F.pow(F.lit(w0**2) - w * w, F.lit(2.0)) + F.pow(w * (2 * h * w0), F.lit(2.0)))

    out = first(0, 1, p.f0_hz) * first(1, 2, p.f1_hz) * first(4, 8, p.f1_hz) * first(0.25, 0.5, p.f1_hz)
    out = out * second(p.correction_hz, p.correction_numerator_damping) / second(p.correction_hz, p.correction_denominator_damping)
    for hz, h in ((p.lowpass_1_hz, p.lowpass_1_damping), (p.lowpass_2_hz, p.lowpass_2_damping), (p.lowpass_3_hz, p.lowpass_3_damping)):
        out = out * (2 * math.pi * hz) ** 2 / second(hz, h)
    return F.when(f == 0, F.lit(0.0)).otherwise(out * p.gain)


def unwrapped_phase(df: DataFrame, order: str = "frequency_hz", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds amplitude and phase_rad to (re, im) rows: jumps of over pi along ``order`` become multiples of 2 pi."""
    w = Window.partitionBy(*by).orderBy(order)
    angle = F.atan2("im", "re")
    df = df.withColumn("_angle", angle).withColumn("_step", F.col("_angle") - F.lag("_angle").over(w))
    turns = F.coalesce(-F.round(F.col("_step") / (2 * math.pi)), F.lit(0.0))
    return df.withColumn("amplitude", F.hypot("re", "im")).withColumn("phase_rad", F.col("_angle") + F.sum(turns * (2 * math.pi)).over(w)).drop("_angle", "_step")
