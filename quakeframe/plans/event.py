"""The whole-event job: every station's quantities, joined to published values, and the report of their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intensity, motion, spectra
from .storage import written


def station_quantities(waveform: DataFrame, rate: float = 100.0, unit: str = "gal") -> DataFrame:
    """One row per record with three components: intensity, peaks and long-period class.

    Velocity is integrated after the 20-second high-pass, displacement is the seismometer
    filter's, as published values are made.
    """
    names = motion.components_of(waveform)
    waveform = written(waveform)  # four operators read it, and each looks at its lengths first
    measured = intensity.measured_intensity(waveform, rate, unit).select("record_id", "intensity_raw", "intensity", "intensity_class", F.col("input_pga_gal").alias("pga_gal"))
    velocity = motion.peak_ground_velocity(intensity.high_pass(waveform, rate, unit), rate).select("record_id", "pgv_cm_s")
    displacement = intensity.strong_motion_displacement(waveform, rate, unit).groupBy("record_id").agg(F.max(motion.resultant(names)).alias("pgd_cm"))
    sva = spectra.absolute_velocity_spectrum(waveform.select("record_id", "i", "c0", "c1"), rate, unit)
    level = spectra.long_period_class(sva, rate).select("record_id", "max_sva_cm_s", "long_period_class")
    return measured.join(velocity, "record_id").join(displacement, "record_id").join(level, "record_id")


def against_published(quantities: DataFrame, published: DataFrame, code: str = "record_id") -> DataFrame:
    """Stations in both tables; published columns come with the prefix published_."""
    other = published.select(*[F.col(c).alias(c if c == code else f"published_{c}") for c in published.columns])
    return quantities.join(other, code)


def error_report(joined: DataFrame, value: str, published: str, tolerance: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """stations, how many within the relative tolerance, median relative error, greatest error."""
    gap = F.abs(F.col(value) - F.col(published))
    relative = gap / F.abs(F.col(published))
    return joined.where(F.col(published) != 0).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(relative <= tolerance).alias("within"), F.percentile(relative, F.lit(0.5)).alias("median_relative_error"), F.max(gap).alias("max_error")
    )


def class_report(joined: DataFrame, value: str, published: str) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("stations"), F.count_if(F.col(value).eqNullSafe(F.col(published))).alias("agreeing"))


def strongest(quantities: DataFrame, n: int = 5) -> DataFrame:
    """The n records of greatest intensity, whose spectra are compared in full."""
    return quantities.orderBy(F.desc("intensity_raw"), "record_id").limit(n)


def compare_spectra(computed: DataFrame, published: DataFrame) -> DataFrame:
    """(record_id, period_s, sva_cm_s) against published ones, on periods in tenths of a second."""
    key = F.round(F.col("period_s") * 10).cast("int").alias("deciseconds")
    a = computed.select("record_id", key, "sva_cm_s")
    b = published.select("record_id", key, F.col("sva_cm_s").alias("published_sva_cm_s"))
    return a.join(b, ["record_id", "deciseconds"]).withColumn("relative_error", F.abs(F.col("sva_cm_s") / F.col("published_sva_cm_s") - 1))
