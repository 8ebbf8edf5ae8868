"""Seismic intensity and long-period classes as Column expressions.

Undefined is NULL, never NaN; a threshold of exactly zero has intensity -Infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intensity classes with their lower bounds, and labels.
CLASSES = ("0", "1", "2", "3", "4", "5-", "5+", "6-", "6+", "7")
LOWER = (float("-inf"), 0.5, 1.5, 2.5, 3.5, 4.5, 5.0, 5.5, 6.0, 6.5)
JAPANESE = ("0", "1", "2", "3", "4", "5弱", "5強", "6弱", "6強", "7")
ENGLISH = ("0", "1", "2", "3", "4", "5 Lower", "5 Upper", "6 Lower", "6 Upper", "7")
#: Long-period classes with their lower bounds in cm/s.
LONG_CLASSES = ("0", "1", "2", "3", "4")
LONG_LOWER = (0.0, 5.0, 15.0, 50.0, 100.0)
#: The periods of the long-period bank in tenths of a second.
PERIOD_DECISECONDS = tuple(range(16, 79, 2))
BANDS = tuple(range(1, 8))


def intensity_from_threshold(gal: Column) -> Column:
    """2 log10(a) + 0.94; zero gives -Infinity, null stays null, anything else not positive and finite stops the query."""
    bad = (gal < 0) | F.isnan(gal) | (gal == float("inf"))
    value = F.when(gal == 0, F.lit(float("-inf"))).otherwise(F.log10(gal) * 2 + 0.94)
    return F.when(bad, F.raise_error(F.lit("threshold acceleration must be finite and not negative"))).otherwise(value)


def threshold_from_intensity(intensity: Column) -> Column:
    return F.pow(F.lit(10.0), (intensity - 0.94) / 2)


def intensity_series(gal: Column) -> Column:
    """The same per sample; negative, NaN and null are undefined (null)."""
    return F.when(F.isnan(gal) | (gal < 0) | gal.isNull(), F.lit(None).cast("double")).when(gal == 0, F.lit(float("-inf"))).otherwise(F.log10(gal) * 2 + 0.94)


def report_intensity(value: Column) -> Column:
    """Third decimal rounded half up (away from zero), then truncated to one decimal; what isn't finite passes through."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    hundredths = F.round(F.round(value, 2) * 100, 0)
    tenths = F.when(hundredths < 0, F.ceil(hundredths / 10)).otherwise(F.floor(hundredths / 10))
    return F.when(finite, tenths.cast("double") / 10 + 0.0).otherwise(value)


def _steps(value: Column, lower: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the last bound that value reaches; NaN stops the query."""
    out = F.when(value.isNull(), F.lit(None).cast("string")).when(F.isnan(value), F.raise_error(F.lit("a class needs a number")))
    for bound, name in reversed(list(zip(lower, names, strict=True))[1:]):
        out = out.when(value >= bound, F.lit(name))
    return out.otherwise(F.lit(names[0]))


def classify_intensity(value: Column) -> Column:
    return _steps(value, LOWER, CLASSES)


def label_of(name: Column, language: str = "ja") -> Column:
    """The label of an intensity class."""
    labels = {"ja": JAPANESE, "en": ENGLISH}[language]
    out = F.lit(None).cast("string")
    for k, label in zip(CLASSES, labels, strict=True):
        out = F.when(name == k, F.lit(label)).otherwise(out)
    return out


def intensity_label(value: Column, language: str = "ja", reported: bool = True) -> Column:
    shown = report_intensity(value) if reported else value
    return F.concat(F.lit({"ja": "震度", "en": "Intensity "}[language]), label_of(classify_intensity(shown), language))


def classify_long_period(sva: Column) -> Column:
    """Class of an absolute velocity response in cm/s; negative or infinite values stop the query."""
    bad = (sva < 0) | (sva == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a response must be finite and not negative"))).otherwise(_steps(sva, LONG_LOWER, LONG_CLASSES))


def long_period_label(name: Column, language: str = "ja") -> Column:
    return F.concat(F.lit({"ja": "長周期地震動階級", "en": "Long-period class "}[language]), name)


def band_of(deciseconds: Column) -> Column:
    """The whole second that a period in tenths of a second falls in."""
    return F.floor(deciseconds / 10).cast("int")


def band_range(band: int) -> tuple[float, float]:
    """Least and greatest period of a band, in seconds."""
    inside = [d for d in PERIOD_DECISECONDS if d // 10 == band]
    if not inside:
        raise ValueError(f"Unknown band {band}; bands are {BANDS[0]} to {BANDS[-1]}.")
    return inside[0] / 10, inside[-1] / 10


def intensity_intervals(spark: SparkSession) -> DataFrame:
    """(intensity_class, lower, upper, japanese, english), lower bounds included."""
    upper = [*LOWER[1:], float("inf")]
    return spark.createDataFrame(list(zip(CLASSES, LOWER, upper, JAPANESE, ENGLISH, strict=True)), "intensity_class string, lower double, upper double, japanese string, english string")


def long_period_intervals(spark: SparkSession) -> DataFrame:
    """(long_period_class, lower, upper) in cm/s."""
    upper = [*LONG_LOWER[1:], float("inf")]
    return spark.createDataFrame(list(zip(LONG_CLASSES, LONG_LOWER, upper, strict=True)), "long_period_class string, lower double, upper double")
