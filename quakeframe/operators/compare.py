"""Comparing intensity methods and result tables, and the registry of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intensity


def compare_intensity_methods(df: DataFrame, rate: float = 100.0, unit: str = "gal", allow_fewer: bool = False, measured_options: dict | None = None, realtime_options: dict | None = None) -> DataFrame:
    """Measured and real-time maxima of each record, their differences and whether the classes agree."""
    shared = {"rate", "unit", "df", "allow_fewer"}
    for options in (measured_options or {}), (realtime_options or {}):
        if wrong := sorted(shared & set(options)):
            raise TypeError(f"{', '.join(wrong)} hold for both methods; give them as arguments of the comparison")
    measured = intensity.measured_intensity(df, rate, unit, allow_fewer=allow_fewer, **(measured_options or {}))
    series = intensity.realtime_intensity(df, rate, unit, **(realtime_options or {}))
    return difference_columns(measured, intensity.realtime_summary(series))


def difference_columns(measured: DataFrame, realtime: DataFrame) -> DataFrame:
    a = measured.select("record_id", "intensity_raw", "intensity", "intensity_class")
    b = realtime.select("record_id", "approximate_intensity_raw", "approximate_intensity", "approximate_class")
    joined = a.join(b, "record_id")
    raw = F.col("approximate_intensity_raw") - F.col("intensity_raw")
    return joined.withColumns({
        "raw_difference": raw, "reported_difference": F.col("approximate_intensity") - F.col("intensity"), "absolute_raw_difference": F.abs(raw),
        "scale_agreement": F.col("approximate_class") == F.col("intensity_class"),
    })


def compare_results(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """(field, reason, max_abs_err, max_rel_err), a row for each column that differs; no rows: equal.

    Numbers agree within atol + rtol |b|; infinities must have the same sign, nulls and
    NaN match themselves.  Columns or rows on one side only are differences.
    """
    out = []
    spark = a.sparkSession
    for side, only in (("left", set(a.columns) - set(b.columns)), ("right", set(b.columns) - set(a.columns))):
        out += [(name, f"only on the {side}", None, None) for name in sorted(only)]
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    joined = a.select(*keys, F.struct(*shared).alias("x")).join(b.select(*keys, F.struct(*shared).alias("y")), keys, "full")
    missing = [F.count_if(F.col("x").isNull()).alias("no_x"), F.count_if(F.col("y").isNull()).alias("no_y")]
    checks: list[Column] = []
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    for k, c in enumerate(shared):
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        if kinds_a[c] in numeric and kinds_b[c] in numeric:
            p, q = p.cast("double"), q.cast("double")
            finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
            gap = F.when(finite(p) & finite(q), F.abs(p - q))
            same = p.eqNullSafe(q) | F.coalesce(gap <= F.abs(q) * rtol + atol, F.lit(False))
            size = F.when(gap > 0, F.try_divide(gap, F.abs(q)))
        else:
            gap, size, same = F.lit(None).cast("double"), F.lit(None).cast("double"), p.eqNullSafe(q)
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        checks += [F.count_if(both & ~same).alias(f"n{k}"), F.max(F.when(both & ~same, gap)).alias(f"a{k}"), F.max(F.when(both & ~same, size)).alias(f"r{k}")]
    found = joined.agg(*missing, *checks)
    fields = [F.struct(F.lit(c).alias("field"), F.lit("values differ").alias("reason"), F.col(f"n{k}").alias("n"), F.col(f"a{k}").alias("max_abs_err"), F.col(f"r{k}").alias("max_rel_err")) for k, c in enumerate(shared)]
    none = F.lit(None).cast("double")
    fields += [F.struct(F.lit("(rows)").alias("field"), F.lit(f"rows only on the {s}").alias("reason"), F.col(n).alias("n"), none.alias("max_abs_err"), none.alias("max_rel_err")) for s, n in (("right", "no_x"), ("left", "no_y"))]
    rows = found.select(F.inline(F.array(*fields))).where("n > 0").drop("n")
    return rows.unionByName(spark.createDataFrame(out, "field string, reason string, max_abs_err double, max_rel_err double")) if out else rows


#: Method ids, names and statuses; notes say what the methods assume.
METHODS = (
    ("jma_measured_intensity", "Instrumental seismic intensity in the frequency domain", "reference", "100 Hz and three orthogonal components", "The 0.3 s threshold is an exact order statistic."),
    ("kunugi_realtime_intensity_2008", "Causal real-time approximation of 2008", "published_approximation", "100 Hz", "Coefficients follow from the analog prototype; the rolling threshold is exact."),
    ("kunugi_realtime_intensity_2012", "Improved causal real-time approximation", "published_approximation", "100 Hz", "Coefficients follow from the analog prototype; the rolling threshold is exact."),
    ("kunugi_lowrate_realtime_intensity", "Causal approximation for low sampling rates", "published_approximation", "below 100 Hz", "With gammas of 1/12 it is the improved filter."),
    ("jma_long_period_ground_motion_class", "Long-period ground motion class", "reference", "32 periods from 1.6 to 7.8 s, damping 5 %, horizontal vector", "A 20-second high-pass comes first."),
    ("housner_spectrum_intensity", "Spectrum intensity", "reference", "damping 20 %, 0.1 to 2.5 s, over 2.4 s", "121 periods and the trapezoidal rule."),
    ("general_elastic_response_spectrum", "Elastic response spectra", "general_engineering_method", None, "Damping and periods have no defaults."),
    ("idw_spatial_interpolation", "Inverse-distance interpolation of near stations", "general_engineering_method", None, "A radius is needed unless extrapolation is asked for."),
    ("suzuki_2017_pga_idw_preset", "Preset of four stations within 50 km", "package_extension", "four stations within 50 km, inverse square", "All four stations are required."),
)


def method_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHODS), "method_id string, method_name string, status string, reference_conditions string, note string")


def available_method_ids() -> tuple[str, ...]:
    return tuple(sorted(m[0] for m in METHODS))


def method_descriptor(method_id: str) -> dict:
    for m in METHODS:
        if m[0] == method_id:
            return dict(zip(("method_id", "method_name", "status", "reference_conditions", "note"), m, strict=True))
    raise ValueError(f"Unknown method {method_id!r}; known: {', '.join(available_method_ids())}.")
