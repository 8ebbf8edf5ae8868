"""Validation, preprocessing, peaks, integration, durations and clipping on waveform tables.

A waveform table has one row per sample: record_id, i (0, 1, ... within the record) and
component columns c0, c1, c2; components that a record lacks are null columns.  All of it
is aggregates and windows partitioned by record_id.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..errors import InvalidAccelerationError, MissingComponentWarning, NonstandardSamplingRateWarning
from ..functions.duration import duration_sample_count
from ..functions.units import to_gal
from .design import STANDARD_RATE_HZ

COMPONENTS = ("c0", "c1", "c2")


def record_window() -> WindowSpec:
    return Window.partitionBy("record_id")


def ordered_window() -> WindowSpec:
    return record_window().orderBy("i")


def components_of(df: DataFrame) -> list[str]:
    found = [c for c in COMPONENTS if c in df.columns]
    if not found:
        raise InvalidAccelerationError("a waveform table needs a component column c0")
    return found


def check_rate(rate: float, warn: bool = True) -> float:
    if not (rate > 0 and rate < float("inf")):
        raise ValueError("the sampling rate must be finite and greater than zero")
    if warn and rate != STANDARD_RATE_HZ:
        warnings.warn(f"{rate:g} Hz isn't the reference rate of 100 Hz", NonstandardSamplingRateWarning, stacklevel=3)
    return float(rate)


def check_waveform(df: DataFrame, horizontal: bool = False, allow_fewer: bool = True, warn: bool = True) -> DataFrame:
    """Stops the query at a sample that is null in a component its record has elsewhere first null-free, NaN or infinite.

    Plan-time checks are the component columns: two exactly for horizontal records, else one to three.
    """
    names = components_of(df)
    if horizontal and len(names) != 2:
        raise InvalidAccelerationError(f"two horizontal components are needed, not {len(names)}")
    if not horizontal and len(names) < 3:
        if not allow_fewer:
            raise InvalidAccelerationError(f"three components are needed, not {len(names)}")
        if warn:
            warnings.warn(f"{len(names)} of three components", MissingComponentWarning, stacklevel=2)
    bad = reduce(lambda p, q: p | q, [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in names])
    message = F.concat(F.lit("record "), F.col("record_id").cast("string"), F.lit(" has a sample that isn't finite"))
    return df.withColumn(names[0], F.when(bad, F.raise_error(message)).otherwise(F.col(names[0])))


def quality_flags(df: DataFrame, rate: float) -> DataFrame:
    """One row per record: sample and component counts, gaps or repeats in i, null and non-finite samples, rate flag."""
    names = components_of(df)
    present = [F.max(F.col(c).isNotNull().cast("int")) for c in names]
    odd = reduce(lambda p, q: p + q, [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in names])
    out = df.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        reduce(lambda p, q: p + q, present).alias("component_count"),
        (F.max("i") - F.min("i") + 1 - F.count_distinct("i")).alias("gap_count"),
        (F.count(F.lit(1)) - F.count_distinct("i")).alias("repeat_count"),
        odd.alias("nonfinite_count"),
    )
    return out.withColumn("standard_rate", F.lit(float(rate) == STANDARD_RATE_HZ)).withColumn("missing_components", F.col("component_count") < 3)


def sampling_diagnostics(times: DataFrame, relative_tolerance: float = 1e-3) -> DataFrame:
    """(record_id, t) -> rate, median and mean interval, greatest jitter from the median, uniform flag; needs increasing times."""
    step = F.col("t") - F.lag("t").over(record_window().orderBy("t"))
    steps = times.select("record_id", step.alias("d")).where("d is not null")
    steps = steps.withColumn("d", F.when(F.col("d") <= 0, F.raise_error(F.lit("times must increase"))).otherwise(F.col("d")))
    middle = steps.groupBy("record_id").agg(F.percentile("d", F.lit(0.5)).alias("median_interval_s"), F.avg("d").alias("mean_interval_s"))
    jitter = steps.join(middle, "record_id").groupBy("record_id", "median_interval_s", "mean_interval_s").agg(
        F.max(F.abs(F.col("d") - F.col("median_interval_s"))).alias("max_absolute_jitter_s")
    )
    relative = F.col("max_absolute_jitter_s") / F.col("median_interval_s")
    return jitter.select(
        "record_id", (1 / F.col("median_interval_s")).alias("sampling_rate_hz"), "median_interval_s", "mean_interval_s", "max_absolute_jitter_s",
        relative.alias("relative_peak_jitter"), (relative <= relative_tolerance).alias("is_uniform"),
    )


# -- amplitude -------------------------------------------------------------------------


def resultant(names: list[str] | tuple[str, ...] = COMPONENTS) -> Column:
    """Euclidean norm of any number of components; a null component counts as none."""
    return F.sqrt(reduce(lambda p, q: p + q, [F.coalesce(F.col(c) * F.col(c), F.lit(0.0)) for c in names]))


def convert_waveform(df: DataFrame, unit: str) -> DataFrame:
    return df if unit == "gal" else df.withColumns({c: to_gal(F.col(c), unit) for c in components_of(df)})


def component_peaks(df: DataFrame, unit: str = "gal") -> DataFrame:
    """Greatest absolute sample of each component, in gal."""
    return convert_waveform(df, unit).groupBy("record_id").agg(*[F.max(F.abs(F.col(c))).alias(f"peak_{c}") for c in components_of(df)])


def peak_ground_acceleration(df: DataFrame, unit: str = "gal", names: list[str] | None = None) -> DataFrame:
    """Greatest resultant in gal; names may list more than three components."""
    names = names or components_of(df)
    return df.groupBy("record_id").agg(F.max(to_gal(resultant(names), unit)).alias("pga_gal"))


# -- integration -----------------------------------------------------------------------


def integrate(df: DataFrame, rate: float = STANDARD_RATE_HZ, unit: str = "gal", block: int | None = None) -> DataFrame:
    """Cumulative trapezoid of each component from 0: gal to cm/s (or cm/s to cm).

    block: sums run within blocks of so many samples and over the blocks before, so that a
    long record is many tasks; without it they run along each record.
    """
    half = 0.5 / check_rate(rate, warn=False)
    df = convert_waveform(df, unit)
    names = components_of(df)
    step = lambda c, last: F.coalesce((F.col(c) + last) * half, F.when(F.col(c).isNotNull(), F.lit(0.0)))
    if block:
        from . import blocks

        steps = blocks.previous(df, names, block)
        steps = steps.withColumns({f"_sum_{c}": step(c, F.col(f"_last_{c}")) for c in names}).drop(*[f"_last_{c}" for c in names])
        sums = blocks.running(steps, [f"_sum_{c}" for c in names], block, "sum")
        return sums.withColumns({c: F.when(F.col(c).isNotNull(), F.col(f"_sum_{c}")) for c in names}).drop(*[f"_sum_{c}" for c in names])
    running = ordered_window().rowsBetween(Window.unboundedPreceding, 0)
    steps = {c: step(c, F.lag(c).over(ordered_window())) for c in names}
    return df.withColumns(steps).withColumns({c: F.when(F.col(c).isNotNull(), F.sum(c).over(running)) for c in names})


def integrate_twice(df: DataFrame, rate: float = STANDARD_RATE_HZ, unit: str = "gal", block: int | None = None) -> DataFrame:
    return integrate(integrate(df, rate, unit, block), rate, block=block)


def peak_ground_velocity(df: DataFrame, rate: float = STANDARD_RATE_HZ, unit: str = "gal") -> DataFrame:
    v = integrate(df, rate, unit)
    return v.groupBy("record_id").agg(*[F.max(F.abs(F.col(c))).alias(f"peak_{c}") for c in components_of(v)], F.max(resultant(components_of(v))).alias("pgv_cm_s"))


def peak_ground_displacement(df: DataFrame, rate: float = STANDARD_RATE_HZ, unit: str = "gal") -> DataFrame:
    d = integrate_twice(df, rate, unit)
    return d.groupBy("record_id").agg(*[F.max(F.abs(F.col(c))).alias(f"peak_{c}") for c in components_of(d)], F.max(resultant(components_of(d))).alias("pgd_cm"))


# -- preprocessing (never applied by other operators) ----------------------------------


def remove_offset(df: DataFrame, baseline_samples: int | None = None) -> DataFrame:
    """Subtracts each component's mean over the record or over its first samples."""
    if baseline_samples is not None and baseline_samples < 1:
        raise ValueError("the baseline needs at least one sample")
    rank = df.withColumn("_rank", F.row_number().over(ordered_window())) if baseline_samples else df
    base = (lambda c: F.avg(F.when(F.col("_rank") <= baseline_samples, F.col(c))).over(record_window())) if baseline_samples else (lambda c: F.avg(c).over(record_window()))
    return rank.withColumns({c: F.col(c) - base(c) for c in components_of(df)}).drop("_rank")


def detrend(df: DataFrame, mode: str = "linear") -> DataFrame:
    """Subtracts the mean or the least-squares line of each component."""
    if mode == "constant":
        return remove_offset(df)
    if mode != "linear":
        raise ValueError("mode must be 'constant' or 'linear'")
    i = F.col("i").cast("double")

    def line(c: str) -> Column:
        slope = F.coalesce(F.covar_pop(c, i).over(record_window()) / F.nullif(F.var_pop(i).over(record_window()), F.lit(0.0)), F.lit(0.0))
        return F.avg(c).over(record_window()) + slope * (i - F.avg(i).over(record_window()))

    return df.withColumns({c: F.col(c) - line(c) for c in components_of(df)})


def cosine_taper(df: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Tukey window: a cosine ramp over ``fraction`` of the record at either edge."""
    if not 0 <= fraction <= 0.5:
        raise ValueError("the fraction must lie between zero and 0.5")
    if fraction == 0:
        return df
    k, last = F.row_number().over(ordered_window()) - 1, F.count(F.lit(1)).over(record_window()) - 1
    ramp = last * fraction
    edge = F.least(k, last - k)
    gain = F.when((last > 0) & (edge < ramp), (1 + F.cos((edge / ramp - 1) * F.lit(3.141592653589793))) / 2).otherwise(F.lit(1.0))
    return df.withColumn("_gain", gain).withColumns({c: F.col(c) * F.col("_gain") for c in components_of(df)}).drop("_gain")


# -- durations -------------------------------------------------------------------------


#: Ranks that a window keeps before rows are shuffled, and values that one task may sort in a selection.
WINDOW_RANKS, SORTED = 1000, 1 << 16


def duration_threshold(amplitudes: DataFrame, count: int, value: str = "amplitude") -> DataFrame:
    """(record_id, threshold): the exact count-th largest; a record with fewer samples stops the query.

    Of small counts each task sends its largest values on.  For others the range of values
    that holds the threshold is narrowed by counting, and only the last range is sorted.
    """
    if count > WINDOW_RANKS:
        return select_rank(amplitudes.select("record_id", F.col(value).cast("double").alias("v")), count)
    short = F.concat(F.lit("record "), F.col("record_id").cast("string"), F.lit(f" has fewer than {count} samples"))
    rank = amplitudes.select("record_id", value, F.row_number().over(record_window().orderBy(F.desc(value))).alias("rank")).where(F.col("rank") <= count)
    found = rank.groupBy("record_id").agg(F.max("rank").alias("n"), F.min(value).alias("threshold"))
    return found.select("record_id", F.when(F.col("n") < count, F.raise_error(short)).otherwise(F.col("threshold")).alias("threshold"))


def select_rank(rows: DataFrame, count: int, parts: int = 1024, most: int = SORTED) -> DataFrame:
    """(record_id, threshold), the exact count-th largest v: counts in equal parts of each record's range, again and again in the part that holds the rank.

    A part's own least and greatest value bound the next range, so ties end the search and
    every pass narrows it; counts are partial aggregates of ``parts`` rows a record.  Passes
    grow with the digits that a record's values span, one for three digits.
    """
    from ..plans.storage import written

    short = F.concat(F.lit("record "), F.col("record_id").cast("string"), F.lit(f" has fewer than {count} samples"))
    begin = rows.groupBy("record_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
    at = begin.select("record_id", "low", "high", "n", F.when(F.col("n") < count, F.raise_error(short).cast("long")).otherwise(F.lit(count)).alias("want"))
    at = written(at)
    while True:
        inside = rows.join(at, "record_id").where("v between low and high")
        if at.where(f"n > {most} and low < high").isEmpty():
            break
        wide = inside.where(f"n > {most} and low < high")
        part = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * parts), F.lit(parts - 1))
        counts = wide.groupBy("record_id", part.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"), F.first("want").alias("want"))
        above = F.coalesce(F.sum("n").over(record_window().orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("above", above).where("above < want and above + n >= want")
        narrowed = held.select("record_id", "low", "high", "n", (F.col("want") - F.col("above")).alias("want"))
        at = written(narrowed.union(at.where(f"n <= {most} or low = high")))
    done = inside.where("low = high").groupBy("record_id").agg(F.first("low").alias("threshold"))
    rank = F.row_number().over(record_window().orderBy(F.desc("v")))
    rest = inside.where("low < high").withColumn("rank", rank).where("rank = want").select("record_id", F.col("v").alias("threshold"))
    return done.union(rest)


def duration_threshold_at(amplitudes: DataFrame, rate: float, duration_s: float = 0.3, policy: str = "ceil", value: str = "amplitude") -> DataFrame:
    return duration_threshold(amplitudes, duration_sample_count(duration_s, rate, policy), value)


def exceedance_duration(amplitudes: DataFrame, threshold: float | Column, rate: float, value: str = "amplitude") -> DataFrame:
    """(record_id, duration_s): seconds at or above the threshold."""
    return amplitudes.groupBy("record_id").agg((F.count_if(F.col(value) >= threshold) / F.lit(float(rate))).alias("duration_s"))


def amplitude_duration_curve(amplitudes: DataFrame, rate: float, value: str = "amplitude") -> DataFrame:
    """(record_id, rank, amplitude, exceedance_duration_s) in descending order of amplitude."""
    rank = F.row_number().over(record_window().orderBy(F.desc(value)))
    return amplitudes.select("record_id", rank.alias("rank"), F.col(value).alias("amplitude")).withColumn("exceedance_duration_s", F.col("rank") / F.lit(float(rate)))


def thin(df: DataFrame, most: int, order: str = "i") -> DataFrame:
    """At most ``most`` rows a record, evenly spaced along ``order`` with both ends kept."""
    if most < 2:
        raise ValueError("at least two points are kept")
    k, n = F.row_number().over(record_window().orderBy(order)) - 1, F.count(F.lit(1)).over(record_window())
    step = (n - 1) / F.lit(float(most - 1))
    nearest = F.rint(k / step)
    keep = (n <= most) | ((F.rint(nearest * step) == k) & (nearest <= most - 1))
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


# -- clipping --------------------------------------------------------------------------


def detect_clipping(df: DataFrame, unit: str = "gal", max_range_gal: float | None = None, range_tolerance: float = 0.001, repeat_threshold: int = 3, extreme_fraction: float = 0.9) -> DataFrame:
    """Suspected intervals: record_id, component, start_sample, end_sample (exclusive), value, method.

    known_range: at the known full scale, less the tolerance.  repeated_extreme: in a run
    of equal samples and near the component's own peak.  Adjacent flagged runs of one
    method are one interval; value is the first of its samples of greatest size.
    """
    if not 0 <= range_tolerance < 1 or repeat_threshold < 2 or not 0 < extreme_fraction <= 1:
        raise ValueError("range_tolerance in [0, 1), repeat_threshold of 2 or more and extreme_fraction in (0, 1] are needed")
    if max_range_gal is not None and not 0 < max_range_gal < float("inf"):
        raise ValueError("max_range_gal must be finite and greater than zero")
    names = components_of(df)
    flat = convert_waveform(df, unit).select("record_id", "i", F.posexplode(F.array(*names)).alias("component", "x")).where("x is not null")
    part = Window.partitionBy("record_id", "component")
    order = part.orderBy("i")
    size = F.abs(F.col("x"))
    change = F.when(F.col("x") == F.lag("x").over(order), 0).otherwise(1)
    runs = flat.withColumn("run", F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("record_id", "component", "run"))).withColumn("peak", F.max(size).over(part))
    repeated = (F.col("peak") > 0) & (size >= F.col("peak") * extreme_fraction) & (F.col("length") >= repeat_threshold)
    methods = [F.when(repeated, F.lit("repeated_extreme"))]
    if max_range_gal is not None:
        methods.insert(0, F.when(size >= max_range_gal * (1 - range_tolerance), F.lit("known_range")))
    flagged = runs.select("record_id", "component", "i", "x", F.explode(F.array_compact(F.array(*methods))).alias("method"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("record_id", "component", "method").orderBy("i"))
    out = flagged.withColumn("island", island).groupBy("record_id", "component", "method", "island").agg(
        F.min("i").alias("start_sample"), (F.max("i") + 1).alias("end_sample"), F.max_by("x", F.struct(F.abs(F.col("x")), -F.col("i"))).alias("value")
    )
    return out.select("record_id", "component", "start_sample", "end_sample", "value", "method")


def clipping_report(intervals: DataFrame) -> DataFrame:
    """(record_id, interval_count, components_affected) of records with a suspected interval."""
    return intervals.groupBy("record_id").agg(F.count(F.lit(1)).alias("interval_count"), F.array_sort(F.collect_set("component")).alias("components_affected"))
