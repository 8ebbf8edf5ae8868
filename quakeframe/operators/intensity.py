"""Filtered series, measured intensity and real-time intensity, one record to a group.

Records are grouped by record_id (one shuffle); the numpy kernel turns a record's samples
into filtered samples or a few numbers, and everything after is Column expressions.
Records that are longer than a block run in blocks (see ``blocks`` and ``fourier``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InsufficientDataError, InvalidAccelerationError
from ..functions import scale
from ..functions.duration import duration_sample_count
from . import batches, blocks, design, fourier, kernels
from ..plans.storage import written
from .motion import check_rate, components_of, convert_waveform, duration_threshold, ordered_window, resultant


def samples_of(pdf: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """i, (samples, components) in order of i, and the components that the record has (not null throughout)."""
    pdf = pdf.sort_values("i", kind="stable")
    have = [c for c in names if not pdf[c].isna().all()]
    x = pdf[have].to_numpy(float)
    if not have or not np.isfinite(x).all():
        raise InvalidAccelerationError(f"record {pdf['record_id'].iloc[0]} has no component, or a sample that is missing or not finite")
    return pdf["i"].to_numpy(), x, have


def map_records(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], causal: bool) -> DataFrame:
    """record_id, i and the components that kernel makes of (samples, channels); a causal one may be given zeros behind a record's end."""
    names = components_of(df)

    def run(records: batches.Records) -> tuple[np.ndarray, list]:
        out = through(records, kernel, causal)
        have = records.have[records.record_of]
        return records.record_of, [records.i, *[batches.absent(out[:, c], have[:, c]) for c in range(len(names))]]

    return batches.map_whole(df, names, "i long, " + ", ".join(f"{c} double" for c in names), run)


def through(records: batches.Records, kernel: Callable[[np.ndarray], np.ndarray], causal: bool) -> np.ndarray:
    """(samples, components) of all records after kernel."""
    out = np.zeros_like(records.x)
    if causal:
        for _, x, rows in records.packed():
            y = kernel(x.reshape(len(x), -1)).reshape(x.shape)
            out[rows[rows >= 0]] = y[rows >= 0]
    else:
        for members, x in records.by_length():
            out[records.starts[members] + np.arange(len(x))[:, None]] = kernel(x.reshape(len(x), -1)).reshape(x.shape)
    return out


def measured_filter(df: DataFrame, rate: float = 100.0, unit: str = "gal", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """The intensity filter in the frequency domain over each whole record; transforms of records longer than ``block`` samples run in many tasks."""
    rate = check_rate(rate, warn=False)
    df = convert_waveform(df, unit)
    if blocks.choose(df, block):
        return fourier.filter_whole(df, components_of(df), kernels.measured_gain, rate)
    return map_records(df, lambda x: kernels.measured_filter(x, rate), causal=False)


def recursive(df: DataFrame, filters: list[kernels.BlockFilter], gain: float = 1.0, block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """A cascade from rest over each record; records longer than ``block`` samples run in blocks."""
    if size := blocks.choose(df, block):
        return blocks.filtered(df, components_of(df), filters, gain, size)
    return map_records(df, lambda x: kernels.filter_series(filters, x)[0] * gain, causal=True)


def realtime_filter(df: DataFrame, made: design.Design, unit: str = "gal", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """The causal intensity filter from rest."""
    return recursive(convert_waveform(df, unit), kernels.cascade(made.sos), block=block)


def high_pass(df: DataFrame, rate: float = 100.0, unit: str = "gal", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """The 20-second high-pass from rest."""
    numerator, denominator, gain = design.design_high_pass(check_rate(rate))
    return recursive(convert_waveform(df, unit), [kernels.direct_form(numerator, denominator)], gain, block)


def _published(df: DataFrame, pair: tuple, rate: float, unit: str, block: int | None) -> DataFrame:
    if abs(float(rate) - design.STANDARD_RATE_HZ) > 1e-9:
        raise ValueError(f"this filter is published for 100 Hz only, not {rate:g} Hz")
    return recursive(convert_waveform(df, unit), [kernels.direct_form(*pair)], block=block)


def strong_motion_velocity(df: DataFrame, rate: float = 100.0, unit: str = "gal", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """Velocity in cm/s by the published recursive filter with a 5-second cutoff."""
    return _published(df, design.VELOCITY_FILTER, rate, unit, block)


def strong_motion_displacement(df: DataFrame, rate: float = 100.0, unit: str = "gal", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """Displacement in cm as a mechanical seismometer (6 s, damping 0.55) shows it."""
    return _published(df, design.DISPLACEMENT_FILTER, rate, unit, block)


def resample(df: DataFrame, original: float, target: float = 100.0, max_denominator: int = 100_000, beta: float = 5.0) -> DataFrame:
    """Rational resampling; samples are numbered anew from 0."""
    original, target = check_rate(original, warn=False), check_rate(target, warn=False)
    names = components_of(df)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, have = samples_of(pdf, names)
        y = kernels.resample_series(x, original, target, max_denominator, beta)
        out = pd.DataFrame(np.nan, index=range(len(y)), columns=names)
        out[have] = y
        return pd.concat([pd.DataFrame({"record_id": pdf["record_id"].iloc[0], "i": np.arange(len(y))}), out], axis=1)

    kind = dict(df.dtypes)["record_id"]
    made = df.select("record_id", F.col("i").cast("long"), *names).groupBy("record_id").applyInPandas(run, f"record_id {kind}, i long, " + ", ".join(f"{c} double" for c in names))
    return made.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in names})


# -- measured intensity ----------------------------------------------------------------


def measured_intensity(df: DataFrame, rate: float = 100.0, unit: str = "gal", duration_s: float = 0.3, policy: str = "ceil", allow_fewer: bool = False, warn: bool = True, block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """One row per record: the duration threshold of the filtered resultant, raw and reported intensity, class and peaks.

    A record shorter than the duration, or with fewer components where that isn't
    allowed, stops the query.  Records longer than ``block`` samples are filtered in many
    tasks, and their threshold is selected without sorting them.
    """
    rate = check_rate(rate, warn)
    count = duration_sample_count(duration_s, rate, policy)
    names = components_of(df)
    if len(names) < 3 and not allow_fewer:
        raise InvalidAccelerationError(f"three components are needed, not {len(names)}")

    def run(records: batches.Records) -> tuple[np.ndarray, list]:
        sizes, parts = records.sizes, records.have.sum(axis=1)
        few, brief = parts < 3, sizes < count
        if few.any() and not allow_fewer:
            k = int(np.argmax(few))
            raise InvalidAccelerationError(f"record {records.name(k)} has {parts[k]} components; three are needed")
        if brief.any():
            k = int(np.argmax(brief))
            raise InsufficientDataError(f"record {records.name(k)} has {sizes[k]} samples; the duration needs {count}")
        y = through(records, lambda x: kernels.measured_filter(x, rate), causal=False)
        size, begin = np.sqrt((y**2).sum(axis=1)), records.starts[:-1]
        threshold = np.array([np.partition(size[a:b], b - a - count)[b - a - count] for a, b in zip(begin, records.starts[1:], strict=True)])
        most = lambda v: np.maximum.reduceat(v, begin, axis=0)
        peaks = lambda v: [row[own].tolist() for row, own in zip(most(np.abs(v)), records.have, strict=True)]
        return np.arange(len(sizes)), [sizes, parts, threshold, most(np.sqrt((records.x**2).sum(axis=1))), most(size), peaks(records.x), peaks(y)]

    df = convert_waveform(df, unit)
    if blocks.choose(df, block):
        out = _measured_in_blocks(df, names, rate, count, allow_fewer)
        return _measured_columns(out, count, rate, duration_s, policy)
    schema = "sample_count long, component_count int, threshold_gal double, input_pga_gal double, filtered_pga_gal double, input_component_pga_gal array<double>, filtered_component_pga_gal array<double>"
    out = batches.map_whole(df, names, schema, run)
    return _measured_columns(out, count, rate, duration_s, policy)


def _measured_in_blocks(df: DataFrame, names: list[str], rate: float, count: int, allow_fewer: bool) -> DataFrame:
    y = written(fourier.filter_whole(df, names, kernels.measured_gain, rate))
    peaks = lambda: F.array_compact(F.array(*[F.max(F.abs(F.col(c))) for c in names]))
    given = df.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("sample_count"), sum((F.when(F.count(c) > 0, 1).otherwise(0) for c in names), F.lit(0)).alias("component_count"),
        F.max(resultant(names)).alias("input_pga_gal"), peaks().alias("input_component_pga_gal"),
    )
    few = F.concat(F.lit("record "), F.col("record_id").cast("string"), F.lit(" has fewer than three components"))
    if not allow_fewer:
        given = given.withColumn("component_count", F.when(F.col("component_count") < 3, F.raise_error(few).cast("int")).otherwise(F.col("component_count")))
    made = y.groupBy("record_id").agg(F.max(resultant(names)).alias("filtered_pga_gal"), peaks().alias("filtered_component_pga_gal"))
    threshold = duration_threshold(y.select("record_id", resultant(names).alias("amplitude")), count).withColumnRenamed("threshold", "threshold_gal")
    out = given.join(made, "record_id").join(threshold, "record_id")
    return out.select("record_id", "sample_count", F.col("component_count").cast("int"), "threshold_gal", "input_pga_gal", "filtered_pga_gal", "input_component_pga_gal", "filtered_component_pga_gal")


def _measured_columns(out: DataFrame, count: int, rate: float, duration_s: float, policy: str) -> DataFrame:
    raw = scale.intensity_from_threshold(F.col("threshold_gal"))
    reference = (F.col("component_count") == 3) & F.lit(rate == 100.0 and duration_s == 0.3 and policy == "ceil")
    out = out.withColumn("intensity_raw", raw).withColumn("intensity", scale.report_intensity(F.col("intensity_raw")))
    return out.withColumns({
        "intensity_class": scale.classify_intensity(F.col("intensity")),
        "duration_samples": F.lit(count), "effective_duration_s": F.lit(count / rate), "reference_conditions_met": reference,
    })


def scale_to_intensity(df: DataFrame, target_raw: float, rate: float = 100.0, unit: str = "gal", allow_fewer: bool = False) -> DataFrame:
    """Each record times 10^((target - its raw intensity) / 2); a record of zeros stops the query."""
    now = measured_intensity(df, rate, unit, allow_fewer=allow_fewer).select("record_id", F.col("intensity_raw").alias("_raw"))
    silent = F.when(F.col("_raw") == float("-inf"), F.raise_error(F.lit("a record without motion can't be scaled")))
    factor = F.coalesce(silent, F.pow(F.lit(10.0), (F.lit(float(target_raw)) - F.col("_raw")) / 2))
    return df.join(now, "record_id").withColumns({c: F.col(c) * factor for c in components_of(df)}).select(*df.columns)


# -- real-time intensity ---------------------------------------------------------------

SERIES = "i long, resultant_gal double, threshold_gal double"


def realtime_intensity(
    df: DataFrame, rate: float = 100.0, unit: str = "gal", filter_name: str = "auto", made: design.Design | None = None, window_s: float = 60.0,
    duration_s: float = 0.3, policy: str = "ceil", warn: bool = True, block: int | None = blocks.BLOCK_SAMPLES, keep_components: bool = False,
) -> DataFrame:
    """One row per sample: causal filter, rolling duration threshold over the latest window, intensity and its running maximum.

    Undefined until the window holds enough samples (null).  keep_components: the filtered
    components filtered_c0, ... as well.  Records longer than ``block`` samples run in blocks.
    """
    rate = check_rate(rate, warn)
    made = made or design.design_realtime_filter(rate, filter_name)
    if made.rate != rate:
        raise ValueError("the filter was designed for another rate")
    design.warn_corners(made)
    count, window = duration_sample_count(duration_s, rate, policy), duration_sample_count(window_s, rate, "nearest")
    names, filters = components_of(df), kernels.cascade(made.sos)
    df = convert_waveform(df, unit)
    kept = [f"filtered_{c}" for c in names]
    if size := blocks.choose(df, block):
        y = blocks.filtered(df, names, filters, 1.0, size).withColumn("resultant_gal", resultant(names))
        out = blocks.ranked(y, "resultant_gal", window, count, size)
        out = out.select("record_id", "i", "resultant_gal", F.col("kth").alias("threshold_gal"), *[F.col(c).alias(k) for c, k in zip(names, kept, strict=True)])
    else:

        def run(records: batches.Records) -> tuple[np.ndarray, list]:
            y = through(records, lambda x: kernels.filter_series(filters, x)[0], causal=True)
            amplitude, have = np.sqrt((y**2).sum(axis=1)), records.have[records.record_of]
            threshold = np.concatenate([kernels.rolling_rank(amplitude[a:b], window, count) for a, b in zip(records.starts, records.starts[1:])])  # noqa: B905
            return records.record_of, [records.i, amplitude, threshold, *[batches.absent(y[:, c], have[:, c]) for c in range(len(names))]]

        out = batches.map_whole(df, names, f"{SERIES}, " + ", ".join(f"{k} double" for k in kept), run)
    out = intensity_columns(out, rate, size)
    return out.withColumns({k: F.nanvl(F.col(k), F.lit(None)) for k in kept}) if keep_components else out.drop(*kept)


def intensity_columns(series: DataFrame, rate: float, block: int | None = None) -> DataFrame:
    """Adds time, raw and reported intensity and running maximum to (record_id, i, resultant_gal, threshold_gal)."""
    threshold = F.nanvl(F.col("threshold_gal"), F.lit(None).cast("double"))
    out = series.withColumn("threshold_gal", threshold).withColumn("time_s", F.col("i") / F.lit(float(rate)))
    out = out.withColumn("intensity_raw", scale.intensity_series(F.col("threshold_gal")))
    out = out.withColumn("intensity", scale.report_intensity(F.col("intensity_raw")))
    if block:
        return blocks.running(out.withColumn("record_max_intensity_raw", F.col("intensity_raw")), ["record_max_intensity_raw"], block, "max")
    return out.withColumn("record_max_intensity_raw", F.max("intensity_raw").over(ordered_window().rowsBetween(Window.unboundedPreceding, 0)))


def realtime_summary(series: DataFrame) -> DataFrame:
    """One row per record: first defined sample, greatest intensity and the first sample that reaches it."""
    at = F.struct("intensity_raw", -F.col("i"))
    out = series.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min(F.when(F.col("intensity_raw").isNotNull(), F.col("i"))).alias("first_valid_sample_index"),
        F.max("intensity_raw").alias("approximate_intensity_raw"),
        F.max_by("i", F.when(F.col("intensity_raw").isNotNull(), at)).alias("peak_sample_index"),
        F.max("threshold_gal").alias("peak_threshold_gal"),
        F.max("resultant_gal").alias("filtered_pga_gal"),
    )
    out = out.withColumn("approximate_intensity", scale.report_intensity(F.col("approximate_intensity_raw")))
    return out.withColumn("approximate_class", scale.classify_intensity(F.col("approximate_intensity")))


def rolling_kth_largest(series: DataFrame, window: int, k: int, value: str = "x", block: int | None = blocks.BLOCK_SAMPLES) -> DataFrame:
    """Adds ``kth``: the exact k-th largest of the latest ``window`` values of each record, null until k came.

    A null value takes a place in the window, but has no rank.
    A window of up to a few dozen rows stays a sorted array in SQL, as re-sorting each frame
    costs its length every row; for a longer one all windows descend a wavelet matrix
    together, in blocks where a record is longer than ``block`` and numbered without gaps.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between one and the window")
    if window <= 64:
        frame = ordered_window().rowsBetween(1 - window, 0)
        return series.withColumn("kth", F.get(F.sort_array(F.collect_list(value).over(frame), asc=False), F.lit(k - 1)))
    found = blocks.lengths(series) if block else None
    if found and found.greatest >= block and not found.gaps:
        out = blocks.ranked(series, value, window, k, block)
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i", kind="stable")
            return pdf.assign(kth=kernels.rolling_rank(pdf[value].to_numpy(float), window, k))

        kinds = ", ".join(f"{c} {t}" for c, t in series.dtypes)
        out = series.groupBy("record_id").applyInPandas(run, f"{kinds}, kth double")
    return out.withColumn("kth", F.nanvl("kth", F.lit(None)))


def filtered_resultant(df: DataFrame, rate: float = 100.0, unit: str = "gal") -> DataFrame:
    """(record_id, i, amplitude) of the measured filter: what measured intensity keeps of its intermediates."""
    y = measured_filter(df, rate, unit)
    return y.select("record_id", "i", resultant(components_of(y)).alias("amplitude"))
