"""Independent numerical oracles, metamorphic properties, boundary tables and negative cases."""

import math
import time
import warnings
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeframe import errors
from quakeframe.functions import duration, geometry, response, scale, units
from quakeframe.operators import compare, design, intensity, kernels, motion, render, spatial, spectra, triangulation
from quakeframe.plans import event, queries, record_queries  # noqa: F401
from quakeframe.sources import records
from quakeframe.streaming import estimators
from tests.oracle import duck_rows, spark_rows

warnings.simplefilter("ignore", errors.GroundMotionWarning)


def frame(spark, series: dict[str, np.ndarray], names=("c0", "c1", "c2")):
    parts = [pd.DataFrame({"record_id": k, "i": np.arange(len(x)), **{n: x[:, j] for j, n in enumerate(names)}}) for k, x in series.items()]
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))


def burst(n=2000, seed=None, gain=1.0):
    t = np.arange(n) / 100
    x = np.exp(-0.5 * ((t - 8) / 1.8) ** 2)[:, None] * np.column_stack([a * np.sin(2 * np.pi * f * t + p) for a, f, p in ((60, 1.2, 0), (45, 2.3, 0.4), (25, 4.8, 1.1))])
    return gain * x + (np.random.default_rng(seed).normal(0, 0.02, x.shape) if seed is not None else 0)


def by_record(df, value):
    return {r["record_id"]: r[value] for r in df.collect()}


# -- queries against SQL ---------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_oracle(spark, name, sf_dir):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(queries.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["long_period_class", "rolling_kth_gaps_long", "event_validation", "resample_128_to_100", "text_record_waveform"])
def test_sql_oracle_at_ten_times_the_rows(spark, name, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    assert spark_rows(queries.QUERIES[name](spark, larger)) == duck_rows(queries.ORACLES[name], larger)


@pytest.mark.parametrize("window", [4, 70])
def test_rolling_kth_skips_nulls(spark, window):
    values = [1.0, 5.0, None, 3.0, 2.0, 4.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "record_id int, i long, x double")
    got = {r["i"]: r["kth"] for r in intensity.rolling_kth_largest(rows, window, 2).collect()}
    frames = [sorted((v for v in values[max(0, i - window + 1) : i + 1] if v is not None), reverse=True) for i in range(6)]
    assert [got[i] for i in range(6)] == [f[1] if len(f) > 1 else None for f in frames]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.ORACLES) <= set(e.oracle_sql())


# -- scale -----------------------------------------------------------------------------


def reported(v):
    h = Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP)
    return float(h.quantize(Decimal("0.1"), ROUND_DOWN))


def test_reported_intensity(spark):
    values = [k / 1000 for k in range(-3000, 8000)] + [math.nextafter(k / 1000, d) for k in range(-2005, 7000, 5) for d in (-99, 99)] + [-1.999, 4.495, 0.0, float("-inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scale.report_intensity(F.col("v")).alias("r")).collect()
    assert all(r.r == (r.v if math.isinf(r.v) else reported(r.v)) for r in got)


def test_class_bounds(spark):
    bounds = list(zip(scale.LOWER[1:], scale.CLASSES[1:], scale.CLASSES, strict=False))
    rows = [(b, up) for b, up, _ in bounds] + [(math.nextafter(b, -99), low) for b, _, low in bounds] + [(float("-inf"), "0"), (9.0, "7")]
    assert all(r.want == r.got for r in spark.createDataFrame(rows, "v double, want string").select("want", scale.classify_intensity(F.col("v")).alias("got")).collect())
    rows = [(0.0, "0"), (4.999, "0"), (5.0, "1"), (15.0, "2"), (49.9, "2"), (50.0, "3"), (100.0, "4")]
    assert all(r.want == r.got for r in spark.createDataFrame(rows, "v double, want string").select("want", scale.classify_long_period(F.col("v")).alias("got")).collect())
    with pytest.raises(Exception, match="number"):
        spark.range(1).select(scale.classify_intensity(F.lit(float("nan")))).collect()
    assert [r.j for r in scale.intensity_intervals(spark).select(scale.label_of(F.col("intensity_class")).alias("j")).collect()] == list(scale.JAPANESE)


def test_threshold_edges(spark):
    v = spark.createDataFrame([(0.0,), (1.0,), (None,)], "a double")
    assert [r.i for r in v.select(scale.intensity_from_threshold(F.col("a")).alias("i")).collect()] == [float("-inf"), 0.94, None]
    assert [r.i for r in spark.createDataFrame([(-1.0,), (float("nan"),), (0.0,)], "a double").select(scale.intensity_series(F.col("a")).alias("i")).collect()] == [None, None, float("-inf")]
    with pytest.raises(Exception, match="not negative"):
        spark.range(1).select(scale.intensity_from_threshold(F.lit(-1.0))).collect()


def test_units(spark):
    assert units.conversion_factor("g", "gal") == pytest.approx(980.665) and units.parse_unit(" CM/S² ") == "gal"
    assert spark.range(1).select(units.unit_column(F.lit("m / s^2"))).first()[0] == "m/s^2"
    with pytest.raises(ValueError, match="Unknown"):
        units.parse_unit("furlong")


def test_durations():
    assert duration.duration_sample_count(0.3, 100) == 30
    with pytest.warns(errors.FractionalDurationWarning):
        assert duration.duration_sample_count(0.3, 128) == 39
    assert duration.duration_sample_count(0.3, 128, "floor", warn=False) == duration.duration_sample_count(0.3, 128, "nearest", warn=False) == 38
    with pytest.raises(ValueError, match="shorter"):
        duration.duration_sample_count(0.001, 100, "floor", warn=False)


# -- filters ---------------------------------------------------------------------------


def scalar_filter(b, a, x):
    y = np.zeros_like(x)
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    return y


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_block_filter_is_the_recursion(n):
    x = np.random.default_rng(n).normal(0, 20, (n, 2))
    for b, a in (design.VELOCITY_FILTER, design.DISPLACEMENT_FILTER, design.design_high_pass()[:2]):
        want = scalar_filter(b, a, x)
        got, _ = kernels.filter_series([kernels.direct_form(b, a)], x)
        assert np.allclose(got, want, rtol=1e-7, atol=1e-7)
        at, states = 0, None
        for size in (1, 7, 100, 999):  # any split gives the same
            part, states = kernels.filter_series([kernels.direct_form(b, a)], x[at : at + size], states)
            assert np.allclose(part, want[at : at + size], rtol=1e-7, atol=1e-7)
            at += size


def test_designs():
    made = design.design_realtime_filter(100)
    assert made.name == "kunugi2012" and made.sos.shape == (6, 6) and made.stability_margin > 0
    assert design.design_realtime_filter(50).name == "jp7681907-lowrate"
    low = design.design_realtime_filter(100, "lowrate", gammas=design.Gammas.equal(*[1 / 12] * 4))
    assert np.allclose(low.sos, made.sos)
    f = np.geomspace(0.1, 10, 60)
    z = np.exp(2j * np.pi * f / 100)
    for d in (made, design.design_realtime_filter(100, "2008")):
        whole = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2) for s in d.sos], axis=0)
        parts = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2) for _, _, s in d.stages], axis=0)
        assert np.allclose(whole, parts)
    y = (f / 10) ** 2
    want = np.sqrt(-np.expm1(-((f / 0.5) ** 3)) / f / np.polyval(response.HIGH_CUT[::-1], y))
    ratio = np.abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2) for s in made.sos], axis=0)) / want
    assert 0.9735 < ratio.min() and ratio.max() < 1.0295
    with pytest.raises(errors.UnstableFilterError):
        design.design_realtime_filter(10, "lowrate", gamma_policy="constant-accurate")
    with pytest.raises(TypeError):
        design.design_realtime_filter(100, "2008", design.Filter2012())
    assert min(design.stability_margins(10, design.published_gammas(10))) >= 0
    rebuilt = design.design_high_pass(100.0000001)
    assert np.allclose(rebuilt[1], design.HIGH_PASS_DENOMINATOR, atol=1e-8) and abs(rebuilt[2] - design.HIGH_PASS_GAIN) < 1e-8


def test_analog_amplitude_is_near_the_reference(spark):
    f = spark.range(1, 400).select((F.col("id") / 8.0).alias("f"))
    rows = f.select((response.analog_amplitude(F.col("f"), design.Filter2012()) / response.measured_filter_response(F.col("f"))).alias("r")).collect()
    assert 0.9735 < min(r.r for r in rows) and max(r.r for r in rows) < 1.0295


def test_responses_and_phase(spark):
    made = design.design_realtime_filter(100)
    rows = render.response_frame(spark, made, points=256).orderBy("frequency_hz").toPandas()
    z = np.exp(2j * np.pi * rows.frequency_hz.to_numpy() / 100)
    h = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in made.sos], axis=0)
    assert np.allclose(rows.amplitude, np.abs(h), atol=1e-9) and np.allclose(np.diff(rows.phase_rad[1:]), np.diff(np.unwrap(np.angle(h))[1:]), atol=1e-9)
    grid = render.geometric_frequencies(spark, 0.1, 10, 20)
    stages = render.stages_frame(spark, made, grid).toPandas().pivot(index="frequency_hz", columns="stage", values="amplitude")
    assert np.allclose(stages.drop(columns="combined").prod(axis=1), stages["combined"])


def test_measured_filter_gain(spark):
    t = np.arange(2000) / 100
    x = np.column_stack([np.sin(2 * np.pi * 2 * t)] * 3)
    out = intensity.measured_filter(frame(spark, {"a": x})).orderBy("i").toPandas()
    gain = spark.range(1).select(response.measured_filter_response(F.lit(2.0))).first()[0]
    assert np.allclose(out.c0, gain * x[:, 0], atol=1e-9)


# -- intensity -------------------------------------------------------------------------


def test_measured_intensity(spark):
    df = frame(spark, {"a": burst(), "b": burst(gain=10), "z": np.zeros((100, 3))})
    got = {r.record_id: r for r in intensity.measured_intensity(df).collect()}
    assert got["b"].intensity_raw - got["a"].intensity_raw == pytest.approx(2.0)
    assert got["z"].intensity_raw == float("-inf") == got["z"].intensity and got["z"].intensity_class == "0"
    assert got["a"].reference_conditions_met and got["a"].input_pga_gal == pytest.approx(np.sqrt((burst() ** 2).sum(axis=1)).max())
    scaled = intensity.scale_to_intensity(frame(spark, {"a": burst()}), 5.5)
    assert intensity.measured_intensity(scaled).first().intensity_raw == pytest.approx(5.5)
    with pytest.raises(Exception, match="samples"):
        intensity.measured_intensity(frame(spark, {"a": burst(10)})).collect()
    with pytest.raises(errors.InvalidAccelerationError):
        intensity.measured_intensity(df.drop("c2"))
    with pytest.raises(Exception, match="scaled"):
        intensity.scale_to_intensity(frame(spark, {"z": np.zeros((100, 3))}), 3.0).collect()


def test_rolling_rank():
    rng = np.random.default_rng(42)
    for window, k, values in ((137, 11, rng.integers(0, 5, 3000)), (50, 5, np.array([1e9, -1e9] * 500)), (40, 40, rng.normal(size=300)), (40, 1, rng.normal(size=300)), (1, 1, rng.normal(size=20))):
        rank = kernels.RollingRank(window, k)
        for n, v in enumerate(values.tolist()):
            seen = sorted(values[max(0, n + 1 - window) : n + 1].tolist(), reverse=True)
            assert rank.update(v) == (seen[k - 1] if len(seen) >= k else None)
    rank.clear()
    assert len(rank) == 0 and not rank.ready


def test_realtime_follows_measured(spark):
    df = frame(spark, {"a": burst(4000, seed=8, gain=3)})
    got = compare.compare_intensity_methods(df).first()
    assert abs(got.raw_difference) < 0.1
    series = intensity.realtime_intensity(df).orderBy("i").toPandas()
    assert series.intensity_raw[:29].isna().all() and series.intensity_raw[29:].notna().all() and (series.record_max_intensity_raw[29:].diff()[1:] >= 0).all()
    with pytest.raises(TypeError):
        compare.compare_intensity_methods(df, realtime_options={"unit": "g"})


def test_resample():
    t = np.arange(400) / 200
    x = np.sin(2 * np.pi * 3 * t)[:, None]
    y = kernels.resample_series(x, 200, 100)
    assert len(y) == 200 and np.allclose(y[40:160, 0], np.sin(2 * np.pi * 3 * np.arange(40, 160) / 100), atol=2e-3)
    assert len(kernels.resample_series(x, 200, 150)) == 300 and np.array_equal(kernels.resample_series(x, 100, 100), x)


def test_resample_frame(spark):
    out = intensity.resample(frame(spark, {"a": burst(800)}), 200, 100)
    assert out.count() == 400 and out.agg(F.max("i")).first()[0] == 399


# -- oscillators -----------------------------------------------------------------------


def naive_bank(bank, x):
    n, c = x.shape
    out = np.zeros((2, len(bank.periods), n, c))
    for p in range(len(bank.periods)):
        s = np.vstack([np.zeros(c), -x[0] / bank.rate])
        out[:, p, 0] = s
        for k in range(1, n):
            s = bank.a[p] @ s + bank.b0[p][:, None] * x[k - 1] + bank.b1[p][:, None] * x[k]
            out[:, p, k] = s
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 64, 200])
def test_bank_is_the_recurrence(n):
    bank = design.oscillator_bank((0.2, 0.5, 1.7), 0.05, 100)
    x = burst(n + 700)[700 : 700 + n, :2]
    runner = kernels.BankFilter(bank)
    state = runner.start(x[0])
    got = np.concatenate([y for _, y in runner.run(x, state)], axis=2)
    assert np.allclose(got, naive_bank(bank, x), rtol=1e-9, atol=1e-11)


def test_bank_is_exact_for_linear_input():
    """Against fine steps of the equation of motion."""
    bank = design.oscillator_bank((0.7,), 0.05, 100)
    w, h, dt, m = 2 * np.pi / 0.7, 0.05, 0.01, 2000
    d, v = 0.3, -1.2
    for k in range(m):
        u = [2.0 + 3.0 * (k + q) / m for q in (0, 0.5, 1)]
        f = lambda d, v, a: (v, -a - 2 * h * w * v - w * w * d)
        s = dt / m
        k1 = f(d, v, u[0])
        k2 = f(d + s / 2 * k1[0], v + s / 2 * k1[1], u[1])
        k3 = f(d + s / 2 * k2[0], v + s / 2 * k2[1], u[1])
        k4 = f(d + s * k3[0], v + s * k3[1], u[2])
        d, v = d + s / 6 * (k1[0] + 2 * k2[0] + 2 * k3[0] + k4[0]), v + s / 6 * (k1[1] + 2 * k2[1] + 2 * k3[1] + k4[1])
    assert np.allclose(bank.a[0] @ [0.3, -1.2] + bank.b0[0] * 2 + bank.b1[0] * 5, [d, v], rtol=1e-9)


def test_transfer_functions_match():
    bank = design.oscillator_bank((0.3, 2.0), 0.1, 100)
    velocity, displacement, denominator = design.transfer_functions(bank)
    x = burst(300)[:, :1].copy()
    x[0] = 0  # then both start from rest
    want = naive_bank(bank, x)
    for p in range(2):
        assert np.allclose(scalar_filter(velocity[p], denominator[p], x), want[1, p], atol=1e-7)
        assert np.allclose(scalar_filter(displacement[p], denominator[p], x), want[0, p], atol=1e-7)


def test_long_period(spark):
    x = burst(3000)[:, :2] * 10
    turn = np.array([[np.cos(0.7), -np.sin(0.7)], [np.sin(0.7), np.cos(0.7)]])
    df = frame(spark, {"a": x, "r": x @ turn, "one": x[:1], "two": x[:2]}, ("c0", "c1"))
    sva = spectra.absolute_velocity_spectrum(df)
    got = sva.toPandas().pivot(index="period_s", columns="record_id", values="sva_cm_s")
    assert np.allclose(got["a"], got["r"], rtol=1e-9)
    gal = frame(spark, {"a": x / 980.665}, ("c0", "c1"))
    assert np.allclose(spectra.absolute_velocity_spectrum(gal, unit="g").orderBy("period_s").toPandas().sva_cm_s, got["a"], rtol=1e-9)
    top = {r.record_id: r for r in spectra.long_period_class(sva).collect()}
    assert top["a"].max_sva_cm_s == pytest.approx(got["a"].max()) and top["a"].critical_period_s == got["a"].idxmax()
    assert spectra.long_period_bands(sva).where("record_id = 'a'").count() == 7
    with pytest.raises(errors.InvalidAccelerationError):
        spectra.absolute_velocity_spectrum(frame(spark, {"a": burst(50)}))
    assert scale.band_range(1) == (1.6, 1.8) and scale.band_range(7) == (7.0, 7.8)


def test_spectrum_grid_converges(spark):
    df = frame(spark, {"a": burst()[:, :1]}, ("c0",))
    a, b = (spectra.spectrum_intensity(df, periods=design.spectrum_periods(n)).first().si_cm_s for n in (121, 481))
    assert a == pytest.approx(b, rel=2e-3)
    table = spectra.response_spectrum(df, (0.2, 1.0), 0.05).toPandas()
    assert np.allclose(table.psa_gal, (2 * np.pi / table.period_s) ** 2 * table.sd_cm)


# -- motion ----------------------------------------------------------------------------


def test_integration_of_a_sine(spark):
    t = np.arange(800) / 200
    x = 50 * np.sin(2 * np.pi * t)[:, None]
    v = motion.integrate(frame(spark, {"a": x}, ("c0",)), 200).orderBy("i").toPandas().c0
    assert np.allclose(v, 50 / (2 * np.pi) * (1 - np.cos(2 * np.pi * t)), atol=2e-3)


def test_preprocessing(spark):
    x = burst(500) + np.arange(500)[:, None] * 0.1 + 5
    df = frame(spark, {"a": x})
    flat = motion.detrend(df).orderBy("i").toPandas()[["c0", "c1", "c2"]].to_numpy()
    i = np.arange(500)
    assert np.allclose(flat, x - np.column_stack([np.polyval(np.polyfit(i, x[:, k], 1), i) for k in range(3)]), atol=1e-8)
    assert np.allclose(motion.remove_offset(df).agg(F.avg("c0"), F.avg("c1")).first(), 0, atol=1e-9)
    gain = motion.cosine_taper(df.withColumns({c: F.lit(1.0) for c in ("c0", "c1", "c2")}), 0.25).orderBy("i").toPandas().c0.to_numpy()
    assert gain[0] == 0 and gain[250] == 1 and np.allclose(gain, gain[::-1]) and np.allclose(gain[62], 0.5, atol=0.01)
    assert motion.cosine_taper(df, 0.0) is df
    single = frame(spark, {"one": x[:1]})
    assert motion.detrend(single).first().c0 == pytest.approx(0.0) and motion.cosine_taper(single).first().c0 == x[0, 0]


def clip_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clipping(spark):
    x = burst(600)
    x[100:106] = 2000
    got = clip_rows(motion.detect_clipping(frame(spark, {"a": x[:, :1]}, ("c0",)), max_range_gal=2000))
    assert ("a", 0, 100, 106, 2000.0, "known_range") in got and ("a", 0, 100, 106, 2000.0, "repeated_extreme") in got
    noise = np.random.default_rng(0).normal(0, 5, (1000, 1))
    noise[500:505] = 900
    assert clip_rows(motion.detect_clipping(frame(spark, {"a": noise}, ("c0",)))) == [("a", 0, 500, 505, 900.0, "repeated_extreme")]
    quiet = np.random.default_rng(0).normal(0, 0.01, (300, 1))
    quiet[100:110], quiet[200] = 0.05, 300
    assert clip_rows(motion.detect_clipping(frame(spark, {"a": quiet}, ("c0",)))) == []
    two = np.random.default_rng(1).normal(0, 1, (50, 3))
    two[10:12, 1] = 500
    df = frame(spark, {"a": two})
    assert clip_rows(motion.detect_clipping(df)) == [] and len(clip_rows(motion.detect_clipping(df, repeat_threshold=2))) == 1
    report = motion.clipping_report(motion.detect_clipping(df, repeat_threshold=2)).first()
    assert report.components_affected == [1] and report.interval_count == 1


def test_waveform_checks(spark):
    bad = burst(40)
    bad[3, 1] = np.inf
    with pytest.raises(Exception, match="finite"):
        motion.check_waveform(frame(spark, {"a": bad})).select(F.sum("c0")).collect()
    with pytest.warns(errors.MissingComponentWarning):
        motion.check_waveform(frame(spark, {"a": burst(40)}).drop("c2"))
    with pytest.warns(errors.NonstandardSamplingRateWarning):
        motion.check_rate(50)
    with pytest.raises(ValueError):
        motion.check_rate(0)
    flags = motion.quality_flags(frame(spark, {"a": burst(40)}).where("i <> 7"), 50).first()
    assert flags.gap_count == 1 and not flags.standard_rate
    t = spark.createDataFrame([("a", k / 100) for k in range(50)], "record_id string, t double")
    assert motion.sampling_diagnostics(t).first().is_uniform


def test_thin_keeps_ends(spark):
    df = spark.range(1001).select(F.lit("a").alias("record_id"), F.col("id").alias("i"))
    kept = sorted(r.i for r in motion.thin(df, 10).collect())
    assert kept[0] == 0 and kept[-1] == 1000 and len(kept) == 10
    assert motion.thin(df, 5000).count() == 1001


# -- streaming -------------------------------------------------------------------------


def stream(spark, tmp_path, chunks, run, mode):
    base = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
    for k, chunk in enumerate(chunks):
        chunk.coalesce(1).write.parquet(f"{base}/in/{k:03d}")
    source = spark.readStream.schema(chunks[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.parquet(f"{base}/out/b={number}")

    run(source).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("b")


@pytest.mark.parametrize("cuts", [(0, 300), (0, 1, 8, 39, 139, 300), (0, 150, 300)])
def test_streams_equal_batches(spark, tmp_path, cuts):
    df = frame(spark, {"a": burst(1100, seed=1)[700:1000], "b": burst(1100, gain=3)[600:900]})
    chunks = [df.where((F.col("i") >= a) & (F.col("i") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = stream(spark, tmp_path, chunks, lambda s: estimators.realtime_intensity_stream(s, window_s=0.5), "append")
    want = intensity.realtime_intensity(df, window_s=0.5)
    columns = ["record_id", "i", "resultant_gal", "threshold_gal", "intensity_raw", "record_max_intensity_raw"]
    assert compare.compare_results(got.select(columns), want.select(columns), ["record_id", "i"], rtol=1e-9, atol=1e-10).count() == 0
    two = [c.drop("c2") for c in chunks]
    got = queries.latest(stream(spark, tmp_path, two, estimators.long_period_stream, "update"), "record_id", "period_s")
    assert compare.compare_results(got, spectra.absolute_velocity_spectrum(df.drop("c2")), ["record_id", "period_s"]).count() == 0
    got = queries.latest(stream(spark, tmp_path, chunks, estimators.spectrum_intensity_stream, "update"), "record_id", "component")
    assert compare.compare_results(got.drop("sample_count"), spectra.spectrum_intensity(df), ["record_id", "component"]).count() == 0


def test_stream_order(spark, tmp_path):
    """Samples ahead of a gap wait, repeats are left out."""
    df = frame(spark, {"a": burst(900)[700:800]})
    order = [(50, 100), (0, 30), (0, 60), (30, 50)]
    chunks = [df.where((F.col("i") >= a) & (F.col("i") < b)) for a, b in order]
    got = stream(spark, tmp_path, chunks, lambda s: estimators.realtime_intensity_stream(s, window_s=0.5), "append")
    want = intensity.realtime_intensity(df, window_s=0.5)
    assert compare.compare_results(got.select("record_id", "i", "threshold_gal"), want.select("record_id", "i", "threshold_gal"), ["record_id", "i"]).count() == 0
    assert got.groupBy("batch").count().count() >= 2


def test_stream_resets(spark, tmp_path):
    """After a reset the estimator is a new one, wherever the batches are cut and in whatever order they come."""
    df = frame(spark, {"a": burst(900)[700:800], "b": burst(900, gain=3)[600:700]})
    at = [0, 17, 60, 61]
    flagged = df.withColumn("reset", F.col("i").isin(*at))
    chunks = [flagged.where((F.col("i") >= a) & (F.col("i") < b)) for a, b in [(70, 100), (0, 18), (10, 61), (61, 75)]]
    got = stream(spark, tmp_path, chunks, lambda s: estimators.realtime_intensity_stream(s, window_s=0.2, duration_s=0.1), "append")
    segment = sum((F.when(F.col("i") >= k, 1).otherwise(0) for k in at), F.lit(0))
    apart = df.withColumn("record_id", F.concat("record_id", F.lit(":"), segment.cast("string")))
    want = intensity.realtime_intensity(apart, window_s=0.2, duration_s=0.1).withColumn("record_id", F.substring_index("record_id", ":", 1))
    columns = ["record_id", "i", "resultant_gal", "threshold_gal", "record_max_intensity_raw"]
    assert compare.compare_results(got.select(columns), want.select(columns), ["record_id", "i"], rtol=1e-9, atol=1e-10).count() == 0
    long = queries.latest(stream(spark, tmp_path, [c.drop("c2") for c in chunks], estimators.long_period_stream, "update").where("sample_count = 39"), "record_id", "period_s")
    last = spectra.absolute_velocity_spectrum(apart.drop("c2")).where("record_id like '%:4'").withColumn("record_id", F.substring_index("record_id", ":", 1))
    assert compare.compare_results(long, last, ["record_id", "period_s"]).count() == 0


def test_stream_state_goes_when_idle(spark, tmp_path):
    """After the timer the record is forgotten: the same samples come again as a new record's."""
    df = frame(spark, {"a": burst(900)[700:740]})
    base, again = f"{tmp_path}/idle", df.withColumn("i", F.col("i") + 500)
    for k, chunk in enumerate((df, again)):
        chunk.coalesce(1).write.parquet(f"{base}/in/{k:03d}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", estimators.ROCKS)

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.parquet(f"{base}/out/b={number}")
        time.sleep(1.5)

    out = estimators.realtime_intensity_stream(source, window_s=0.2, duration_s=0.1, idle_s=1.0)
    running = out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(processingTime="300 milliseconds").start()
    for _ in range(60):
        if running.lastProgress and running.lastProgress["batchId"] >= 3:
            break
        time.sleep(0.5)
    running.stop()
    got = sorted(spark.read.parquet(f"{base}/out").select("i", "threshold_gal").collect())
    assert len(got) >= 40 and [r.threshold_gal for r in got[:40]][:9] == [None] * 9
    with pytest.raises(ValueError):
        estimators.realtime_intensity_stream(source, idle_s=0)


# -- spatial ---------------------------------------------------------------------------


def haversine(lon1, lat1, lon2, lat2):
    a, b, c, d = map(math.radians, (lon1, lat1, lon2, lat2))
    return 2 * geometry.EARTH_RADIUS_KM * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))


def station_frame(spark, n=25, seed=20260915, plane=False):
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(33, 37, n), rng.uniform(133, 138, n)
    value = rng.uniform(1, 20, n)
    return spark.createDataFrame([(k, float(a), float(b), float(v)) for k, (a, b, v) in enumerate(zip(lat, lon, value, strict=True))], "station_id int, lat double, lon double, value double"), lat, lon, value


def test_distances(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, (a, b, c, d))) for a, b, c, d in zip(rng.uniform(-180, 180, 50), rng.uniform(-90, 90, 50), rng.uniform(-180, 180, 50), rng.uniform(-90, 90, 50), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select("*", geometry.great_circle_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).collect()
    assert all(r.km == pytest.approx(haversine(r.a, r.b, r.c, r.d), rel=1e-7) for r in got)
    x, y = geometry.azimuthal_equidistant(F.col("a"), F.col("b"), 135.0, 35.0)
    got = df.select("*", F.hypot(x, y).alias("km")).collect()
    assert all(r.km == pytest.approx(haversine(r.a, r.b, 135, 35), rel=1e-6) for r in got)
    assert geometry.km_to_chord(1e9) == pytest.approx(2.0)


def test_grid(spark):
    grid = spatial.Grid.from_bounds(130, 30, 140, 40, shape=(2, 4))
    cells = grid.cells(spark).orderBy("row", "col").collect()
    assert [c.lon for c in cells[:4]] == [131.25, 133.75, 136.25, 138.75] and [cells[0].lat, cells[-1].lat] == [32.5, 37.5]
    coarse = spatial.Grid.from_bounds(130, 30, 140, 40, resolution_km=0.1)
    assert coarse.cell_count <= 750_000
    with pytest.raises(ValueError, match="max_cells"):
        spatial.Grid.from_bounds(130, 30, 140, 40, shape=(1000, 1000))
    with pytest.raises(ValueError):
        spatial.Grid.from_bounds(130, 30, 140, 40)


@pytest.mark.parametrize("radius", [None, 90.0])
def test_idw_brute_force(spark, radius):
    stations, lat, lon, value = station_frame(spark)
    grid = spatial.Grid(133, 33, 138, 37, (7, 9))
    config = spatial.IDWConfig(4, 2.0, radius, 2, allow_extrapolation=radius is None)
    for r in spatial.interpolate_surface(spark, stations, grid, "idw", config).collect():
        la, lo = 33 + (r.row + 0.5) * 4 / 7, 133 + (r.col + 0.5) * 5 / 9
        near = sorted((haversine(lo, la, b, a), k) for k, (a, b) in enumerate(zip(lat, lon, strict=True)))
        near = [p for p in near if radius is None or p[0] <= radius][:4]
        assert r.neighbor_count == len(near) and r.supported == (len(near) >= 2)
        if r.supported:
            w = [d**-2 for d, _ in near]
            assert r.value == pytest.approx(sum(x * value[k] for x, (_, k) in zip(w, near, strict=True)) / sum(w), rel=1e-6)
        else:
            assert r.value is None


def test_exact_station_wins(spark):
    stations = spark.createDataFrame([(1, 35.0, 135.0, 10.0), (2, 35.0, 136.0, 20.0)], "station_id int, lat double, lon double, value double")
    middle = spatial.interpolate_surface(spark, stations, spatial.Grid(135, 34.5, 136, 35.5, (1, 1)), "idw", spatial.IDWConfig(2, allow_extrapolation=True)).first()
    assert middle.value == pytest.approx(15.0)
    own = spatial.interpolate_surface(spark, stations, spatial.Grid(134.5, 34.5, 135.5, 35.5, (1, 1)), "idw", spatial.IDWConfig(2, allow_extrapolation=True)).first()
    assert own.value == 10.0


def test_linear_reproduces_a_plane(spark):
    stations, lat, lon, _ = station_frame(spark)
    grid = spatial.Grid(133, 33, 138, 37, (20, 20))
    x, y = geometry.azimuthal_equidistant(F.col("lon"), F.col("lat"), *grid.center)
    plane = 0.7 * x - 1.3 * y + 5
    made = spatial.apply_plan(spatial.build_plan(spark, stations, grid, "linear"), stations.withColumn("value", plane)).join(grid.cells(spark), ["row", "col"])
    rows = made.where("supported").select("value", plane.alias("want")).collect()
    assert len(rows) > 100 and all(r.value == pytest.approx(r.want, abs=1e-6) for r in rows)
    with pytest.raises(ValueError, match="line"):
        spatial.build_plan(spark, spark.createDataFrame([(k, 33.5 + k / 2, 135.5, 1.0) for k in range(6)], stations.schema), grid, "linear")
    far = stations.unionByName(spark.createDataFrame([(99, 0.0, 0.0, 1.0)], stations.schema))
    with pytest.raises(ValueError, match="span"):
        spatial.build_plan(spark, far, grid, "linear")


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(4).uniform(0, 100, (60, 2))
    tri, _ = triangulation.delaunay(p)
    circles = triangulation._circles(p, tri)
    gap = ((p[None] - circles[:, None, :2]) ** 2).sum(axis=2) - circles[:, None, 2]
    assert (gap > -1e-6).all()
    area = np.abs(triangulation._turn(p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]])).sum() / 2
    hull = sorted(map(tuple, p))

    def half(points):
        out = []
        for q in points:
            while len(out) >= 2 and triangulation._turn(np.array(out[-2]), np.array(out[-1]), np.array(q)) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(hull) + half(hull[::-1]))
    want = abs(np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - ring[:, 1] * np.roll(ring[:, 0], -1))) / 2
    assert area == pytest.approx(want, rel=1e-9)


def test_nearest_takes_any_number_of_stations(spark):
    rng = np.random.default_rng(4)
    at = np.vstack([rng.uniform((34.9, 134.9), (35.1, 135.1), (30, 2)), [[-35.0, -45.0]]])
    cells = np.vstack([rng.uniform((30, 130), (40, 140), (20, 2)), [[-10.0, 20.0], [at[0, 0], at[0, 1]]]])
    stations = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "station_id int, lat double, lon double")
    frame = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(cells)], "row int, col int, lat double, lon double")

    def unit(p):
        b, a = np.radians(p.T)
        return np.column_stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])

    km = 2 * 6371.0088 * np.arcsin(np.minimum(np.linalg.norm(unit(cells)[:, None] - unit(at)[None], axis=2) / 2, 1))
    for limit in (40.0, None):
        config = spatial.NearestConfig(max_distance_km=limit, allow_extrapolation=limit is None)
        got = {r.row: r for r in spatial.nearest_plan(frame, stations, config).collect()}
        assert len(got) == len(cells)
        for i, d in enumerate(km):
            assert got[i].nearest_km == pytest.approx(d.min(), abs=1e-6)
            assert got[i].station_id == (int(d.argmin()) if limit is None or d.min() <= limit else None)


def test_spatial_arguments(spark):
    with pytest.raises(ValueError, match="extrapolation"):
        spatial.IDWConfig(4)
    with pytest.raises(TypeError):
        spatial.build_plan(spark, station_frame(spark)[0], spatial.Grid(0, 0, 1, 1, (1, 1)), "idw", spatial.NearestConfig(10.0))
    twice = spark.createDataFrame([(1, 35.0, 135.0), (2, 35.0, 135.0)], "station_id int, lat double, lon double")
    with pytest.raises(Exception, match="share"):
        spatial.check_stations(twice).collect()
    assert spatial.IDWConfig.suzuki_2017_pga().minimum_neighbors == 4


def test_colours(spark):
    surface = spark.createDataFrame([(0, 0, 1.0, True), (0, 1, 3.0, True), (1, 0, None, False), (1, 1, 9.0, True)], "row int, col int, value double, supported boolean")
    colors = render.surface_colors(surface, render.palette(spark, [(0.0, "#000000"), (1.0, "#ffffff")]), 1, 5, opacity=0.5)
    assert {(r.row, r.col): (r.r, r.a) for r in colors.collect()} == {(0, 0): (0, 128), (0, 1): (128, 128), (1, 1): (255, 128)}
    png = render.colors_to_png(colors, (2, 2))
    assert png.startswith(b"\x89PNG") and png.endswith(b"IEND\xaeB`\x82")
    assert render.class_colors(surface, {3.0: "#0a0b0c"}).select("r", "g", "b").collect() == [(10, 11, 12)]
    land = render.land_cells(spatial.Grid(130, 30, 131, 31, (2, 2)).cells(spark), spark.createDataFrame([(25, 25)], "r int, c int"), 130, 30, 0.01)
    assert [(r.row, r.col) for r in land.collect()] == [(0, 0)]


def test_figure_frames(spark):
    df = frame(spark, {"a": burst(300)})
    assert render.acceleration_frame(df, 100, 50).count() == 50
    curve = motion.amplitude_duration_curve(df.select("record_id", motion.resultant().alias("amplitude")), 100.0)
    assert render.amplitude_duration_frame(curve, 30).where("selected").count() == 1
    assert render.components_frame(spark, points=10).count() == 10 and render.intensity_bands(spark, 1.0, 5.2).count() == 6
    stations, *_ = station_frame(spark)
    assert render.map_frame(stations).where("class is null").count() == 0 and render.map_layout(stations).first().center_lat > 33
    assert render.color_values(stations, "log").where("color_value is null").count() == 0


# -- sources ---------------------------------------------------------------------------

TEXT = "Site Code,ABC1\nLatitude 35.5 N\nLongitude 135.25 E\nSampling Rate 100Hz\nUnit gal(cm/s/s)\nInitial Time 2024 01 02 03 04 05.25\nNS,EW,UD\n1.0,2.0,3.0\n-1 2e1 .5\n"


def test_text_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/utf8.csv").write_bytes(b"\xef\xbb\xbf" + TEXT.replace("ABC1", "松本").encode())
    (tmp_path / "in/cp932.csv").write_bytes(TEXT.replace("ABC1", "松本").replace("\n", "\r\n").encode("cp932"))
    rows = records.read_text_records(spark, str(tmp_path / "in")).collect()
    assert [r.station_code for r in rows] == ["松本"] * 2 and all(r.error is None for r in rows)
    r = rows[0]
    assert (r.latitude_deg, r.longitude_deg, r.sampling_rate_hz, r.unit) == (35.5, 135.25, 100.0, "gal(cm/s/s)") and r.start_time.microsecond == 250_000
    assert r.samples == [[1.0, 2.0, 3.0], [-1.0, 20.0, 0.5]] and r.component_names == ["NS", "EW", "UD"]
    wave = records.waveform_table(records.record_table(records.read_text_records(spark, str(tmp_path / "in"))))
    assert wave.count() == 4 and sorted(x.c1 for x in wave.collect()) == [2.0, 2.0, 20.0, 20.0]


@pytest.mark.parametrize(("change", "message"), [
    (("1.0,2.0,3.0", "1.0,2.0"), "another number"), (("-1 2e1 .5", "-1 x .5"), "isn't a number"), (("35.5", "95.5"), "latitude"), (("100Hz", "none"), "rate"),
    (("2024 01 02", "2024 13 02"), "start time"), (("NS,EW,UD", "NS,EW,UD,X"), "one to three"), (("1.0,2.0,3.0\n-1 2e1 .5\n", ""), "seven header"), (("1.0,2.0", "NaN,2.0"), "finite"),
])
def test_malformed_records(spark, change, message):
    df = spark.createDataFrame([("x", TEXT.replace(*change))], "source string, text string")
    parsed = records.parse_text_records(df)
    assert message in parsed.first().error
    assert records.record_table(parsed, strict=False).count() == 0
    with pytest.raises(Exception, match=message):
        records.record_table(parsed).collect()


def trace_frame(spark, channels=("HNN", "HNE", "HNZ"), n=5, rate=100.0):
    import datetime

    rows = [("XX", "STA", "", c, rate, datetime.datetime(2024, 1, 1), 2.0, i, float(i + 10 * k)) for k, c in enumerate(channels) for i in range(n)]
    return spark.createDataFrame(rows, "network string, station_code string, location string, channel string, sampling_rate_hz double, start_time timestamp_ntz, calib double, i long, x double")


def test_traces(spark):
    traces = records.apply_calibration(trace_frame(spark, ("HNZ", "HNE", "HNN")))
    heads, wave = records.traces_to_waveform(traces, "gal")
    assert heads.first().channel_codes == ["HNN", "HNE", "HNZ"] and heads.first().component_names == ["NS", "EW", "UD"]
    assert sorted((r.i, r.c0, r.c1, r.c2) for r in wave.collect())[1] == (1, 42.0, 22.0, 2.0)
    for bad, message in ((("HNN", "HNN1"[:3], "HN1"), "two channels"), (("HNX",), "isn't known")):
        with pytest.raises(Exception, match=message):
            records.traces_to_waveform(trace_frame(spark, bad), "gal")[0].collect()
    with pytest.raises(Exception, match="missing"):
        records.traces_to_waveform(traces.where("not (channel = 'HNE' and i = 2)"), "gal")[1].collect()
    _, two = records.traces_to_waveform(traces, "gal", ["HNE", "HNZ"])
    assert two.where("c2 is not null").count() == 0


def test_published_tables(spark, tmp_path):
    (tmp_path / "max.csv").write_bytes("code,name\nA1,松本,35.1,135.2,4,1,2,3,4,5,6,7,8,9,10,11,12\nB2,x,36,136,-,1,2,3,4,5,6,7,8,9,10,11,12\n".encode("cp932"))
    (tmp_path / "level.csv").write_bytes("code,name\nA1,松本,,,,2,1,1,2,2,1,0,0,35.1,135.2\n".encode("cp932"))
    (tmp_path / "sp.csv").write_bytes(b"note,x\nperiod,0.050_hz\n1.6,12.5\n1.8,13\n")
    summary, levels = (records.read_published(spark, str(tmp_path / n), c) for n, c in (("max.csv", records.SUMMARY), ("level.csv", records.LEVELS)))
    joined = records.join_published(summary, levels).collect()
    assert len(joined) == 1 and joined[0].name == "松本" and joined[0].pga == 4.0 and joined[0].long_period_class == "2"
    assert summary.where("intensity_class is null").count() == 1
    assert records.read_published(spark, str(tmp_path / "sp.csv"), {"period_s": 0, "sva": 1}, "period,").count() == 2


def test_event_job(spark):
    df = frame(spark, {"a": burst(3000), "b": burst(3000, gain=4)})
    got = event.station_quantities(df)
    assert got.count() == 2
    published = got.select("record_id", (F.col("pga_gal") * 1.001).alias("pga_gal"), "intensity_class")
    joined = event.against_published(got, published)
    report = event.error_report(joined, "pga_gal", "published_pga_gal").first()
    assert report.stations == report.within == 2 and report.median_relative_error == pytest.approx(0.001, rel=0.01)
    assert event.class_report(joined, "intensity_class", "published_intensity_class").first().agreeing == 2
    assert event.strongest(got, 1).first().record_id == "b"


def test_synthetic(spark):
    a = records.synthetic_motion(spark, duration_s=5, noise_std=0.0)
    assert a.count() == 500 and records.synthetic_motion(spark, duration_s=2).count() == 200
    t = 100 / 100
    want = math.exp(-0.5 * ((t - 2.25) / 2.5) ** 2) * 90 * math.sin(2 * math.pi * 1.1 * t)
    assert a.where("i = 100").first().c0 == pytest.approx(want)


def test_download_arguments(tmp_path):
    with pytest.raises(ValueError, match="http"):
        records.download_record("file:///x", str(tmp_path / "y"))
    (tmp_path / "y").write_text("")
    with pytest.raises(FileExistsError):
        records.download_record("http://localhost/x", str(tmp_path / "y"))


# -- comparison ------------------------------------------------------------------------


def test_compare_results(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("-inf"), None), (3, None, "z")], "k int, v double, s string")
    assert compare.compare_results(a, a, ["k"]).count() == 0
    b = spark.createDataFrame([(1, 1.5, "x"), (2, float("inf"), None), (4, None, "z")], "k int, v double, s string").withColumn("extra", F.lit(1))
    got = {r.field: r for r in compare.compare_results(a, b, ["k"]).collect()}
    assert got["v"].max_abs_err == 0.5 and "extra" in got and "s" not in got and "(rows)" in got


def test_methods(spark):
    assert compare.method_table(spark).count() == 9 and compare.method_descriptor("housner_spectrum_intensity")["status"] == "reference"
    with pytest.raises(ValueError, match="known"):
        compare.method_descriptor("x")


def test_rolling_paths_agree(spark):
    x = np.random.default_rng(1).normal(size=300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "record_id string, i long, x double")
    short = intensity.rolling_kth_largest(df, 64, 7).orderBy("i").toPandas().kth
    rank = kernels.RollingRank(64, 7)
    assert np.allclose(short, np.array([rank.update(v) for v in x.tolist()], float), equal_nan=True)


def test_records_are_cut_at_batch_edges(spark):
    """Records of all lengths, over several batches and with several to a batch, are the same as alone."""
    from quakeframe.operators import batches

    sizes = [1, 40, 3, 17, 16, 5, 90, 2]
    rng = np.random.default_rng(3)
    x = {k: rng.normal(size=(n, 2)) for k, n in enumerate(sizes)}
    rows = [(f"r{k}", i, float(v[0]), None if k == 3 else float(v[1])) for k, a in x.items() for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "record_id string, i long, c0 double, c1 double").repartition(5)
    calls = []

    def kernel(records):
        calls.append(1)
        n = len(records.sizes)
        return np.arange(n), [records.sizes, np.add.reduceat(records.x[:, 0], records.starts[:-1]), np.full(n, len(calls)), records.have[:, 1]]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = batches.map_whole(df.repartition(1), ["c0", "c1"], "n long, total double, call long, second boolean", kernel).collect()
        filtered = {(r.record_id, r.i): (r.c0, r.c1) for r in intensity.high_pass(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.record_id, r.n, round(r.total, 9), r.second) for r in got) == [(f"r{k}", n, round(float(x[k][:, 0].sum()), 9), k != 3) for k, n in enumerate(sizes)]
    assert max(r.call for r in got) > 1 and len(filtered) == sum(sizes)
    numerator, denominator, gain = design.design_high_pass(100.0)
    for k, a in x.items():
        want = kernels.filter_series([kernels.direct_form(numerator, denominator)], a)[0] * gain
        for i in range(len(a)):
            c0, c1 = filtered[(f"r{k}", i)]
            assert abs(c0 - want[i, 0]) < 1e-12 and (c1 is None if k == 3 else abs(c1 - want[i, 1]) < 1e-12)


def test_many_records_share_a_kernel_call(spark):
    """Nothing runs Python once a record any more where records are short."""
    rows = spark.range(3000).selectExpr("id % 100 as record_id", "id div 100 as i", "sin(id) as c0", "cos(id) as c1", "sin(id * 2) as c2")
    for out in (intensity.measured_intensity(rows), intensity.high_pass(rows), intensity.realtime_intensity(rows), spectra.spectrum_intensity(rows), spectra.absolute_velocity_spectrum(rows.drop("c2"))):
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_texts_are_cut_into_lines_once(spark):
    """Every check of a record that cut its text anew would show as one more pattern in the plan."""
    df = spark.createDataFrame([("a", "x")], "source string, text string")
    parsed = records.waveform_table(records.record_table(records.parse_text_records(df), strict=False))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text") <= 2, plan.count("regexp_replace(text")
