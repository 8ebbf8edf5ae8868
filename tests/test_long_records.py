"""Records cut into blocks give what whole records give."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quakeframe.errors import InvalidAccelerationError
from quakeframe.operators import blocks, design, fourier, intensity, kernels, motion, spectra
from quakeframe.plans import long_records  # noqa: F401  (its queries)
from quakeframe.plans.queries import ORACLES, QUERIES
from tests.oracle import duck_rows, spark_rows

BLOCK = 300


@pytest.fixture(scope="module")
def waveform(spark):
    rng = np.random.default_rng(4)
    rows = [(name, i, *map(float, x)) for name, n in (("long", 2000), ("edge", 600), ("short", 50), ("one", 1)) for i, x in enumerate(rng.normal(0, 30, (n, 3)))]
    return spark.createDataFrame(rows, "record_id string, i long, c0 double, c1 double, c2 double").repartition(5).cache()


def same(got, want, keys, tolerance=1e-9):
    names = [c for c in want.columns if c not in keys]
    a = {tuple(r[k] for k in keys): [r[c] for c in names] for r in got.select(*want.columns).collect()}
    b = {tuple(r[k] for k in keys): [r[c] for c in names] for r in want.collect()}
    assert a.keys() == b.keys() and len(a) == want.count()
    # Within a part in 10**9 of the column's greatest value.
    peaks = [max((abs(row[j]) for row in b.values() if row[j] is not None and np.isfinite(row[j])), default=1.0) for j in range(len(names))]
    for k, row in b.items():
        for x, y, peak in zip(a[k], row, peaks, strict=True):
            assert (x is None) == (y is None)
            assert x is None or x == y or abs(x - y) <= tolerance * max(peak, 1.0), (k, a[k], row)


@pytest.mark.parametrize("run", [intensity.high_pass, intensity.strong_motion_velocity, intensity.strong_motion_displacement, lambda df, block: intensity.realtime_filter(df, design.design_realtime_filter(100.0), block=block)])
def test_filters(waveform, run):
    # The published direct forms lose digits: in extended precision the serial kernel itself is 1.4e-8 off at 5 s.
    loose = run in (intensity.strong_motion_velocity, intensity.strong_motion_displacement)
    same(run(waveform, block=BLOCK), run(waveform, block=None), ["record_id", "i"], 1e-8 if loose else 1e-9)


def test_filters_of_fewer_components(waveform):
    two = waveform.withColumn("c1", F.lit(None).cast("double"))
    same(intensity.high_pass(two, block=BLOCK), intensity.high_pass(two, block=None), ["record_id", "i"])
    part = waveform.withColumn("c1", F.when(F.col("i") < BLOCK, F.col("c1")))
    with pytest.raises(Exception, match="part of its samples"):
        intensity.high_pass(part, block=BLOCK).collect()
    with pytest.raises(Exception, match="numbered from 0"):
        intensity.high_pass(waveform.withColumn("i", F.col("i") + 1), block=BLOCK).collect()


@pytest.mark.parametrize("series", [False, True])
def test_oscillators(waveform, series):
    run = lambda block: spectra.oscillator_responses(waveform.drop("c2"), (0.3, 2.0), 0.05, series=series, block=block)
    same(run(BLOCK), run(None), ["record_id", "i", "period_s", "component"] if series else ["record_id", "period_s", "component"])


@pytest.mark.parametrize("high_pass", [False, True])
def test_absolute_velocity(waveform, high_pass):
    run = lambda block: spectra.absolute_velocity_spectrum(waveform.drop("c2"), periods=(1.6, 7.8), high_pass=high_pass, block=block)
    same(run(BLOCK), run(None), ["record_id", "period_s"])


@pytest.mark.parametrize("window_s", [0.5, 2.5, 9.0])
def test_realtime(waveform, window_s):
    run = lambda block: intensity.realtime_intensity(waveform, window_s=window_s, block=block, keep_components=True)
    same(run(BLOCK), run(None), ["record_id", "i"])


def test_integrals_and_running_values(waveform):
    same(motion.integrate(waveform, block=BLOCK), motion.integrate(waveform), ["record_id", "i"])
    same(motion.integrate_twice(waveform, block=BLOCK), motion.integrate_twice(waveform), ["record_id", "i"])
    holes = waveform.withColumn("c0", F.when(F.col("i") % 7 != 3, F.col("c0")))
    same(motion.integrate(holes, block=BLOCK), motion.integrate(holes), ["record_id", "i"])
    whole = holes.withColumn("c0", F.max("c0").over(motion.ordered_window().rowsBetween(Window.unboundedPreceding, 0)))
    same(blocks.running(holes, ["c0"], BLOCK, "max"), whole, ["record_id", "i"])


@pytest.mark.parametrize("window,k", [(65, 1), (137, 11), (700, 30)])
def test_rolling_ranks(waveform, window, k):
    series = waveform.select("record_id", "i", F.when(F.col("i") % 5 != 2, F.round("c0")).alias("x"))
    run = lambda block: intensity.rolling_kth_largest(series, window, k, block=block)
    same(run(BLOCK), run(None), ["record_id", "i"])
    gaps = series.where("i % 11 <> 4")  # numbers are missing: the latest rows are not the latest numbers
    same(intensity.rolling_kth_largest(gaps, window, k, block=BLOCK), intensity.rolling_kth_largest(gaps, window, k, block=None), ["record_id", "i"])


@pytest.mark.parametrize("window,k", [(50, 5), (40, 40), (40, 1), (1, 1), (30, 10), (137, 11)])
def test_rolling_rank_is_the_sorted_list(window, k):
    rng = np.random.default_rng(42)
    for values in (np.tile([1e9, -1e9], 1000), rng.integers(0, 5, 3000).astype(float), np.where(rng.random(2000) < 0.3, np.nan, rng.normal(size=2000)), np.zeros(0), np.array([np.nan, -np.inf, 3.0, np.inf])):
        rank = kernels.RollingRank(window, k)
        want = np.array([rank.update(v) for v in values.tolist()], float)
        assert np.array_equal(kernels.rolling_rank(values, window, k), want, equal_nan=True)


@pytest.mark.parametrize("tile", [4, 64])
def test_transform_of_any_length(spark, tile):
    rng = np.random.default_rng(6)
    data = {n: rng.normal(0, 30, (n, 3)) for n in (1, 2, 3, 7, 16, 101, 997, 2048)}
    rows = [(n, i, *map(float, x)) for n, d in data.items() for i, x in enumerate(d)]
    df = spark.createDataFrame(rows, "record_id int, i long, c0 double, c1 double, c2 double")
    got = fourier.filter_whole(df, ["c0", "c1", "c2"], kernels.measured_gain, 100.0, tile).toPandas()
    for n, x in data.items():
        y = got[got["record_id"] == n].sort_values("i")
        assert y["i"].tolist() == list(range(n))
        assert np.abs(y[["c0", "c1", "c2"]].to_numpy() - kernels.measured_filter(x, 100.0)).max() < 1e-11


def test_measured_intensity(waveform):
    long = waveform.where("record_id in ('long', 'edge')")
    columns = ["record_id", "sample_count", "component_count", "threshold_gal", "input_pga_gal", "filtered_pga_gal", "intensity_raw", "intensity"]
    same(intensity.measured_intensity(long, block=BLOCK).select(columns), intensity.measured_intensity(long, block=None).select(columns), ["record_id"])
    two = long.withColumn("c1", F.lit(None).cast("double"))
    same(intensity.measured_intensity(two, allow_fewer=True, block=BLOCK).select(columns), intensity.measured_intensity(two, allow_fewer=True, block=None).select(columns), ["record_id"])
    with pytest.raises(Exception, match="three components"):
        intensity.measured_intensity(two, block=BLOCK).collect()
    with pytest.raises(Exception, match="without gaps"):
        intensity.measured_filter(long.where("i <> 5"), block=BLOCK).collect()


@pytest.mark.parametrize("parts,most,count", [(1024, 1 << 16, 30), (64, 8, 600)])
def test_selection_without_sorting(spark, parts, most, count):
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(size=900), "ties": rng.integers(0, 3, 700).astype(float), "one": np.full(650, -2.5), "wide": 10.0 ** rng.uniform(-4, 4, 600)}
    rows = spark.createDataFrame([(k, float(v)) for k, d in data.items() for v in d], "record_id string, v double")
    got = {r.record_id: r.threshold for r in motion.select_rank(rows, count, parts, most).collect()}
    assert got == {k: float(np.sort(d)[-count]) for k, d in data.items()}
    with pytest.raises(Exception, match="fewer than"):
        motion.select_rank(rows, 901, parts, most).collect()


def test_composed_filter_is_the_cascade():
    filters = kernels.cascade(design.design_realtime_filter(100.0).sos)
    x = np.random.default_rng(1).normal(size=(5000, 2))
    want, _ = kernels.filter_series(filters, x)
    made = blocks.compose(filters)
    got = np.concatenate([y[0] for _, y in made.run(x, np.zeros((1, made.b.shape[1], 2)))])
    assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()


def test_tasks_see_a_block_at_most(waveform, spark):
    rows = waveform.withColumn("block", blocks.number(BLOCK))
    made = blocks.compose([kernels.direct_form(*design.VELOCITY_FILTER)])
    seen = blocks.run_blocks(rows, ["c0"], made, "n long", lambda pdf, i, x, state, have: __import__("pandas").DataFrame({"n": [len(x)]})).collect()
    assert max(r.n for r in seen) == BLOCK and sum(r.n for r in seen) == 2651


def test_block_arguments(waveform):
    with pytest.raises(ValueError):
        blocks.choose(waveform, 0)
    assert blocks.choose(waveform, None) is None and blocks.choose(waveform, 2000) is None and blocks.choose(waveform, 1999) == 1999
    assert blocks.lengths(waveform) == blocks.Lengths(1999, False)
    assert issubclass(InvalidAccelerationError, Exception)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_long_record")))
def test_long_record_twins(spark, name):
    path = "/root/testdata/sf0.001"
    assert spark_rows(QUERIES[name](spark, path)) == duck_rows(ORACLES[name], path)


def test_short_blocks_share_kernel_calls(spark):
    """1,563 blocks of 64 samples: a call of the filter sees dozens of them side by side."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 20, 100_001)
    rows = spark.range(0, 100_001, 1, 4).selectExpr("'r' AS record_id", "id AS i", "floor(id / 64) AS block")
    values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, c0 double")
    made = blocks.compose([kernels.direct_form(*design.VELOCITY_FILTER)])
    finish = lambda pack: (np.arange(pack.blocks), [np.full(pack.blocks, pack.blocks), pack.column("block")[0]])
    seen = blocks.run_packs(rows.join(values, "i").select("record_id", "i", "block", "c0"), ["c0"], made, "shared long, own long", finish).collect()
    assert sorted(r.own for r in seen) == list(range(1563)) and np.median([r.shared for r in seen]) > 50
