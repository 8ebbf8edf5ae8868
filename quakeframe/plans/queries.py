"""One query per operator over the given tables, and its SQL twin.

Events stand in for waveforms: a user is a station, its events in time order are the
samples.  The designed coefficients of the causal intensity filters enter the SQL as
constants; oscillators' coefficients, recursions, Fourier sums, order statistics and rounding
are written anew there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import response, scale, units
from ..functions.duration import sample_count_column
from ..operators import compare, design, intensity, motion, render, spatial, spectra
from ..streaming import estimators
from .storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PERIODS = (0.2, 0.5, 1.0, 1.7, 2.4)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


# -- the waveform view -----------------------------------------------------------------

WAVE = """wave AS (
  SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         value * sin(event_id) AS c0, value * cos(event_id) AS c1, value - 30.0 AS c2 FROM events
)"""
ALL = ("c0", "c1", "c2")
TWO = ("c0", "c1")


def wave(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ALL) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    value, number = F.col("value"), F.col("event_id").cast("double")
    made = {"c0": value * F.sin(number), "c1": value * F.cos(number), "c2": value - 30.0}
    return e.select(F.col("user_id").alias("record_id"), i.cast("long").alias("i"), *[made[c].alias(c) for c in names])


def r6(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {digits}) + 0.0 AS {c.split(' AS ')[-1]}" for c in columns)


def cascade_sql(sections: list[tuple[tuple[float, ...], tuple[float, ...]]], name: str = "flt", names: tuple[str, ...] = ALL, source: str = "wave", gain: float = 1.0) -> str:
    """A recursive table of filtered samples: transposed direct form II, one step per sample, all records together."""
    orders = [len(a) - 1 for _, a in sections]
    z = [f"{c}_s{k}z{m}" for c in names for k, n in enumerate(orders) for m in range(1, n + 1)]

    def step(start: str) -> str:
        inner = start
        for k, (b, _) in enumerate(sections):
            ys = ", ".join(f"{b[0]!r} * {c}_x{k} + {c}_s{k}z1 AS {c}_x{k + 1}" for c in names)
            inner = f"SELECT *, {ys} FROM ({inner})"
        out = [f"{c}_x{len(sections)} AS {c}" for c in names]
        for c in names:
            for k, (b, a) in enumerate(sections):
                for m in range(1, orders[k] + 1):
                    carried = f" + {c}_s{k}z{m + 1}" if m < orders[k] else ""
                    out.append(f"{b[m]!r} * {c}_x{k} - ({a[m]!r}) * {c}_x{k + 1}{carried} AS {c}_s{k}z{m}")
        return f"SELECT record_id, i, {', '.join(out)} FROM ({inner})"

    xs = ", ".join(f"w.{c} AS {c}_x0" for c in names)
    first = f"SELECT w.record_id, w.i, {xs}, {', '.join(f'0.0::DOUBLE AS {s}' for s in z)} FROM {source} w WHERE w.i = 0"
    later = f"SELECT w.record_id, w.i, {xs}, {', '.join(f'p.{s} AS {s}' for s in z)} FROM {name}_r p JOIN {source} w ON w.record_id = p.record_id AND w.i = p.i + 1"
    cols = ", ".join(f"{gain!r} * {c} AS {c}" for c in names)
    return f"{name}_r AS ({step(first)} UNION ALL {step(later)}),\n{name} AS (SELECT record_id, i, {cols} FROM {name}_r)"


def sos(made: design.Design) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
    return [(s[:3], s[3:]) for s in made.sections]


#: The published filters as the twins take them (fixed values, numerator and denominator), apart from the library's own.
HIGH_PASS = ((1.0, -2.0, 1.0), (1.0, -1.995438545842, 0.995448925627))
VELOCITY = ((0.004937561699, -0.004937561699, -0.004937561699, 0.004937561699), (1.0, -2.974867761716, 2.950050339269, -0.975180618018))
DISPLACEMENT = ((0.00002485615736514583, 0.00004971231473029166, 0.00002485615736514583), (1.0, -1.988438073558305, 0.9885471048650272))


def bank_sql(periods: tuple[float, ...], h: float, rate: float) -> str:
    """The step of every oscillator for piecewise linear input, by the formulas of Nigam and Jennings (1969), reckoned in SQL."""
    values = ", ".join(f"({float(t)!r}::DOUBLE)" for t in periods)
    return f"""bank AS (
  SELECT period_s, e * (q * s + c) AS a11, e * s / wd AS a12, -w / r * e * s AS a21, e * (c - q * s) AS a22,
    e * ((k + {h!r} / w) * s / wd + (g + 1 / (w * w)) * c) - g AS b11,
    e * ((k + {h!r} / w) * (c - q * s) - (g + 1 / (w * w)) * (wd * s + {h!r} * w * c)) + {rate!r} / (w * w) AS b21,
    -e * (k * s / wd + g * c) - 1 / (w * w) + g AS b12,
    -e * (k * (c - q * s) - g * (wd * s + {h!r} * w * c)) - {rate!r} / (w * w) AS b22
  FROM (SELECT *, exp(-{h!r} * w / {rate!r}) AS e, sin(wd / {rate!r}) AS s, cos(wd / {rate!r}) AS c, {h!r} / r AS q,
               (2 * {h!r} * {h!r} - 1) * {rate!r} / (w * w) AS k, 2 * {h!r} * {rate!r} / (w * w * w) AS g
        FROM (SELECT *, w * r AS wd FROM (SELECT period_s, 2 * pi() / period_s AS w, sqrt(1 - {h!r} * {h!r}) AS r FROM (VALUES {values}) p(period_s))))
)"""


def oscillator_sql(rate: float, source: str, name: str = "osc") -> str:
    """(record_id, period_s, component, i, x, d, v) of every oscillator, by recursion; source is (record_id, i, component, x)."""
    return f"""{name} AS (
  SELECT record_id, period_s, component, i, x, 0.0::DOUBLE AS d, -x / {rate!r} AS v FROM {source}, bank WHERE i = 0
  UNION ALL
  SELECT p.record_id, p.period_s, p.component, n.i, n.x, b.a11 * p.d + b.a12 * p.v + b.b11 * p.x + b.b12 * n.x, b.a21 * p.d + b.a22 * p.v + b.b21 * p.x + b.b22 * n.x
  FROM {name} p JOIN {source} n ON n.record_id = p.record_id AND n.component = p.component AND n.i = p.i + 1 JOIN bank b ON b.period_s = p.period_s
)"""


def flat_sql(source: str, names: tuple[str, ...], name: str = "flat") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT record_id, i, {k} AS component, {c} AS x FROM {source}" for k, c in enumerate(names)) + ")"


def reported_sql(v: str) -> str:
    """Through decimals: half up to hundredths, then truncated."""
    exact = f"CAST(CAST({v} AS VARCHAR) AS DECIMAL(38, 18))"
    return f"CASE WHEN {v} IS NULL OR isinf({v}) THEN {v} ELSE CAST(trunc(round({exact}, 2) * 10) AS DOUBLE) / 10 + 0.0 END"


def class_sql(v: str, lower: tuple[float, ...] = scale.LOWER, names: tuple[str, ...] = scale.CLASSES) -> str:
    steps = " ".join(f"WHEN {v} >= {b} THEN '{n}'" for b, n in reversed(list(zip(lower, names, strict=True))[1:]))
    return f"CASE WHEN {v} IS NULL THEN NULL {steps} ELSE '{names[0]}' END"


def raw_sql(a: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {a} < 0 THEN NULL WHEN {a} = 0 THEN '-Infinity'::DOUBLE ELSE 2 * log10({a}) + 0.94 END"


# -- measured intensity ----------------------------------------------------------------

MEASURED = f"""{WAVE},
size AS (SELECT record_id, count(*) AS n FROM wave GROUP BY record_id),
freq AS (SELECT record_id, n, k, k * 100.0 / n AS f, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS w FROM size, range(0, 5000) g(k) WHERE k <= n // 2),
gain AS (SELECT *, CASE WHEN f = 0 THEN 0 ELSE
  1 / sqrt(f) / sqrt(1 + 0.694 * pow(f / 10, 2) + 0.241 * pow(f / 10, 4) + 0.0557 * pow(f / 10, 6) + 0.009664 * pow(f / 10, 8) + 0.00134 * pow(f / 10, 10) + 0.000155 * pow(f / 10, 12))
  * sqrt(1 - exp(-pow(f / 0.5, 3))) END AS g FROM freq),
spec AS (SELECT g.record_id, g.n, g.k, any_value(g.w) AS w, any_value(g.g) AS g,
  {', '.join(f"sum({c} * cos(2 * pi() * g.k * i / g.n)) AS {c}r, -sum({c} * sin(2 * pi() * g.k * i / g.n)) AS {c}i" for c in ALL)}
  FROM gain g JOIN wave USING (record_id) GROUP BY g.record_id, g.n, g.k),
filtered AS (SELECT w.record_id, w.i, {', '.join(f"sum(s.w * s.g * (s.{c}r * cos(2 * pi() * s.k * w.i / s.n) - s.{c}i * sin(2 * pi() * s.k * w.i / s.n))) / any_value(s.n) AS {c}" for c in ALL)}
  FROM wave w JOIN spec s USING (record_id) GROUP BY w.record_id, w.i),
amp AS (SELECT record_id, i, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS amplitude FROM filtered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY amplitude DESC) AS rk FROM amp),
measured AS (SELECT record_id, threshold_gal, intensity_raw, {reported_sql('intensity_raw')} AS intensity FROM (
  SELECT record_id, amplitude AS threshold_gal, {raw_sql('amplitude')} AS intensity_raw FROM ranked WHERE rk = 30))"""


@query(f"WITH {MEASURED} SELECT record_id, {r6('threshold_gal', 'intensity_raw', 'intensity')}, {class_sql('intensity')} AS intensity_class FROM measured")
def measured_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intensity.measured_intensity(wave(spark, sf_dir))
    return rounded(out.select("record_id", "threshold_gal", "intensity_raw", "intensity", "intensity_class"))


@query(f"WITH {MEASURED} SELECT record_id, i, {r6('amplitude')} FROM amp")
def measured_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.filtered_resultant(wave(spark, sf_dir)))


@query(f"WITH {MEASURED}, s AS (SELECT record_id, pow(10, (4.0 - intensity_raw) / 2) AS k FROM measured) SELECT record_id, i, {r6('k * c0 AS c0', 'k * c1 AS c1', 'k * c2 AS c2', digits=4)} FROM wave JOIN s USING (record_id)")
def scale_to_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.scale_to_intensity(wave(spark, sf_dir), 4.0), 4)


# -- peaks, integration, preprocessing -------------------------------------------------

RESULTANT = "sqrt(c0 * c0 + c1 * c1 + c2 * c2)"


@query(f"WITH {WAVE} SELECT record_id, {r6('max(abs(c0)) AS peak_c0', 'max(abs(c1)) AS peak_c1', 'max(abs(c2)) AS peak_c2')} FROM wave GROUP BY record_id")
def component_peak_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.component_peaks(wave(spark, sf_dir)))


@query(f"WITH {WAVE} SELECT record_id, {r6(f'max({RESULTANT} * 980.665) AS pga_gal')} FROM wave GROUP BY record_id")
def peak_ground_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.peak_ground_acceleration(wave(spark, sf_dir), unit="g"))


def integral_sql(source: str, name: str, rate: float = 100.0) -> str:
    steps = ", ".join(f"coalesce(0.5 / {rate} * ({c} + lag({c}) OVER r), 0) AS {c}" for c in ALL)
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY record_id ORDER BY i) AS {c}" for c in ALL)
    return f"{name} AS (SELECT record_id, i, {sums} FROM (SELECT record_id, i, {steps} FROM {source} WINDOW r AS (PARTITION BY record_id ORDER BY i)))"


@query(f"WITH {WAVE}, {integral_sql('wave', 'v')} SELECT record_id, i, {r6(*ALL)} FROM v")
def integrate_to_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.integrate(wave(spark, sf_dir)))


@query(f"WITH {WAVE}, {integral_sql('wave', 'v')}, {integral_sql('v', 'd')} SELECT record_id, i, {r6(*ALL, digits=9)} FROM d")
def integrate_to_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.integrate_twice(wave(spark, sf_dir)), 9)


PEAKS3 = ("max(abs(c0)) AS peak_c0", "max(abs(c1)) AS peak_c1", "max(abs(c2)) AS peak_c2")


@query(f"WITH {WAVE}, {integral_sql('wave', 'v')} SELECT record_id, {r6(*PEAKS3, f'max({RESULTANT}) AS pgv_cm_s')} FROM v GROUP BY record_id")
def peak_ground_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.peak_ground_velocity(wave(spark, sf_dir)))


@query(f"WITH {WAVE}, {integral_sql('wave', 'v')}, {integral_sql('v', 'd')} SELECT record_id, {r6(*PEAKS3, f'max({RESULTANT}) AS pgd_cm', digits=9)} FROM d GROUP BY record_id")
def peak_ground_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.peak_ground_displacement(wave(spark, sf_dir)), 9)


@query(f"WITH {WAVE} SELECT record_id, i, {r6(*[f'{c} - avg(CASE WHEN i < 10 THEN {c} END) OVER (PARTITION BY record_id) AS {c}' for c in ALL])} FROM wave")
def remove_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.remove_offset(wave(spark, sf_dir), 10))


@query(
    f"WITH {WAVE}, line AS (SELECT record_id, {', '.join(f'regr_slope({c}, i) AS s{c}, regr_intercept({c}, i) AS t{c}' for c in ALL)} FROM wave GROUP BY record_id) "
    f"SELECT record_id, i, {r6(*[f'{c} - t{c} - s{c} * i AS {c}' for c in ALL])} FROM wave JOIN line USING (record_id)"
)
def detrend_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.detrend(wave(spark, sf_dir)))


@query(
    f"WITH {WAVE}, n AS (SELECT record_id, count(*) - 1 AS m FROM wave GROUP BY record_id), g AS (SELECT wave.*, CASE WHEN least(i, m - i) < 0.05 * m THEN "
    f"(1 + cos(pi() * (least(i, m - i) / (0.05 * m) - 1))) / 2 ELSE 1 END AS k FROM wave JOIN n USING (record_id)) SELECT record_id, i, {r6('k * c0 AS c0', 'k * c1 AS c1', 'k * c2 AS c2')} FROM g"
)
def cosine_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.cosine_taper(wave(spark, sf_dir)))


@query(f"WITH {WAVE} SELECT record_id, count(*) AS sample_count, 3 AS component_count, 0::BIGINT AS gap_count, 0::BIGINT AS repeat_count, 0::BIGINT AS nonfinite_count, true AS standard_rate, false AS missing_components FROM wave GROUP BY record_id")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.quality_flags(motion.check_waveform(wave(spark, sf_dir)), 100.0)


@query("""
WITH s AS (SELECT user_id AS record_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM events),
m AS (SELECT record_id, quantile_cont(d, 0.5) AS med, avg(d) AS mean FROM s WHERE d IS NOT NULL GROUP BY record_id),
j AS (SELECT record_id, any_value(med) AS med, any_value(mean) AS mean, max(abs(d - med)) AS jit FROM s JOIN m USING (record_id) WHERE d IS NOT NULL GROUP BY record_id)
SELECT record_id, round(1 / med, 6) + 0.0 AS sampling_rate_hz, round(med, 3) + 0.0 AS median_interval_s, round(mean, 3) + 0.0 AS mean_interval_s, round(jit, 3) + 0.0 AS max_absolute_jitter_s,
       round(jit / med, 4) + 0.0 AS relative_peak_jitter, jit / med <= 1e-3 AS is_uniform FROM j""")
def sampling_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    out = motion.sampling_diagnostics(e)
    digits = {"sampling_rate_hz": 6, "median_interval_s": 3, "mean_interval_s": 3, "max_absolute_jitter_s": 3, "relative_peak_jitter": 4}
    return out.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


# -- durations and clipping ------------------------------------------------------------

AMPLITUDE = f"{WAVE}, amp AS (SELECT record_id, i, {RESULTANT} AS amplitude FROM wave)"


def amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wave(spark, sf_dir).select("record_id", "i", motion.resultant().alias("amplitude"))


@query(f"WITH {AMPLITUDE} SELECT record_id, {r6("list_sort(list(amplitude), 'DESC')[30] AS threshold")} FROM amp GROUP BY record_id")
def duration_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.duration_threshold_at(amplitude(spark, sf_dir), 100.0))


@query(f"WITH {AMPLITUDE} SELECT record_id, {r6('count(*) FILTER (amplitude >= 50) / 100.0 AS duration_s')} FROM amp GROUP BY record_id")
def exceedance_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.exceedance_duration(amplitude(spark, sf_dir), 50.0, 100.0))


@query(f"WITH {AMPLITUDE}, r AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY amplitude DESC)::INTEGER AS rank, amplitude FROM amp) SELECT record_id, rank, {r6('amplitude', 'rank / 100.0 AS exceedance_duration_s')} FROM r")
def amplitude_duration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.amplitude_duration_curve(amplitude(spark, sf_dir), 100.0))


@query(f"WITH {AMPLITUDE} SELECT record_id, i, {r6('amplitude', '''list_sort(list(amplitude) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), 'DESC')[10] AS kth''')} FROM amp")
def rolling_kth_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.rolling_kth_largest(amplitude(spark, sf_dir), 40, 10, "amplitude"))


@query(f"WITH {AMPLITUDE} SELECT record_id, i, {r6('amplitude', '''list_sort(list(amplitude) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 69 PRECEDING AND CURRENT ROW), 'DESC')[30] AS kth''')} FROM amp")
def rolling_kth_largest_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.rolling_kth_largest(amplitude(spark, sf_dir), 70, 30, "amplitude"))


GAPPED = f"{AMPLITUDE}, gap AS (SELECT record_id, i, CASE WHEN i % 7 <> 3 THEN amplitude END AS amplitude FROM amp)"


def _gapped(name: str, window: int, k: int) -> None:
    """Every seventh value is missing; the window is on either side of where the kernel takes over."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        gaps = amplitude(spark, sf_dir).withColumn("amplitude", F.when(F.col("i") % 7 != 3, F.col("amplitude")))
        return rounded(intensity.rolling_kth_largest(gaps, window, k, "amplitude"))

    kth = f"list_sort(list(amplitude) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 'DESC', 'NULLS LAST')[{k}] AS kth"
    QUERIES[name] = f
    ORACLES[name] = f"WITH {GAPPED} SELECT record_id, i, {r6('amplitude', kth)} FROM gap"


_gapped("rolling_kth_gaps", 50, 12)
_gapped("rolling_kth_gaps_long", 66, 12)


@query("""
WITH w AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value / 20) AS x FROM events),
r AS (SELECT *, sum(ch) OVER (PARTITION BY record_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY record_id ORDER BY i) THEN 0 ELSE 1 END AS ch FROM w)),
l AS (SELECT *, count(*) OVER (PARTITION BY record_id, run) AS n, max(abs(x)) OVER (PARTITION BY record_id) AS peak FROM r),
f AS (SELECT record_id, i, x, 'known_range' AS method FROM l WHERE abs(x) >= 5 * (1 - 0.001) UNION ALL
      SELECT record_id, i, x, 'repeated_extreme' FROM l WHERE peak > 0 AND abs(x) >= peak * 0.5 AND n >= 2),
g AS (SELECT *, i - row_number() OVER (PARTITION BY record_id, method ORDER BY i) AS island FROM f)
SELECT record_id, 0 AS component, min(i) AS start_sample, max(i) + 1 AS end_sample, arg_max(x, abs(x) * 1e6 - i)::DOUBLE AS value, method FROM g GROUP BY record_id, method, island""")
def detect_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    w = e.select(F.col("user_id").alias("record_id"), i.cast("long").alias("i"), F.floor(F.col("value") / 20).cast("double").alias("c0"))
    return motion.detect_clipping(w, max_range_gal=5.0, repeat_threshold=2, extreme_fraction=0.5)


@query("""
WITH w AS (SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value / 20) AS x FROM events),
f AS (SELECT record_id, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS island FROM w WHERE abs(x) >= 5 * (1 - 0.001))
SELECT record_id, count(DISTINCT island) AS interval_count, [0] AS components_affected FROM f GROUP BY record_id""")
def clipping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    w = e.select(F.col("user_id").alias("record_id"), i.cast("long").alias("i"), F.floor(F.col("value") / 20).cast("double").alias("c0"))
    return motion.clipping_report(motion.detect_clipping(w, max_range_gal=5.0, repeat_threshold=1_000_000))


# -- scalar functions ------------------------------------------------------------------


@query(f"""
WITH v AS (SELECT o_orderkey, o_totalprice / 1000 AS a, (o_orderkey % 9000) / 1000.0 - 1 AS x FROM orders), i AS (SELECT *, {raw_sql('a')} AS raw FROM v)
SELECT o_orderkey, {r6('raw AS intensity_raw')}, {reported_sql('raw')} AS intensity, {class_sql(reported_sql('raw'))} AS intensity_class, {reported_sql('x')} AS reported_x,
       {class_sql('x')} AS class_x, {r6('pow(10, (raw - 0.94) / 2) AS back')} FROM i""")
def intensity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("a"), ((F.col("o_orderkey") % 9000) / 1000.0 - 1).alias("x"))
    raw = scale.intensity_from_threshold(F.col("a"))
    o = o.withColumn("raw", raw).withColumn("intensity", scale.report_intensity(F.col("raw")))
    return o.select(
        "o_orderkey", (F.round("raw", 6) + 0.0).alias("intensity_raw"), "intensity", scale.classify_intensity(F.col("intensity")).alias("intensity_class"),
        scale.report_intensity(F.col("x")).alias("reported_x"), scale.classify_intensity(F.col("x")).alias("class_x"), (F.round(scale.threshold_from_intensity(F.col("raw")), 6) + 0.0).alias("back"),
    )


@query(f"""SELECT o_orderkey, {class_sql('o_totalprice / 1000', scale.LONG_LOWER, scale.LONG_CLASSES)} AS long_period_class,
 'Long-period class ' || {class_sql('o_totalprice / 1000', scale.LONG_LOWER, scale.LONG_CLASSES)} AS label, CAST(floor((o_orderkey % 63 + 16) / 10) AS INTEGER) AS band,
 round(o_totalprice * 9.80665 / 0.01, 6) AS gal_from_g, round(o_totalprice * 0.01, 6) AS mps2, CAST(ceil(o_totalprice / 1000 * 100 - 1e-12) AS BIGINT) AS samples FROM orders""")
def long_period_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, v = table(spark, sf_dir, "orders"), F.col("o_totalprice") / 1000
    name = scale.classify_long_period(v)
    return o.select(
        "o_orderkey", name.alias("long_period_class"), scale.long_period_label(name, "en").alias("label"), scale.band_of(F.col("o_orderkey") % 63 + 16).alias("band"),
        F.round(units.to_gal(F.col("o_totalprice"), "g"), 6).alias("gal_from_g"), F.round(units.convert(F.col("o_totalprice"), "gal", "m/s^2"), 6).alias("mps2"), sample_count_column(v, F.lit(100.0)).alias("samples"),
    )


@query("""
SELECT s_suppkey, round(f, 6) AS frequency_hz, round(1 / sqrt(f), 6) AS period_effect,
 round(1 / sqrt(1 + 0.694 * pow(f / 10, 2) + 0.241 * pow(f / 10, 4) + 0.0557 * pow(f / 10, 6) + 0.009664 * pow(f / 10, 8) + 0.00134 * pow(f / 10, 10) + 0.000155 * pow(f / 10, 12)), 6) AS high_cut,
 round(sqrt(1 - exp(-pow(f / 0.5, 3))), 6) AS low_cut FROM (SELECT s_suppkey, 0.05 + abs(s_acctbal) / 200 AS f FROM supplier)""")
def measured_filter_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (0.05 + F.abs("s_acctbal") / 200).alias("frequency_hz"))
    parts = response.measured_filter_components(F.col("frequency_hz"))
    return s.select("s_suppkey", *[F.round(c, 6).alias(n) for c, n in zip((F.col("frequency_hz"), *parts[:3]), ("frequency_hz", "period_effect", "high_cut", "low_cut"), strict=True)])


def response_sql(made: design.Design) -> str:
    parts = [
        f"(pow({b[0]!r} + ({b[1]!r}) * cos(w) + ({b[2]!r}) * cos(2 * w), 2) + pow(({b[1]!r}) * sin(w) + ({b[2]!r}) * sin(2 * w), 2))"
        f" / (pow(1 + ({a[1]!r}) * cos(w) + ({a[2]!r}) * cos(2 * w), 2) + pow(({a[1]!r}) * sin(w) + ({a[2]!r}) * sin(2 * w), 2))"
        for b, a in sos(made)
    ]
    return f"SELECT s_suppkey, round(sqrt({' * '.join(parts)}), 6) AS amplitude FROM (SELECT s_suppkey, 2 * pi() * (0.05 + abs(s_acctbal) / 300) / {made.rate!r} AS w FROM supplier)"


@query(response_sql(design.design_realtime_filter(100.0, "2012")))
def realtime_filter_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = design.design_realtime_filter(100.0, "2012")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (0.05 + F.abs("s_acctbal") / 300).alias("f"))
    re, im = response.cascade_response(F.col("f"), made.rate, list(made.sections))
    return s.select("s_suppkey", F.round(F.hypot(re, im), 6).alias("amplitude"))


# -- recursive filters -----------------------------------------------------------------


def _filtered(name: str, sections, run: Callable[[DataFrame], DataFrame], gain: float = 1.0, names: tuple[str, ...] = ALL) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(run(wave(spark, sf_dir, names)))

    QUERIES[name] = f
    ORACLES[name] = f"WITH RECURSIVE {WAVE}, {cascade_sql(sections, names=names, gain=gain)} SELECT record_id, i, {r6(*names)} FROM flt"


DESIGN_2012, DESIGN_2008, DESIGN_LOW = design.design_realtime_filter(100.0, "2012"), design.design_realtime_filter(100.0, "2008"), design.design_realtime_filter(50.0, "lowrate")
_filtered("realtime_filter_2012", sos(DESIGN_2012), lambda w: intensity.realtime_filter(w, DESIGN_2012))
_filtered("realtime_filter_2008", sos(DESIGN_2008), lambda w: intensity.realtime_filter(w, DESIGN_2008))
_filtered("realtime_filter_lowrate", sos(DESIGN_LOW), lambda w: intensity.realtime_filter(w, DESIGN_LOW))
_filtered("high_pass_20s", [HIGH_PASS], lambda w: intensity.high_pass(w), 0.997721867867)
_filtered("strong_motion_velocity", [VELOCITY], lambda w: intensity.strong_motion_velocity(w))
_filtered("strong_motion_displacement", [DISPLACEMENT], lambda w: intensity.strong_motion_displacement(w))

REALTIME = f"""{WAVE}, {cascade_sql(sos(DESIGN_2012))},
amp AS (SELECT record_id, i, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS resultant_gal FROM flt),
th AS (SELECT *, list_sort(list(resultant_gal) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 5999 PRECEDING AND CURRENT ROW), 'DESC')[30] AS threshold_gal FROM amp),
ser AS (SELECT *, {raw_sql('threshold_gal')} AS intensity_raw FROM th),
rt AS (SELECT *, {reported_sql('intensity_raw')} AS intensity, max(intensity_raw) OVER (PARTITION BY record_id ORDER BY i) AS record_max_intensity_raw FROM ser)"""
SERIES_SQL = f"WITH RECURSIVE {REALTIME} SELECT record_id, i, {r6('resultant_gal', 'threshold_gal', 'i / 100.0 AS time_s', 'intensity_raw', 'intensity', 'record_max_intensity_raw')} FROM rt"


@query(SERIES_SQL)
def realtime_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.realtime_intensity(wave(spark, sf_dir)))


@query(
    f"WITH RECURSIVE {REALTIME} SELECT record_id, count(*) AS sample_count, min(i) FILTER (intensity_raw IS NOT NULL) AS first_valid_sample_index, arg_min(i, -intensity_raw * 1e6 + i * 1e-3) FILTER (intensity_raw IS NOT NULL) AS peak_sample_index, "
    f"{r6('max(intensity_raw) AS approximate_intensity_raw', 'max(threshold_gal) AS peak_threshold_gal', 'max(resultant_gal) AS filtered_pga_gal', 'max(intensity) AS approximate_intensity')}, {class_sql('max(intensity)')} AS approximate_class FROM rt GROUP BY record_id"
)
def realtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.realtime_summary(intensity.realtime_intensity(wave(spark, sf_dir))))


METHODS_SQL = f"""
WITH RECURSIVE {MEASURED.replace(WAVE, WAVE)}, {REALTIME[len(WAVE) + 2:].replace('amp AS', 'ramp AS').replace('FROM amp', 'FROM ramp')},
m AS (SELECT *, {class_sql('intensity')} AS intensity_class FROM measured),
s AS (SELECT record_id, max(intensity_raw) AS araw, max(intensity) AS aint FROM rt GROUP BY record_id)
SELECT record_id, {r6('intensity_raw', 'intensity')}, intensity_class, {r6('araw AS approximate_intensity_raw', 'aint AS approximate_intensity')}, {class_sql('aint')} AS approximate_class,
       {r6('araw - intensity_raw AS raw_difference', 'aint - intensity AS reported_difference', 'abs(araw - intensity_raw) AS absolute_raw_difference')}, {class_sql('aint')} = intensity_class AS scale_agreement
FROM m JOIN s USING (record_id)"""


@query(METHODS_SQL)
def compare_intensity_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.compare_intensity_methods(wave(spark, sf_dir)))


# -- oscillators -----------------------------------------------------------------------

SPECTRUM = f"{WAVE}, {flat_sql('wave', ALL)}, {bank_sql(PERIODS, 0.05, 100.0)}, {oscillator_sql(100.0, 'flat')}"


@query(
    f"WITH RECURSIVE {SPECTRUM}, p AS (SELECT record_id, period_s, component, max(abs(d)) AS sd_cm, max(abs(v)) AS sv_cm_s FROM osc GROUP BY ALL) SELECT record_id, period_s, component, "
    f"{r6('sd_cm', 'sv_cm_s', '2 * pi() / period_s * sd_cm AS psv_cm_s', 'pow(2 * pi() / period_s, 2) * sd_cm AS psa_gal')} FROM p"
)
def response_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.response_spectrum(wave(spark, sf_dir), PERIODS, 0.05))


@query(f"WITH RECURSIVE {WAVE}, {flat_sql('wave', ('c0',))}, {bank_sql((0.5, 1.0), 0.05, 100.0)}, {oscillator_sql(100.0, 'flat')} SELECT record_id, i, period_s, component, {r6('d AS d_cm', 'v AS v_cm_s')} FROM osc")
def oscillator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.oscillator_responses(wave(spark, sf_dir, ("c0",)), (0.5, 1.0), 0.05, series=True))


SI_PERIODS = design.spectrum_periods()


@query(
    f"WITH RECURSIVE {WAVE}, {flat_sql('wave', TWO)}, {bank_sql(SI_PERIODS, 0.2, 100.0)}, {oscillator_sql(100.0, 'flat')}, p AS (SELECT record_id, period_s, component, max(abs(v)) AS sv FROM osc GROUP BY ALL), "
    f"a AS (SELECT record_id, component, (sv + lag(sv) OVER k) * (period_s - lag(period_s) OVER k) / 2 AS area FROM p WINDOW k AS (PARTITION BY record_id, component ORDER BY period_s)) SELECT record_id, component, {r6('sum(area) / 2.4 AS si_cm_s')} FROM a GROUP BY ALL"
)
def spectrum_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.spectrum_intensity(wave(spark, sf_dir, TWO)))


LONG = f"""{WAVE}, {cascade_sql([HIGH_PASS], names=TWO, gain=0.997721867867)}, {flat_sql('flt', TWO)},
{bank_sql(design.LONG_PERIODS_S, 0.05, 100.0)}, {oscillator_sql(100.0, 'flat')},
gs AS (SELECT record_id, i, component, coalesce(0.005 * (x + lag(x) OVER (PARTITION BY record_id, component ORDER BY i)), 0) AS s FROM flat),
gv AS (SELECT record_id, i, component, sum(s) OVER (PARTITION BY record_id, component ORDER BY i) AS g FROM gs),
ab AS (SELECT o.record_id, o.period_s, o.i, sqrt(sum(pow(o.v + gv.g, 2))) AS a FROM osc o JOIN gv USING (record_id, i, component) GROUP BY ALL),
sva AS (SELECT record_id, period_s, max(a) AS sva, count(*) AS n FROM ab GROUP BY record_id, period_s)"""


@query(f"WITH RECURSIVE {LONG} SELECT record_id, period_s, {r6('sva AS sva_cm_s')}, n AS sample_count FROM sva")
def absolute_velocity_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.absolute_velocity_spectrum(wave(spark, sf_dir, TWO)))


@query(
    f"WITH RECURSIVE {LONG}, top AS (SELECT *, max(round(sva, 6)) OVER (PARTITION BY record_id) AS most FROM sva) "
    f"SELECT record_id, {r6('max(sva) AS max_sva_cm_s')}, round(min(period_s) FILTER (round(sva, 6) = most), 6) + 0.0 AS critical_period_s, any_value(n) AS sample_count, "
    f"{class_sql('max(sva)', scale.LONG_LOWER, scale.LONG_CLASSES)} AS long_period_class, true AS reference_conditions_met FROM top GROUP BY record_id"
)
def long_period_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.long_period_class(spectra.absolute_velocity_spectrum(wave(spark, sf_dir, TWO))))


@query(f"WITH RECURSIVE {LONG} SELECT record_id, CAST(floor(round(period_s * 10) / 10) AS INTEGER) AS band, {r6('max(sva) AS max_sva_cm_s')}, {class_sql('max(sva)', scale.LONG_LOWER, scale.LONG_CLASSES)} AS long_period_class FROM sva GROUP BY 1, 2")
def long_period_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.long_period_bands(spectra.absolute_velocity_spectrum(wave(spark, sf_dir, TWO))))


# -- streaming -------------------------------------------------------------------------


def streamed(spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame], DataFrame], mode: str, files: int = 4) -> DataFrame:
    """Rows written as files and read back as a stream, some files a batch; what the query sank, with the batch number."""
    base = f"{shared_dir(spark).rstrip('/')}/quakeframe-stream-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, "i").write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch_id={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, estimators.ROCKS)
    try:
        writer = run(source).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True)
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.parquet(f"{base}/out").drop("batch_id")


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    values = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "sample_count").alias("v")).select(*keys, "v.*")


@query(SERIES_SQL)
def realtime_intensity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streamed(spark, wave(spark, sf_dir), estimators.realtime_intensity_stream, "append")
    return rounded(out.drop("batch"))


#: Every sample whose number is 20, 40, ... is a reset; the window of 12 samples fills and drops some between them.
RESET_WAVE = WAVE.replace("SELECT user_id AS record_id, row_number()", "SELECT user_id::VARCHAR || ':' || ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20)::VARCHAR AS record_id, (row_number()").replace(" - 1 AS i,", " - 1) % 20 AS i,")
RESET_SQL = f"""WITH RECURSIVE {RESET_WAVE}, {cascade_sql(sos(DESIGN_2012))},
amp AS (SELECT record_id, i, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS resultant_gal FROM flt),
th AS (SELECT *, list_sort(list(resultant_gal) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 'DESC')[10] AS threshold_gal FROM amp),
ser AS (SELECT *, {raw_sql('threshold_gal')} AS intensity_raw FROM th)
SELECT split_part(record_id, ':', 1)::BIGINT AS record_id, split_part(record_id, ':', 2)::BIGINT * 20 + i AS i, {r6('resultant_gal', 'threshold_gal', 'intensity_raw')},
       round(max(intensity_raw) OVER (PARTITION BY record_id ORDER BY i), 6) + 0.0 AS record_max_intensity_raw FROM ser"""


@query(RESET_SQL)
def realtime_intensity_stream_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimator over a window of 12 samples, with a reset at every twentieth sample."""
    rows = wave(spark, sf_dir).withColumn("reset", (F.col("i") > 0) & (F.col("i") % 20 == 0))
    out = streamed(spark, rows, lambda s: estimators.realtime_intensity_stream(s, window_s=0.12, duration_s=0.1), "append")
    return rounded(out.select("record_id", "i", "resultant_gal", "threshold_gal", "intensity_raw", "record_max_intensity_raw"))


@query(f"WITH RECURSIVE {LONG} SELECT record_id, period_s, {r6('sva AS sva_cm_s')}, n AS sample_count FROM sva")
def long_period_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(latest(streamed(spark, wave(spark, sf_dir, TWO), estimators.long_period_stream, "update"), "record_id", "period_s"))


@query(ORACLES["spectrum_intensity"])
def spectrum_intensity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = latest(streamed(spark, wave(spark, sf_dir, TWO), estimators.spectrum_intensity_stream, "update"), "record_id", "component")
    return rounded(out.select("record_id", "component", "si_cm_s"))


# -- spatial ---------------------------------------------------------------------------

STATION = "station AS (SELECT s_suppkey AS station_id, 33 + (s_suppkey * 0.6180339887) % 4 AS lat, 133 + (s_suppkey * 0.4142135623) % 5 AS lon, 1 + abs(s_acctbal) AS value FROM supplier)"
CELLS = "cell AS (SELECT c_custkey AS row, 0 AS col, 33 + (c_custkey * 0.7320508075) % 4 AS lat, 133 + (c_custkey * 0.2360679774) % 5 AS lon FROM customer)"
KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(cos(radians(c.lat)) * cos(radians(c.lon)) - cos(radians(s.lat)) * cos(radians(s.lon)), 2) + pow(cos(radians(c.lat)) * sin(radians(c.lon)) - cos(radians(s.lat)) * sin(radians(s.lon)), 2) + pow(sin(radians(c.lat)) - sin(radians(s.lat)), 2)) / 2))"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("station_id"), (33 + (k * 0.6180339887) % 4).alias("lat"), (133 + (k * 0.4142135623) % 5).alias("lon"), (1 + F.abs("s_acctbal")).alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("row"), F.lit(0).alias("col"), (33 + (k * 0.7320508075) % 4).alias("lat"), (133 + (k * 0.2360679774) % 5).alias("lon"))


IDW = f"""WITH {STATION}, {CELLS}, p AS (SELECT c.row, c.col, s.station_id, s.value, {KM} AS km FROM cell c, station s),
k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY km, station_id) AS rk FROM p WHERE km <= 60), n AS (SELECT * FROM k WHERE rk <= 4),
a AS (SELECT row, col, min(km) AS nearest_km, count(*)::INTEGER AS neighbor_count, sum({{v}} * pow(greatest(km, 1e-300), -2)) / sum(pow(greatest(km, 1e-300), -2)) AS est, arg_min({{v}}, km) AS own FROM n GROUP BY row, col)
SELECT c.row, c.col, round({{u}}(CASE WHEN nearest_km <= 0.001 THEN own WHEN neighbor_count >= 2 THEN est END), 4) AS value, coalesce(nearest_km <= 0.001 OR neighbor_count >= 2, false) AS supported,
       round(coalesce(nearest_km, 'Infinity'::DOUBLE), 4) AS nearest_km, coalesce(neighbor_count, 0)::INTEGER AS neighbor_count FROM cell c LEFT JOIN a ON a.row = c.row AND a.col = c.col"""
CONFIG = spatial.IDWConfig(neighbors=4, power=2.0, max_distance_km=60.0, minimum_neighbors=2)


def surface(spark: SparkSession, sf_dir: str, plan: DataFrame, transform: str = "identity") -> DataFrame:
    return rounded(spatial.apply_plan(plan, stations(spark, sf_dir), transform), 4)


@query(IDW.format(v="value", u=""))
def idw_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir, spatial.idw_plan(cells(spark, sf_dir), spatial.check_stations(stations(spark, sf_dir)), CONFIG))


@query(IDW.format(v="ln(value)", u="exp"))
def idw_surface_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir, spatial.idw_plan(cells(spark, sf_dir), stations(spark, sf_dir), CONFIG), "log")


@query(
    f"WITH {STATION}, {CELLS}, p AS (SELECT c.row, c.col, s.station_id, s.value, {KM} AS km FROM cell c, station s), b AS (SELECT row, col, min(km) AS km, arg_min(value, km) AS value FROM p GROUP BY row, col) "
    "SELECT row, col, CASE WHEN km <= 40 THEN round(value, 4) END AS value, km <= 40 AS supported, round(km, 4) AS nearest_km, CASE WHEN km <= 40 THEN 1 ELSE 0 END AS neighbor_count FROM b"
)
def nearest_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir, spatial.nearest_plan(cells(spark, sf_dir), stations(spark, sf_dir), spatial.NearestConfig(max_distance_km=40.0)))


def aeqd_sql(source: str, lon0: float, lat0: float, keys: str) -> str:
    phi0 = f"radians({lat0})"
    return (
        f"(SELECT {keys}, e * k * 6371.0088 AS x, n * k * 6371.0088 AS y FROM (SELECT *, CASE WHEN sqrt(e * e + n * n) < 1e-12 THEN 1 ELSE atan2(sqrt(e * e + n * n), u) / sqrt(e * e + n * n) END AS k FROM ("
        f"SELECT *, cos(radians(lat)) * sin(radians(lon - {lon0})) AS e, cos({phi0}) * sin(radians(lat)) - sin({phi0}) * cos(radians(lat)) * cos(radians(lon - {lon0})) AS n, "
        f"sin({phi0}) * sin(radians(lat)) + cos({phi0}) * cos(radians(lat)) * cos(radians(lon - {lon0})) AS u FROM {source})))"
    )


LINEAR_GRID = spatial.Grid(133.0, 33.0, 138.0, 37.0, (1, 1))
CIRC = "(a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y))"


@query(f"""
WITH {STATION}, {CELLS}, p AS (SELECT * FROM {aeqd_sql('station', 135.5, 35.0, 'station_id, value')}), g AS (SELECT * FROM {aeqd_sql('cell', 135.5, 35.0, 'row, col, lat, lon')}),
t AS (SELECT a.station_id AS s0, b.station_id AS s1, c.station_id AS s2, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, a.value AS v0, b.value AS v1, c.value AS v2,
  ((a.x * a.x + a.y * a.y) * (b.y - c.y) + (b.x * b.x + b.y * b.y) * (c.y - a.y) + (c.x * c.x + c.y * c.y) * (a.y - b.y)) / (2 * {CIRC}) AS ux,
  ((a.x * a.x + a.y * a.y) * (c.x - b.x) + (b.x * b.x + b.y * b.y) * (a.x - c.x) + (c.x * c.x + c.y * c.y) * (b.x - a.x)) / (2 * {CIRC}) AS uy
  FROM p a JOIN p b ON a.station_id < b.station_id JOIN p c ON b.station_id < c.station_id),
d AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.station_id NOT IN (s0, s1, s2) AND pow(q.x - ux, 2) + pow(q.y - uy, 2) < pow(x0 - ux, 2) + pow(y0 - uy, 2) - 1e-7)),
w AS (SELECT g.row, g.col, v0, v1, v2, s0, s1, s2, ((y1 - y2) * (g.x - x2) + (x2 - x1) * (g.y - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS w0,
  ((y2 - y0) * (g.x - x2) + (x0 - x2) * (g.y - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS w1 FROM g, d),
f AS (SELECT row, col, any_value(w0 * v0 + w1 * v1 + (1 - w0 - w1) * v2) AS value FROM w WHERE least(w0, w1, 1 - w0 - w1) >= -1e-12 GROUP BY row, col),
n AS (SELECT c.row, c.col, min({KM}) AS km FROM cell c, station s GROUP BY c.row, c.col)
SELECT n.row, n.col, round(value, 4) AS value, value IS NOT NULL AS supported, round(km, 4) AS nearest_km, CASE WHEN value IS NULL THEN 0 ELSE 3 END AS neighbor_count FROM n LEFT JOIN f ON f.row = n.row AND f.col = n.col""")
def linear_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stations(spark, sf_dir)
    return rounded(spatial.apply_plan(spatial.linear_plan(cells(spark, sf_dir), spatial.check_stations(s, 3), LINEAR_GRID), s), 4)


GRID = spatial.Grid(133.0, 33.0, 138.0, 37.0, (40, 50))
GRID_SQL = "grid AS (SELECT r.row::INTEGER AS row, q.col::INTEGER AS col, 33 + (r.row + 0.5) * 0.1 AS lat, 133 + (q.col + 0.5) * 0.1 AS lon FROM range(0, 40) r(row), range(0, 50) q(col))"
GRID_NEAREST = f"{STATION}, {GRID_SQL}, p AS (SELECT c.row, c.col, s.value, {KM} AS km FROM grid c, station s), b AS (SELECT row, col, arg_min(value, km) AS value FROM p GROUP BY row, col)"


@query(f"WITH {GRID_NEAREST}, place AS (SELECT c_custkey, least(greatest(ceil((33 + (c_custkey * 0.7320508075) % 4 - 33) / 0.1) - 1, 0), 39)::INTEGER AS row, least(greatest(ceil((133 + (c_custkey * 0.2360679774) % 5 - 133) / 0.1) - 1, 0), 49)::INTEGER AS col FROM customer) SELECT c_custkey, row, col, round(value, 4) AS value FROM place JOIN b USING (row, col)")
def sample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spatial.interpolate_surface(spark, stations(spark, sf_dir), GRID, "nearest", spatial.NearestConfig(allow_extrapolation=True))
    points = cells(spark, sf_dir).select(F.col("row").alias("c_custkey"), "lat", "lon")
    return rounded(spatial.sample_nearest(made, GRID, points).select("c_custkey", "row", "col", "value"), 4)


@query(
    f"WITH {GRID_NEAREST}, i AS (SELECT row, col, rint(least(greatest((ln(greatest(value, 10)) - ln(10)) / (ln(10000) - ln(10)), 0), 1) * 255)::INTEGER AS k FROM b) "
    "SELECT row, col, k AS r, 255 - k AS g, 0 AS b, 153 AS a FROM i".replace("rint(", "round_even(").replace("* 255)", "* 255, 0)")
)
def surface_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spatial.interpolate_surface(spark, stations(spark, sf_dir), GRID, "nearest", spatial.NearestConfig(allow_extrapolation=True))
    return render.surface_colors(made, render.palette(spark, [(0.0, "#00ff00"), (1.0, "#ff0000")]), 10.0, 10000.0, "log")


@query(f"""WITH {STATION}, c AS (SELECT c_custkey, c_nationkey, 33 + (c_custkey * 0.7320508075) % 4 AS lat, 133 + (c_custkey * 0.2360679774) % 5 AS lon FROM customer)
SELECT c.c_custkey, round({KM}, 4) AS km FROM c JOIN station s ON s.station_id = c.c_custkey % 10 + 1""")
def great_circle_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).select(F.col("row").alias("c_custkey"), "lat", "lon")
    s = stations(spark, sf_dir).select("station_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    joined = c.join(s, F.col("station_id") == F.col("c_custkey") % 10 + 1)
    return joined.select("c_custkey", F.round(geo.great_circle_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")), 4).alias("km"))


# -- comparison, thinning, traces ------------------------------------------------------


@query(f"""WITH {WAVE}, {integral_sql('wave', 'v')}, d AS (SELECT wave.c0 AS a, v.c0 AS b FROM wave JOIN v USING (record_id, i))
SELECT 'c0' AS field, 'values differ' AS reason, round(max(abs(a - b)), 6) AS max_abs_err, round(max(CASE WHEN abs(b) > 0 THEN abs(a - b) / abs(b) END), 3) AS max_rel_err FROM d WHERE abs(a - b) > 1e-12 + 1e-9 * abs(b)""")
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wave(spark, sf_dir, ("c0",))
    out = compare.compare_results(w, motion.integrate(w), ["record_id", "i"])
    return out.withColumns({"max_abs_err": F.round("max_abs_err", 6), "max_rel_err": F.round("max_rel_err", 3)})


@query(f"""WITH {AMPLITUDE}, n AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS m FROM amp), k AS (SELECT DISTINCT record_id, m, round_even(j * (m - 1) / 19.0, 0)::BIGINT AS i FROM (SELECT DISTINCT record_id, m FROM n), range(0, 20) g(j))
SELECT record_id, i, round(amplitude, 6) + 0.0 AS amplitude FROM n JOIN k USING (record_id, i)""")
def thin_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.thin(amplitude(spark, sf_dir), 20))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, 10 * abs(s_acctbal) / 1000 AS value FROM supplier)
SELECT s_nationkey, count(*) AS stations, count(*) FILTER (abs(value - 20) <= 10) AS within, round(quantile_cont(abs(value - 20) / 20, 0.5), 6) AS median_relative_error, round(max(abs(value - 20)), 6) AS max_error FROM s GROUP BY s_nationkey""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .event import error_report

    s = table(spark, sf_dir, "supplier").select("s_nationkey", (10 * F.abs("s_acctbal") / 1000).alias("value"), F.lit(20.0).alias("published"))
    return rounded(error_report(s, "value", "published", tolerance=0.5, by=["s_nationkey"]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_intensity(spark, sf_dir)
