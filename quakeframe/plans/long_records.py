"""Queries over long records in blocks: all events of a type are one record.

Samples are numbered in two levels, within a day and by the days before, so that no task
orders a whole record.  Blocks are of 64 samples, so that even small tables have many; the
real-time window of 0.4 s fills and drops samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intensity, motion, spectra
from .queries import ALL, DESIGN_2012, HIGH_PASS, MEASURED, PERIODS, TWO, WAVE, bank_sql, cascade_sql, class_sql, flat_sql, integral_sql, oscillator_sql, query, r6, raw_sql, reported_sql, rounded, sos, table

BLOCK = 64
LONG_WAVE = WAVE.replace("SELECT user_id AS record_id", "SELECT event_type AS record_id").replace("PARTITION BY user_id", "PARTITION BY event_type")


def long_wave(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ALL) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("record_id"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    days = e.groupBy("record_id", "day").count()
    before = Window.partitionBy("record_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    passed = days.select("record_id", "day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("passed"))
    placed = e.withColumn("k", F.row_number().over(Window.partitionBy("record_id", "day").orderBy("ts", "event_id")) - 1)
    same = placed["record_id"].eqNullSafe(passed["record_id"]) & placed["day"].eqNullSafe(passed["day"])
    value, number = F.col("value"), F.col("event_id").cast("double")
    made = {"c0": value * F.sin(number), "c1": value * F.cos(number), "c2": value - 30.0}
    rows = placed.join(passed, same).select(placed["record_id"], (F.col("k") + F.col("passed")).cast("long").alias("i"), *[made[c].alias(c) for c in names])
    return rows


@query(f"WITH RECURSIVE {LONG_WAVE}, {cascade_sql([HIGH_PASS], gain=0.997721867867)} SELECT record_id, i, {r6(*ALL, digits=4)} FROM flt")
def high_pass_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.high_pass(long_wave(spark, sf_dir), block=BLOCK), 4)


@query(f"WITH {LONG_WAVE}, {integral_sql('wave', 'v')}, {integral_sql('v', 'd')} SELECT record_id, i, {r6(*ALL, digits=9)} FROM d")
def integrate_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.integrate_twice(long_wave(spark, sf_dir), block=BLOCK), 9)


@query(
    f"WITH RECURSIVE {LONG_WAVE}, {flat_sql('wave', ALL)}, {bank_sql(PERIODS, 0.05, 100.0)}, {oscillator_sql(100.0, 'flat')}, "
    f"p AS (SELECT record_id, period_s, component, max(abs(d)) AS sd_cm, max(abs(v)) AS sv_cm_s FROM osc GROUP BY ALL) SELECT record_id, period_s, component, "
    f"{r6('sd_cm', 'sv_cm_s', '2 * pi() / period_s * sd_cm AS psv_cm_s', 'pow(2 * pi() / period_s, 2) * sd_cm AS psa_gal')} FROM p"
)
def response_spectrum_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.response_spectrum(long_wave(spark, sf_dir), PERIODS, 0.05, block=BLOCK))


@query(
    f"WITH RECURSIVE {LONG_WAVE}, {flat_sql('wave', TWO)}, {bank_sql(PERIODS, 0.05, 100.0)}, {oscillator_sql(100.0, 'flat')}, "
    "v AS (SELECT record_id, i, component, sum(s) OVER (PARTITION BY record_id, component ORDER BY i) AS g FROM (SELECT record_id, i, component, coalesce((x + lag(x) OVER k) / 200, 0) AS s FROM flat WINDOW k AS (PARTITION BY record_id, component ORDER BY i))), "
    "s AS (SELECT o.record_id, o.period_s, o.i, sqrt(sum(pow(o.v + v.g, 2))) AS size FROM osc o JOIN v ON v.record_id = o.record_id AND v.i = o.i AND v.component = o.component GROUP BY ALL) "
    "SELECT record_id, period_s, round(max(size), 6) + 0.0 AS sva_cm_s, count(*) AS sample_count FROM s GROUP BY ALL"
)
def absolute_velocity_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.absolute_velocity_spectrum(long_wave(spark, sf_dir, TWO), periods=PERIODS, damping=0.05, high_pass=False, block=BLOCK))


REALTIME = f"""{LONG_WAVE}, {cascade_sql(sos(DESIGN_2012))},
amp AS (SELECT record_id, i, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS resultant_gal, c0, c1, c2 FROM flt),
th AS (SELECT *, list_sort(list(resultant_gal) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), 'DESC')[30] AS threshold_gal FROM amp),
ser AS (SELECT *, {raw_sql('threshold_gal')} AS intensity_raw FROM th),
rt AS (SELECT *, {reported_sql('intensity_raw')} AS intensity, max(intensity_raw) OVER (PARTITION BY record_id ORDER BY i) AS record_max_intensity_raw FROM ser)"""


@query(
    f"WITH RECURSIVE {REALTIME} SELECT record_id, i, {r6('resultant_gal', 'threshold_gal', 'i / 100.0 AS time_s', 'intensity_raw', 'intensity', 'record_max_intensity_raw', 'c0 AS filtered_c0', 'c1 AS filtered_c1', 'c2 AS filtered_c2')} FROM rt"
)
def realtime_intensity_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.realtime_intensity(long_wave(spark, sf_dir), window_s=0.4, block=BLOCK, keep_components=True))


@query(f"WITH {LONG_WAVE} SELECT record_id, i, round(list_sort(list(c0) OVER (PARTITION BY record_id ORDER BY i ROWS BETWEEN 136 PRECEDING AND CURRENT ROW), 'DESC')[11], 6) + 0.0 AS kth FROM wave")
def rolling_kth_largest_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intensity.rolling_kth_largest(long_wave(spark, sf_dir, ("c0",)), 137, 11, "c0", block=BLOCK)
    return rounded(out.select("record_id", "i", "kth"))


@query(f"WITH {MEASURED.replace(WAVE, LONG_WAVE)} SELECT record_id, {r6('threshold_gal', 'intensity_raw', 'intensity')}, {class_sql('intensity')} AS intensity_class FROM measured")
def measured_intensity_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of records whose lengths are no powers of two, over many tasks."""
    out = intensity.measured_intensity(long_wave(spark, sf_dir), block=BLOCK)
    return rounded(out.select("record_id", "threshold_gal", "intensity_raw", "intensity", "intensity_class"))


@query(f"WITH {LONG_WAVE}, r AS (SELECT record_id, c0, row_number() OVER (PARTITION BY record_id ORDER BY c0 DESC) AS k, count(*) OVER (PARTITION BY record_id) AS n FROM wave) SELECT record_id, round(c0, 6) + 0.0 AS threshold FROM r WHERE k = 150")
def duration_threshold_long_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 150th largest sample, selected by counting: no record is sorted."""
    rows = long_wave(spark, sf_dir, ("c0",)).select("record_id", F.col("c0").alias("v"))
    return rounded(motion.select_rank(rows, 150, parts=64, most=20))
