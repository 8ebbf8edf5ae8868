"""Queries over records: text files, traces, resampling, the whole-event job, and their SQL twins.

The events are written out as record texts or channel traces by Spark and read by the
operators; the twins go from the events to the values directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scale
from ..operators import design, intensity
from ..sources import records
from . import event
from .queries import ALL, CELLS, KM, MEASURED, ORACLES, QUERIES, RESULTANT, STATION, WAVE, cascade_sql, cells, class_sql, query, r6, reported_sql, rounded, stations, table, wave
from .storage import written

# -- text records ----------------------------------------------------------------------


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, text) of a record per user; every seventh one has a row with a value too few."""
    k = F.col("record_id")
    row = F.concat_ws(" ", *ALL)
    row = F.when((k % 7 == 3) & (F.col("i") == 1), F.col("c0").cast("string")).otherwise(row)
    rows = wave(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))).alias("rows"))
    start = F.format_string("2024 01 %02d %02d %02d %02d", 1 + k % 28, k % 24, k % 60, (k * 7) % 60)
    head = [
        F.concat(F.lit("SITE CODE= S"), k.cast("string")), F.concat(F.lit("LAT.= "), (30 + k % 15 + 0.25).cast("string")), F.concat(F.lit("LON.= "), (130 + k % 12 + 0.5).cast("string")),
        F.lit("SAMPLING RATE= 100Hz"), F.lit("UNIT  = gal(cm/s/s)"), F.concat(F.lit("INITIAL TIME = "), start), F.lit(" NS,EW,UD"),
    ]
    text = F.concat_ws("\r\n", *head, F.array_join(F.transform("rows", lambda r: r["row"]), "\r\n"))
    return rows.select(F.concat(F.lit("record-"), k.cast("string")).alias("source"), text.alias("text"))


SOUND = "record_id % 7 <> 3 OR n = 1"


@query(f"""WITH {WAVE}, s AS (SELECT record_id, count(*) AS n FROM wave GROUP BY record_id)
SELECT 'record-' || record_id AS source, 'S' || record_id AS station_code, 30 + record_id % 15 + 0.25::DOUBLE AS latitude_deg, 130 + record_id % 12 + 0.5::DOUBLE AS longitude_deg, 100.0::DOUBLE AS sampling_rate_hz,
 'gal(cm/s/s)' AS unit, strftime(make_timestamp(2024, 1, 1 + record_id % 28, record_id % 24, record_id % 60, (record_id * 7 % 60)::DOUBLE), '%Y-%m-%d %H:%M:%S') AS start_time, 'NS EW UD' AS component_names, n AS sample_count,
 CASE WHEN NOT ({SOUND}) THEN 'a row has another number of values than components are named' END AS error FROM s""")
def text_record_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = records.parse_text_records(record_texts(spark, sf_dir))
    return parsed.select(
        "source", "station_code", "latitude_deg", "longitude_deg", "sampling_rate_hz", "unit", F.col("start_time").cast("string").alias("start_time"),
        F.array_join("component_names", " ").alias("component_names"), F.size("samples").cast("long").alias("sample_count"), "error",
    )


@query(f"WITH {WAVE}, s AS (SELECT record_id, count(*) AS n FROM wave GROUP BY record_id) SELECT 'record-' || record_id AS record_id, i, {r6(*ALL)} FROM wave JOIN s USING (record_id) WHERE {SOUND}")
def text_record_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed records are left out."""
    return rounded(records.waveform_table(records.record_table(records.parse_text_records(record_texts(spark, sf_dir)), strict=False)))


# -- traces ----------------------------------------------------------------------------


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace row per channel and sample, in counts of a quarter gal."""
    channel = lambda name, c: F.struct(F.lit(name).alias("channel"), (F.col(c) * 4).alias("x"))
    three = F.explode(F.array(channel("HNZ", "c2"), channel("HNE", "c1"), channel("HNN", "c0"))).alias("t")
    station = F.concat(F.lit("S"), F.col("record_id").cast("string")).alias("station_code")
    start = F.timestamp_seconds(F.lit(1704067200)).alias("start_time")
    rows = wave(spark, sf_dir).select(F.lit("XX").alias("network"), station, F.lit("").alias("location"), start, F.lit(100.0).alias("sampling_rate_hz"), "i", F.lit(0.25).alias("calib"), three)
    return rows.select("*", "t.channel", "t.x").drop("t")


@query(f"WITH {WAVE} SELECT 'XX.S' || record_id || '.' AS record_id, i, {r6(*ALL)} FROM wave")
def trace_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.traces_to_waveform(records.apply_calibration(traces(spark, sf_dir)), "gal")[1])


@query("SELECT DISTINCT 'XX.S' || user_id || '.' AS record_id, 'XX' AS network, 'S' || user_id AS station_code, 'HNN HNE HNZ' AS channel_codes, 'NS EW UD' AS component_names, 100.0::DOUBLE AS sampling_rate_hz FROM events")
def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.traces_to_waveform(records.apply_calibration(traces(spark, sf_dir)), "gal")[0]
    return found.select("record_id", "network", "station_code", F.array_join("channel_codes", " ").alias("channel_codes"), F.array_join("component_names", " ").alias("component_names"), "sampling_rate_hz")


# -- resampling ------------------------------------------------------------------------


def resample_sql(up: int, down: int) -> str:
    """The polyphase sum written out: Kaiser window (beta 5) by the power series of I0, taps that sum to up."""
    longest = max(up, down)
    half = 10 * longest
    return f"""WITH {WAVE},
raw AS (SELECT t, (CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * t / {longest}) / (pi() * t / {longest}) END)
  * (SELECT sum(pow(2.5 * sqrt(1 - pow(t / {half}.0, 2)), 2 * m) / pow(gamma(m + 1), 2)) FROM range(0, 40) q(m)) AS w FROM range(-{half}, {half} + 1) g(t)),
taps AS (SELECT t, {up} * w / (SELECT sum(w) FROM raw) AS h FROM raw),
size AS (SELECT record_id, count(*) AS n FROM wave GROUP BY record_id),
outs AS (SELECT record_id, unnest(range(0, CAST(ceil(n * {up} / {down}.0) AS BIGINT))) AS k FROM size),
near AS (SELECT record_id, k, CAST(ceil((k * {down} - {half}) / {up}.0) AS BIGINT) + o AS i FROM outs, range(0, {2 * half // up + 1}) g(o))
SELECT near.record_id, k AS i, {', '.join(f'round(sum({c} * h), 6) + 0.0 AS {c}' for c in ALL)}
FROM near JOIN wave ON wave.record_id = near.record_id AND wave.i = near.i JOIN taps ON t = k * {down} - near.i * {up} GROUP BY near.record_id, k"""


def _resampled(name: str, original: float, up: int, down: int) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(intensity.resample(wave(spark, sf_dir), original, 100.0))

    QUERIES[name], ORACLES[name] = f, resample_sql(up, down)


_resampled("resample_128_to_100", 128.0, 25, 32)
_resampled("resample_50_to_100", 50.0, 2, 1)
_resampled("resample_200_to_100", 200.0, 1, 2)

# -- the whole event -------------------------------------------------------------------

PUBLISHED = "published AS (SELECT s_suppkey AS record_id, 20 + abs(s_acctbal) / 100 AS pga_gal, 0.01 + abs(s_acctbal) / 100000 AS pgd_cm, 1 + abs(s_acctbal) / 2000 AS intensity_raw FROM supplier)"


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station values of the supplier table in the place of published ones; codes meet record ids."""
    a = F.abs("s_acctbal")
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), (20 + a / 100).alias("pga_gal"), (0.01 + a / 100000).alias("pgd_cm"), (1 + a / 2000).alias("intensity_raw"))
    return made.withColumn("intensity_class", scale.classify_intensity(scale.report_intensity(F.col("intensity_raw"))))


def error_sql(name: str) -> str:
    a, b = f"j.{name}", f"j.published_{name}"
    return (
        f"SELECT '{name}' AS quantity, count(*) AS stations, count(*) FILTER (abs({a} - {b}) / abs({b}) <= 0.5) AS within, "
        f"round(quantile_cont(abs({a} - {b}) / abs({b}), 0.5), 5) AS median_relative_error, round(max(abs({a} - {b})), 5) AS max_error FROM joined j"
    )


REPORTED = ("intensity_raw", "pga_gal", "pgd_cm")
EVENT = f"""WITH RECURSIVE {MEASURED}, {cascade_sql([design.DISPLACEMENT_FILTER], name="moved")}, {PUBLISHED},
peak AS (SELECT record_id, max({RESULTANT}) AS pga_gal FROM wave GROUP BY record_id), far AS (SELECT record_id, max({RESULTANT}) AS pgd_cm FROM moved GROUP BY record_id),
joined AS (SELECT m.record_id, m.intensity_raw, m.intensity, peak.pga_gal, far.pgd_cm, p.intensity_raw AS published_intensity_raw, p.pga_gal AS published_pga_gal, p.pgd_cm AS published_pgd_cm,
  {reported_sql('p.intensity_raw')} AS published_intensity FROM measured m JOIN peak ON peak.record_id = m.record_id JOIN far ON far.record_id = m.record_id JOIN published p ON p.record_id = m.record_id)"""


@query(f"{EVENT} {' UNION ALL '.join(map(error_sql, REPORTED))}")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = written(event.against_published(event.station_quantities(wave(spark, sf_dir)), published(spark, sf_dir)))  # three reports read it
    parts = [event.error_report(joined, c, f"published_{c}", tolerance=0.5).select(F.lit(c).alias("quantity"), "*") for c in REPORTED]
    return rounded(parts[0].union(parts[1]).union(parts[2]), 5)


@query(f"{EVENT} SELECT count(*) AS stations, count(*) FILTER ({class_sql('intensity')} = {class_sql('published_intensity')}) AS agreeing FROM joined")
def event_class_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = event.against_published(event.station_quantities(wave(spark, sf_dir)), published(spark, sf_dir))
    return event.class_report(joined, "intensity_class", "published_intensity_class")


# -- labels, distances -----------------------------------------------------------------


@query("""
WITH s AS (SELECT s_suppkey, abs(s_acctbal) / 1300 AS value FROM supplier), names(k, name, lower, upper) AS (VALUES (0, '0', '-Infinity'::DOUBLE, 0.5), (1, '1', 0.5, 1.5), (2, '2', 1.5, 2.5), (3, '3', 2.5, 3.5), (4, '4', 3.5, 4.5),
 (5, '5-', 4.5, 5.0), (6, '5+', 5.0, 5.5), (7, '6-', 5.5, 6.0), (8, '6+', 6.0, 6.5), (9, '7', 6.5, 'Infinity'::DOUBLE)) SELECT s_suppkey, name AS intensity_class, lower, upper FROM s JOIN names ON value >= lower AND value < upper""")
def intensity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "supplier").select("s_suppkey", scale.classify_intensity(F.abs("s_acctbal") / 1300).alias("intensity_class"))
    return named.join(F.broadcast(scale.intensity_intervals(spark)), "intensity_class").select("s_suppkey", "intensity_class", "lower", "upper")


@query(f"WITH {STATION}, {CELLS} SELECT l_orderkey, l_linenumber, round({KM}, 4) AS km FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN cell c ON c.row = o_custkey JOIN station s ON s.station_id = l_suppkey")
def shipping_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance of the supplier and the customer of every order line."""
    c = cells(spark, sf_dir).select(F.col("row").alias("o_custkey"), "lat", "lon")
    s = stations(spark, sf_dir).select(F.col("station_id").alias("l_suppkey"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = lines.join(orders, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return joined.select("l_orderkey", "l_linenumber", F.round(geo.great_circle_km(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")), 4).alias("km"))
