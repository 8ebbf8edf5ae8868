"""Reading strong-motion records: text files, external traces, published tables, synthetic motion."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import DataFormatError
from ..functions.units import unit_column

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][-+]?\d+)?"
BREAK = r"[\s,]+"
ENCODINGS = ("utf-8-sig", "cp932")


def decode_files(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """(source, text) from a binaryFile scan: UTF-8 (a byte-order mark is dropped), else CP932; null where neither decodes."""
    tried = (encoding,) if encoding else ENCODINGS

    def one(data: bytes) -> str | None:
        for name in tried:
            try:
                return bytes(data).decode(name)
            except UnicodeDecodeError:
                continue
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"source": pdf["path"], "text": [one(d) for d in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "source string, text string")


def read_text_records(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Parsed records (see parse_text_records) of the files under a path."""
    return parse_text_records(decode_files(spark.read.format("binaryFile").load(path), encoding))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), BREAK), lambda t: t != "")


def _numbers(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1)), lambda t: t.cast("double"))


def _once(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row: filters and projections above would repeat them for each use, but don't pass a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))).alias(*made))


def parse_text_records(texts: DataFrame) -> DataFrame:
    """One row per (source, text): header fields, samples as an array, and ``error`` (null: the record is sound).

    Seven header lines (code, latitude, longitude, rate, unit, start, component names;
    code and unit are the last token of their line, numbers the first on theirs) are
    followed by rows of one to three values.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col("text"), "\r\n?", "\n"), r"\s+$", ""), "\n")
    df = _once(texts, {"lines": F.transform(lines, lambda x: F.trim(x))}).withColumn("n_lines", F.size("lines"))
    line = lambda k: F.coalesce(F.get("lines", F.lit(k)), F.lit(""))
    last = lambda k: F.get(F.reverse(_tokens(line(k))), F.lit(0))
    first = lambda k: F.get(_numbers(line(k)), F.lit(0))
    t = F.col("time_numbers")
    whole = F.floor(F.get(t, F.lit(5)))
    start = F.expr(
        "try_make_timestamp_ntz(cast(time_numbers[0] as int), cast(time_numbers[1] as int), cast(time_numbers[2] as int),"
        " cast(time_numbers[3] as int), cast(time_numbers[4] as int), cast(floor(time_numbers[5]) as decimal(16,6)))"
    )
    micro = F.rint((F.get(t, F.lit(5)) - whole) * 1_000_000).cast("long")
    body = F.filter(F.slice("lines", 8, F.greatest(F.col("n_lines") - 7, F.lit(0))), lambda x: x != "")
    df = _once(df, {
        "station_code": last(0), "latitude_deg": first(1), "longitude_deg": first(2), "sampling_rate_hz": first(3), "unit": last(4),
        "time_numbers": _numbers(line(5)), "component_names": _tokens(line(6)), "body": F.transform(body, _tokens),
    })
    df = df.withColumn("start_time", F.when(F.size(t) >= 6, F.timestamp_add("MICROSECOND", micro.cast("int"), start)))
    df = _once(df, {"samples": F.transform("body", lambda row: F.transform(row, lambda x: x.try_cast("double")))})
    width = F.size("component_names")
    odd = F.array_position(F.transform("body", lambda r: F.size(r) != width), True)
    bad_number = F.exists("samples", lambda r: F.exists(r, lambda v: v.isNull()))
    infinite = F.exists("samples", lambda r: F.exists(r, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    checks = [
        (F.col("text").isNull(), "the bytes don't decode"),
        (F.col("n_lines") < 8, "seven header lines and data rows are needed"),
        (F.col("station_code").isNull(), "the station-code line is empty"),
        (F.coalesce(~F.col("latitude_deg").between(-90, 90), F.lit(True)), "the latitude is missing or out of range"),
        (F.coalesce(~F.col("longitude_deg").between(-180, 180), F.lit(True)), "the longitude is missing or out of range"),
        (F.coalesce(F.col("sampling_rate_hz") <= 0, F.lit(True)), "the sampling rate is missing or not positive"),
        (F.col("unit").isNull(), "the unit line is empty"),
        (F.col("start_time").isNull(), "the start time is missing or invalid"),
        (~width.between(1, 3), "one to three components must be named"),
        (odd > 0, "a row has another number of values than components are named"),
        (bad_number, "a value isn't a number"),
        (F.size("body") < 1, "the record has no samples"),
        (infinite, "a sample isn't finite"),
    ]
    error = F.lit(None).cast("string")
    for test, message in reversed(checks):
        error = F.when(test, F.lit(message)).otherwise(error)
    return df.select("source", "station_code", "latitude_deg", "longitude_deg", "sampling_rate_hz", "unit", "start_time", "component_names", "samples", error.alias("error"))


def record_table(parsed: DataFrame, strict: bool = True) -> DataFrame:
    """Headers with a record_id (the source); a malformed record stops the query, or is left out for a quarantine."""
    if not strict:
        return parsed.where("error is null").select(F.col("source").alias("record_id"), *[c for c in parsed.columns if c != "error"])
    message = F.concat(F.coalesce("source", F.lit("a record")), F.lit(": "), F.col("error"))
    code = F.when(F.col("error").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("station_code"))
    return parsed.withColumn("station_code", code).select(F.col("source").alias("record_id"), *[c for c in parsed.columns if c != "error"])


def waveform_table(records: DataFrame) -> DataFrame:
    """(record_id, i, c0, c1, c2) in the record's own unit; units are never guessed."""
    rows = records.select("record_id", F.posexplode("samples").alias("i", "v"))
    return rows.select("record_id", F.col("i").cast("long").alias("i"), *[F.get("v", F.lit(k)).alias(f"c{k}") for k in range(3)])


def download_record(url: str, destination: str, overwrite: bool = False, timeout_s: float = 30.0, max_bytes: int = 64 << 20, expected_sha256: str | None = None, user_agent: str = "quakeframe") -> dict:
    """Fetches one file to a local path: size cap, checksum, and the name appears only when all of it is there."""
    if urlparse(url).scheme not in ("http", "https"):
        raise ValueError("only http and https are fetched")
    target = Path(destination)
    if target.exists() and not overwrite:
        raise FileExistsError(destination)
    digest, size = hashlib.sha256(), 0
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=target.parent)
    try:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent})
        with urllib.request.urlopen(request, timeout=timeout_s) as reply, os.fdopen(handle, "wb") as out:
            headers = dict(reply.headers.items())
            while block := reply.read(1 << 16):
                size += len(block)
                if size > max_bytes:
                    raise DataFormatError(f"{url} is over {max_bytes} bytes")
                digest.update(block)
                out.write(block)
        if expected_sha256 and digest.hexdigest() != expected_sha256.lower():
            raise DataFormatError(f"{url} has another checksum than expected")
        os.replace(part, target)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise
    return {"path": str(target), "url": url, "byte_count": size, "sha256": digest.hexdigest(), "headers": headers}


# -- external traces -------------------------------------------------------------------

#: What channel names and last letters say of the component.
CHANNEL_NAMES = {"NS": 0, "EW": 1, "UD": 2}
CHANNEL_ENDS = {"N": 0, "1": 0, "E": 1, "2": 1, "Z": 2}
LABELS = {"NS": "NS", "EW": "EW", "UD": "UD", "N": "NS", "E": "EW", "Z": "UD", "1": "H1", "2": "H2"}


def component_of(channel: Column) -> tuple[Column, Column]:
    """Rank (0, 1, 2; null for others) and label of a channel code."""
    code = F.upper(F.trim(channel))
    end = F.right(code, F.lit(1))
    rank, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, v in CHANNEL_ENDS.items():
        rank, label = F.when(end == k, v).otherwise(rank), F.when(end == k, LABELS[k]).otherwise(label)
    for k, v in CHANNEL_NAMES.items():
        rank, label = F.when(code == k, v).otherwise(rank), F.when(code == k, LABELS[k]).otherwise(label)
    return rank, label


def apply_calibration(traces: DataFrame) -> DataFrame:
    """x times calib, calib then 1; null or non-finite factors stop the query."""
    bad = F.col("calib").isNull() | F.isnan("calib") | (F.abs("calib") == float("inf"))
    x = F.when(bad, F.raise_error(F.lit("a calibration factor isn't finite")).cast("double")).otherwise(F.col("x") * F.col("calib"))
    return traces.withColumn("x", x).withColumn("calib", F.lit(1.0))


def traces_to_waveform(traces: DataFrame, unit: str, channel_order: list[str] | None = None, allow_fewer: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, waveform) of trace rows (network, station_code, location, channel, sampling_rate_hz, start_time, i, x).

    A record is a (network, station, location).  Channels are ordered by what their names
    say or by channel_order; two channels of one component, more than three, unequal
    rates, starts or lengths and gaps stop the query.
    """
    key = ["network", "station_code", "location"]
    if channel_order is not None:
        if not 1 <= len(channel_order) <= 3 or len(set(channel_order)) != len(channel_order):
            raise DataFormatError("channel_order names one to three different channels")
        rank, label = F.lit(None).cast("int"), F.col("channel")
        for k, name in enumerate(channel_order):
            rank = F.when(F.col("channel") == name, k).otherwise(rank)
    else:
        rank, label = component_of(F.col("channel"))
    rows = traces.withColumn("rank", rank).withColumn("label", label)
    rows = rows.where("rank is not null") if channel_order is not None else rows
    shape = rows.groupBy(*key, "channel", "rank", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.count_distinct("i").alias("distinct"), F.count("x").alias("present"),
        F.min("sampling_rate_hz").alias("rate"), F.max("sampling_rate_hz").alias("rate_high"), F.min("start_time").alias("start"), F.max("start_time").alias("start_high"),
    )
    whole = (F.min("n") == F.max("n")) & (F.min("low") == F.max("low"))
    steady = (F.max("rate_high") - F.min("rate") <= F.min("rate") * 1e-9) & (F.min("rate") > 0)
    sound = F.bool_and((F.col("n") == F.col("distinct")) & (F.col("n") == F.col("present")) & (F.col("high") - F.col("low") + 1 == F.col("n")))
    together = F.max("start_high").cast("timestamp").cast("double") - F.min("start").cast("timestamp").cast("double") <= 1e-6
    checked = shape.groupBy(*key).agg(
        F.bool_or(F.col("rank").isNull()).alias("unknown"), (F.count(F.lit(1)) != F.count_distinct("rank")).alias("twice"), F.count(F.lit(1)).alias("channels"),
        (whole & sound).alias("whole"), steady.alias("steady"), together.alias("together"), F.min("rate").alias("sampling_rate_hz"), F.min("start").alias("start_time"),
        F.array_sort(F.collect_list(F.struct("rank", "channel", "label"))).alias("c"),
    )
    need = len(channel_order) if channel_order is not None else 3
    message = (
        F.when(F.col("unknown"), "a channel's component isn't known; give channel_order").when(F.col("twice"), "two channels of one component").when(F.col("channels") > 3, "more than three channels")
        .when((F.col("channels") < need) & F.lit(not allow_fewer or channel_order is not None), "a channel is missing").when(~F.col("steady"), "sampling rates differ")
        .when(~F.col("together"), "start times differ").when(~F.col("whole"), "lengths differ or samples are missing")
    )
    record_id = F.concat_ws(".", *[F.coalesce(F.col(k), F.lit("")) for k in key])
    checked = checked.withColumn("record_id", F.when(message.isNotNull(), F.raise_error(F.concat(F.lit("traces: "), message)).cast("string")).otherwise(record_id))
    records = checked.select(
        "record_id", *key, F.transform("c", lambda c: c["channel"]).alias("channel_codes"), F.transform("c", lambda c: c["label"]).alias("component_names"), "sampling_rate_hz",
        "start_time", unit_column(F.lit(unit)).alias("unit"),
    )
    place = rows.join(checked.select(*key, "record_id", "c"), [rows[k].eqNullSafe(checked[k]) for k in key]).select("record_id", "i", "x", (F.array_position(F.transform("c", lambda c: c["rank"]), F.col("rank")) - 1).alias("at"))
    waveform = place.groupBy("record_id", "i").pivot("at", [0, 1, 2]).agg(F.first("x"))
    return records, waveform.select("record_id", F.col("i").cast("long").alias("i"), *[F.col(str(k)).alias(f"c{k}") for k in range(3)])


# -- published tables ------------------------------------------------------------------


def read_published(spark: SparkSession, path: str, columns: dict[str, int], header_prefix: str | None = None, encoding: str = "cp932") -> DataFrame:
    """Columns by position of a published CSV, as strings (blank and '-' are null); lines up to the header are skipped."""
    text = decode_files(spark.read.format("binaryFile").load(path), encoding)
    lines = text.select("source", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "line")).where("trim(line) <> ''")
    if header_prefix is None:
        body = lines.where("n > 0")
    else:
        head = F.min(F.when(F.col("line").startswith(header_prefix), F.col("n"))).over(Window.partitionBy("source"))
        body = lines.withColumn("head", head).where("n > head")
    cell = lambda k: F.nullif(F.nullif(F.trim(F.get(F.split("line", ","), F.lit(k))), F.lit("")), F.lit("-"))
    return body.select(*[cell(k).alias(name) for name, k in columns.items()])


#: Positions in the published station summaries.
SUMMARY = {"code": 0, "name": 1, "lat": 2, "lon": 3, "intensity_class": 4, "pga_1": 5, "pga_2": 6, "pga_3": 7, "pga": 8, "pgv_1": 9, "pgv_2": 10, "pgv_3": 11, "pgv": 12, "pgd_1": 13, "pgd_2": 14, "pgd_3": 15, "pgd": 16}
LEVELS = {"code": 0, "name": 1, "long_period_class": 5, **{f"band_{k}": 5 + k for k in range(1, 8)}, "lat": 13, "lon": 14}


def join_published(summary: DataFrame, levels: DataFrame) -> DataFrame:
    """Stations that both tables hold, with numbers as doubles."""
    text = {"code", "name", "intensity_class", "long_period_class"}
    left = summary.select(*[c if c in text else F.col(c).try_cast("double").alias(c) for c in summary.columns])
    right = levels.select("code", "long_period_class", *[F.col(c).cast("string").alias(c) for c in levels.columns if c.startswith("band_")])
    return left.join(right, "code")


# -- synthetic motion ------------------------------------------------------------------


def synthetic_motion(
    spark: SparkSession, rate: float = 100.0, duration_s: float = 30.0, center_s: float | None = None, width_s: float = 2.5, amplitudes=(90.0, 62.0, 34.0),
    frequencies=(1.1, 2.4, 5.8), phases=(0.0, 0.35, 1.0), noise_std: float = 0.02, seed: int = 2026, record_id: str = "synthetic",
) -> DataFrame:
    """Sines under a Gaussian envelope with seeded noise, as one record.

    The noise generator is numpy's, sample after sample, so the one record's noise is made
    on the driver; without noise all of it is Column expressions.
    """
    n = max(1, round(duration_s * rate))
    middle = 0.45 * duration_s if center_s is None else center_s
    t = F.col("i") / F.lit(float(rate))
    envelope = F.exp(-0.5 * F.pow((t - middle) / width_s, F.lit(2.0)))
    base = spark.range(n).select(F.col("id").alias("i"))
    clean = [envelope * a * F.sin(t * (2 * np.pi * f) + p) for a, f, p in zip(amplitudes, frequencies, phases, strict=True)]
    if not noise_std:
        return base.select(F.lit(record_id).alias("record_id"), "i", *[c.alias(f"c{k}") for k, c in enumerate(clean)])
    noise = np.random.default_rng(seed).normal(0.0, noise_std, (n, 3))
    added = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), **{f"e{k}": noise[:, k] for k in range(3)}}))
    return base.join(added, "i").select(F.lit(record_id).alias("record_id"), "i", *[(c + F.col(f"e{k}")).alias(f"c{k}") for k, c in enumerate(clean)])
