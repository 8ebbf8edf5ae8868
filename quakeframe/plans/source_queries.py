"""Queries through the registered SQL functions and the published-table source."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from .queries import AMPLITUDE, PERIODS, WAVE, amplitude, bank_sql, flat_sql, oscillator_sql, query, r6, table, wave
from .storage import shared_dir

SPECTRUM = f"{WAVE}, {flat_sql('wave', ('c0',))}, {bank_sql(PERIODS, 0.05, 100.0)}, {oscillator_sql(100.0, 'flat')}"


@query(f"WITH RECURSIVE {SPECTRUM} SELECT record_id, period_s, {r6('max(abs(d)) AS sd_cm', 'max(abs(v)) AS sv_cm_s')} FROM osc GROUP BY record_id, period_s")
def sql_oscillator_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(
        """
        WITH records AS (SELECT record_id, transform(array_sort(collect_list(struct(i, c0))), x -> x.c0) AS samples FROM {wave} GROUP BY record_id)
        SELECT record_id, period_s, round(sd_cm, 6) + 0.0D AS sd_cm, round(sv_cm_s, 6) + 0.0D AS sv_cm_s
        FROM records, LATERAL oscillator_spectrum(samples, 100.0D, 0.05D, array(0.2D, 0.5D, 1.0D, 1.7D, 2.4D))
        """,
        wave=wave(spark, sf_dir, ("c0",)),
    )


@query(f"WITH {AMPLITUDE}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY amplitude DESC) AS k FROM amp) SELECT record_id, round(amplitude, 6) + 0.0 AS threshold FROM r WHERE k = 30")
def sql_duration_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT record_id, round(duration_threshold(amplitude, 30), 6) + 0.0D AS threshold FROM {amp} GROUP BY record_id", amp=amplitude(spark, sf_dir))


def publish(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers as published station summaries, a file a nation: CP932 for even nations, UTF-8 for odd ones; the files' folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/quakeframe-published-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "supplier")
    balance = F.when(F.col("s_acctbal") < 0, F.lit("-")).otherwise(F.format_string("%.2f", "s_acctbal"))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit("観測点 "), "s_name"), *[F.lit("")] * 6, balance)
    rows = s.select("s_nationkey", "s_suppkey", line.alias("line"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        nation = int(pdf["s_nationkey"].iloc[0])
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        text = "code,name\r\n" + "\r\n".join(pdf.sort_values("s_suppkey")["line"]) + "\r\n"
        # The name is the nation's, so a task that runs again writes the same file.
        with where.open_output_stream(f"{path}/nation-{nation}.csv") as out:
            out.write(text.encode("cp932" if nation % 2 == 0 else "utf-8"))
        return pd.DataFrame({"nation": [nation]})

    rows.groupBy("s_nationkey").applyInPandas(write, "nation int").count()
    return folder


@query("SELECT s_suppkey::VARCHAR AS code, '観測点 ' || s_name AS name, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS pga FROM supplier")
def published_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in two encodings and read through the source, three of its columns."""
    sql.register(spark)
    found = spark.read.format("published_table").schema("code string, name string, pga string").option("path", publish(spark, sf_dir)).option("table", "summary").load()
    return found.select("code", "name", F.col("pga").cast("double").alias("pga"))
