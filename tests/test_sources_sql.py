"""The published-table source, its stream, and the functions for SQL text."""

import numpy as np
import pytest

from quakeframe import sql
from quakeframe.operators import design, kernels
from quakeframe.plans import source_queries  # noqa: F401  (its queries)
from quakeframe.plans.queries import ORACLES, QUERIES
from tests.oracle import duck_rows, spark_rows

SUMMARY = "code,name,lat\r\nA1,東京,35.5,139.5,4,1.0\r\n\r\nB2,-,,140\r\n"


@pytest.mark.parametrize("name", ["sql_oscillator_spectrum", "sql_duration_threshold", "published_summary"])
def test_twins(spark, name):
    path = "/root/testdata/sf0.001"
    assert spark_rows(QUERIES[name](spark, path)) == duck_rows(ORACLES[name], path)


def test_files_in_either_encoding(spark, tmp_path):
    sql.register(spark)
    (tmp_path / "a.csv").write_bytes(SUMMARY.encode("cp932"))
    (tmp_path / "b.csv").write_bytes(SUMMARY.encode())
    (tmp_path / "_hidden").write_bytes(b"x\ny")
    load = lambda schema, **options: spark.read.format("published_table").schema(schema).options(path=f"file://{tmp_path}", **options).load()
    got = load("name string, lon string, code string").collect()
    assert sorted((r.code, r.name, r.lon) for r in got) == [("A1", "東京", "139.5")] * 2 + [("B2", None, "140")] * 2
    whole = spark.read.format("published_table").options(path=f"file://{tmp_path}/a.csv", table="levels").load()
    assert whole.columns[:2] == ["code", "name"] and whole.count() == 2
    (tmp_path / "v.csv").write_bytes(b"title\nnote\nperiod,0.05,0.10\n0.1,5,6\n")
    one = spark.read.format("published_table").schema("period string, p2 string").options(path=f"file://{tmp_path}/v.csv", table="spectrum").load()
    assert [tuple(r) for r in one.collect()] == [("0.1", "6")]
    (tmp_path / "bad.csv").write_bytes(b"h\n\x81\x20\n")
    with pytest.raises(Exception, match="decode"):
        load("code string").collect()
    with pytest.raises(Exception, match="table must be"):
        spark.read.format("published_table").schema("code string").options(path=f"file://{tmp_path}", table="other").load().collect()


def test_stream_takes_each_file_once(spark, tmp_path):
    sql.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        source = spark.readStream.format("published_table").schema("code string, name string").options(path=f"file://{folder}").load()
        out = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        out.start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    (folder / "a.csv").write_bytes(SUMMARY.encode("cp932"))
    assert run() == 2
    (folder / "b.csv").write_bytes(SUMMARY.encode())
    assert run() == 4


def test_functions(spark):
    sql.register(spark)
    made = design.design_realtime_filter(100.0)
    rows = spark.sql("SELECT * FROM intensity_filter(100.0D, 'auto') ORDER BY section").collect()
    assert np.allclose([tuple(r)[1:] for r in rows], np.array(made.sections, float))
    x = np.random.default_rng(2).normal(size=500)
    values = ", ".join(f"{v!r}D" for v in x.tolist())
    row = spark.sql(f"SELECT * FROM oscillator_spectrum(array({values}), 100.0D, 0.05D, array(0.7D))").first()
    bank = kernels.BankFilter(design.oscillator_bank((0.7,), 0.05, 100.0))
    want = np.max([np.abs(y).max(axis=(1, 2, 3)) for _, y in bank.run(x[:, None], bank.start(x[:1]))], axis=0)
    assert (row.sd_cm, row.sv_cm_s) == pytest.approx(tuple(want), rel=1e-9)
    assert spark.sql("SELECT duration_threshold(v, 2) AS t, duration_threshold(v, 9) AS none FROM VALUES (1.0D), (3.0D), (2.0D), (NULL) AS t(v)").first() == (2.0, None)
