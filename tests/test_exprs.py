"""Column helpers: null/zero rules and the projection."""

import pytest
from pyspark.sql import functions as F

from marketgrid.functions.exprs import clip_lower, minmax_scale, safe_div, up_count
from marketgrid.functions.geo import tm_to_lonlat, tm_to_lonlat_py


def test_safe_div_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(safe_div("a", "b")).collect()]
    assert got == [None, None, 1.5]


def test_clip_lower_keeps_null(spark):
    df = spark.createDataFrame([(None,), (100.0,), (5000.0,)], "x double")
    got = [r[0] for r in df.select(clip_lower("x", 3000.0)).collect()]
    assert got == [None, 3000.0, 5000.0]


def test_minmax_flat_partition_gives_50(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (1.0, 0.0, 4.0)], "x double, lo double, hi double")
    got = [r[0] for r in df.select(minmax_scale("x", "lo", "hi")).collect()]
    assert got == [50.0, 25.0]


def test_up_count_counts_a_return_after_a_gap(spark):
    # q2 missing (0), then back: 5 -> 0 -> 6 -> 7 has rises at q3 and q4
    df = spark.createDataFrame([(5.0, 0.0, 6.0, 7.0)], "q1 double, q2 double, q3 double, q4 double")
    assert df.select(up_count(["q1", "q2", "q3", "q4"])).first()[0] == 2


def test_projection_known_point(spark):
    lon, lat = tm_to_lonlat_py(201642.0, 452260.0)
    assert lon == pytest.approx(127.018587, abs=1e-6)
    assert lat == pytest.approx(37.569880, abs=1e-6)
    df = spark.createDataFrame([(201642.0, 452260.0)], "x double, y double")
    clon, clat = tm_to_lonlat(F.col("x"), F.col("y"))
    r = df.select(clon, clat).first()
    assert r[0] == pytest.approx(lon, abs=1e-9) and r[1] == pytest.approx(lat, abs=1e-9)


def test_projection_origin_is_lon0_lat0():
    lon, lat = tm_to_lonlat_py(200000.0, 500000.0)
    assert lon == pytest.approx(127.0, abs=1e-9) and lat == pytest.approx(38.0, abs=1e-9)
