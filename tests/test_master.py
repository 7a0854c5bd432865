"""A1: fused stand-in master equals the generic join of the four sources;
grain; exclusions and sentinels."""

from pyspark.sql import functions as F

from marketgrid.config import STANDIN, UNKNOWN
from marketgrid.plans.master import MASTER_COLUMNS, build_master
from marketgrid.sources.standin import standin_master, standin_sources

from helpers import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.select(*MASTER_COLUMNS).collect())


def test_fused_equals_generic_joins(spark):
    fused = standin_master(spark, SF_SMALL, STANDIN)
    generic = build_master(*standin_sources(spark, SF_SMALL, STANDIN), STANDIN)
    assert _rows(fused) == _rows(generic)


def test_one_row_per_quarter_area_industry(spark):
    m = standin_master(spark, SF_SMALL, STANDIN)
    dup = m.groupBy("quarter", "area_id", "industry").count().filter("count > 1").count()
    assert dup == 0 and m.count() > 0
    assert m.filter(F.col("neighbourhood") != UNKNOWN).count() == 0


def test_exclusions_and_unmatched_area(spark):
    sales = spark.createDataFrame(
        [(20241, "1", "한식음식점", 100, 1, None, 5), (20241, "2", "한식음식점", 100, 1, 1, 1),
         (20241, "3", "한식음식점", 100, 1, 1, 1), (20241, "4", "한식음식점", 100, 1, 1, 1),
         (20241, "5", "한식음식점", 100, 1, 1, 1), (20249, "1", "한식음식점", 100, 1, 1, 1),
         (20241, "1", "편의점", 100, 1, 1, 1), (20241, "1", "중식음식점", 0, 1, 1, 1)],
        "quarter int, area_id string, industry string, sales_amt bigint, sales_cnt bigint, "
        "amt_20s bigint, amt_30s bigint")
    stores = sales.select("quarter", "area_id", "industry", F.lit(2).cast("bigint").alias("stores"),
                          F.lit(None).cast("bigint").alias("opened"),
                          F.lit(1).cast("bigint").alias("closed"))
    foot = sales.select("quarter", "area_id", F.lit(10).cast("bigint").alias("foot")).distinct()
    area = spark.createDataFrame(
        [("1", "골목상권", "연남동 골목", None, None, 201642.0, 452260.0),
         ("2", "전통시장", "어느 시장", "마포구", "동", 201642.0, 452260.0),
         ("3", "골목상권", "역삼 백화점", "강남구", "동", 201642.0, 452260.0),
         ("4", "골목상권", "지하 상가", "강남구", "동", 201642.0, 452260.0)],
        "area_id string, area_type string, area_name string, district string, "
        "neighbourhood string, x double, y double")
    from marketgrid.config import REFERENCE
    m = build_master(sales, stores, foot, area, REFERENCE).collect()
    assert [(r.area_id, r.industry) for r in m] == [("1", "한식음식점")]
    r = m[0]
    assert r.district == UNKNOWN and r.neighbourhood == UNKNOWN
    assert r.amt_20s == 0 and r.opened == 0
    assert abs(r.lon - 127.018587) < 1e-6 and abs(r.lat - 37.569880) < 1e-6
