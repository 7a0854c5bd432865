"""Small hand-made masters for the semantic cases."""

from marketgrid.plans.master import MASTER_COLUMNS

SCHEMA = ("area_id bigint, quarter int, industry string, sales_amt bigint, sales_cnt bigint, "
          "amt_20s bigint, amt_30s bigint, stores bigint, opened bigint, closed bigint, "
          "foot bigint, area_type string, area_name string, district string, "
          "neighbourhood string, lon double, lat double")


def row(area, quarter, industry="A", amt=3000, cnt=10, a20=0, a30=0, stores=1, opened=0,
        closed=0, foot=100, area_type="T", name=None, district="D1", lon=127.0, lat=37.5):
    return (area, quarter, industry, amt, cnt, a20, a30, stores, opened, closed, foot, area_type,
            name or f"area{area}", district, "N", lon, lat)


def master_df(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.columns == MASTER_COLUMNS
    return df

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
