"""A1: the master table, one row per (quarter, area, industry).

``build_master`` takes the four cleaned-or-raw source frames (sales, stores,
foot traffic, area) with canonical column names, applies each source's
cleaning rule and joins them exactly as the pipeline does:
sales ⋈ stores on (quarter, area, industry), ⋈ foot on (quarter, area),
⋈ area on area_id, then drops traditional markets and excluded names.

The area join is written as inner: the pipeline writes a left join followed
by a filter on area columns that rejects nulls, which is the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN, Params
from ..functions.geo import tm_to_lonlat

MASTER_COLUMNS = [
    "area_id", "quarter", "industry", "sales_amt", "sales_cnt", "amt_20s", "amt_30s",
    "stores", "opened", "closed", "foot", "area_type", "area_name", "district",
    "neighbourhood", "lon", "lat",
]
AREA_TEXT = ["area_type", "area_name", "district", "neighbourhood"]


# --- per-source cleaning rules (as predicates so fused plans can reuse them) ---

def sales_ok(p: Params) -> Column:
    return (F.col("quarter").isin(list(p.quarters)) & F.col("industry").isin(list(p.industries))
            & (F.col("sales_amt") > 0) & (F.col("sales_cnt") > 0)
            & F.col("area_id").isNotNull())


def stores_ok(p: Params) -> Column:
    return (F.col("quarter").isin(list(p.quarters)) & F.col("industry").isin(list(p.industries))
            & (F.col("stores") > 0) & F.col("area_id").isNotNull())


def foot_ok(p: Params) -> Column:
    return (F.col("quarter").isin(list(p.quarters)) & (F.col("foot") > 0)
            & F.col("area_id").isNotNull())


def area_ok(p: Params) -> Column:
    return ((F.col("area_type") != p.excluded_area_type)
            & ~F.col("area_name").rlike(p.excluded_name_pattern))


def clean_sales(df: DataFrame, p: Params) -> DataFrame:
    return (df.select("quarter", "area_id", "industry", "sales_amt", "sales_cnt",
                      "amt_20s", "amt_30s")
            .filter(sales_ok(p))
            .fillna(0, subset=["amt_20s", "amt_30s"]))


def clean_stores(df: DataFrame, p: Params) -> DataFrame:
    return (df.select("quarter", "area_id", "industry", "stores", "opened", "closed")
            .filter(stores_ok(p))
            .fillna(0, subset=["opened", "closed"]))


def clean_foot(df: DataFrame, p: Params) -> DataFrame:
    return df.select("quarter", "area_id", "foot").filter(foot_ok(p))


def clean_area(df: DataFrame) -> DataFrame:
    """Area dimension: text sentinel for missing names, x/y -> lon/lat."""
    x = F.col("x").cast("string").try_cast("double")
    y = F.col("y").cast("string").try_cast("double")
    lon, lat = tm_to_lonlat(x, y)
    return (df.select("area_id", *AREA_TEXT, lon.alias("lon"), lat.alias("lat"))
            .fillna(UNKNOWN, subset=AREA_TEXT))


def build_master(sales: DataFrame, stores: DataFrame, foot: DataFrame, area: DataFrame,
                 p: Params) -> DataFrame:
    m = (clean_sales(sales, p)
         .join(clean_stores(stores, p), ["quarter", "area_id", "industry"], "inner")
         .join(clean_foot(foot, p), ["quarter", "area_id"], "inner")
         .join(clean_area(area), "area_id", "inner")
         .filter(area_ok(p)))
    return m.select(*MASTER_COLUMNS)
