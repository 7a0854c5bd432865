"""Source datasets derived from the driver's TPC-H-shaped tables.

The pipeline's four raw datasets are rebuilt from ``lineitem``, ``orders``,
``part``, ``supplier``, ``nation`` and ``region`` (one parquet file each):

=================  ==========================================================
quarter            year(l_shipdate) * 10 + quarter(l_shipdate)
area_id/area_name  l_suppkey / s_name;  district = n_name;  area_type = r_name
industry           p_type
sales_amt          sum of round(l_extendedprice * 100) (cents, exact)
sales_cnt          number of lines
amt_20s / amt_30s  cents of lines whose order priority is 1-URGENT / 2-HIGH
stores             number of distinct parts
opened / closed    lines with return flag A / R
foot               sum of l_quantity per (quarter, supplier), all part types
x / y              190000 + (s_suppkey % 200) * 100 / 440000 + (s_suppkey % 170) * 100
neighbourhood      not available -> filled with the 'unknown' sentinel
=================  ==========================================================

``standin_facts`` scans lineitem once (date range pushed to the parquet scan,
seven columns read).  Lines are summed per (quarter, supplier, part) first; a
part has one type, so the (quarter, supplier, type) grain then counts rows
instead of distinct parts, and ``part`` is joined to the smaller side.  The
first sum's partial rows are nearly as many as the lines (a supplier rarely
sells a part twice in a quarter); the second collapses a hot supplier to one
row per type and task.  Foot traffic is then a window sum over the *aggregated* rows of a
(quarter, supplier) — at most one row per industry — so no second scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import STANDIN_NO_DISTRICT, Params
from ..operators.lineage import materialize
from ..plans.master import (MASTER_COLUMNS, area_ok, clean_area, foot_ok, sales_ok,
                            stores_ok)

URGENT, HIGH = "1-URGENT", "2-HIGH"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quarter_bounds(p: Params) -> tuple[dt.datetime, dt.datetime]:
    lo, hi = min(p.quarters), max(p.quarters)
    start = dt.datetime(lo // 10, 3 * (lo % 10) - 2, 1)
    end_y, end_m = (hi // 10, 3 * (hi % 10) + 1) if hi % 10 < 4 else (hi // 10 + 1, 1)
    return start, dt.datetime(end_y, end_m, 1)


def standin_lines(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Line items inside the analysed quarters, with their quarter code."""
    start, end = quarter_bounds(p)
    li = (read_table(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_returnflag", "l_shipdate")
          .filter((F.col("l_shipdate") >= F.lit(start)) & (F.col("l_shipdate") < F.lit(end))))
    q = (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).cast("int")
    return li.withColumn("quarter", q).filter(F.col("quarter").isin(list(p.quarters)))


def standin_facts(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """All measures at the (quarter, area, industry) grain, plus foot traffic."""
    li = standin_lines(spark, sf_dir, p)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    pri = F.col("o_orderpriority")
    sums = ["sales_amt", "sales_cnt", "amt_20s", "amt_30s", "opened", "closed", "_qty"]
    by_part = (li.join(orders, li.l_orderkey == orders.o_orderkey, "left")
               .groupBy("quarter", "l_suppkey", "l_partkey")
               .agg(F.sum(cents).alias("sales_amt"),
                    F.count(F.lit(1)).alias("sales_cnt"),
                    F.sum(F.when(pri == URGENT, cents).otherwise(0)).alias("amt_20s"),
                    F.sum(F.when(pri == HIGH, cents).otherwise(0)).alias("amt_30s"),
                    F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("opened"),
                    F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("closed"),
                    F.sum("l_quantity").alias("_qty")))
    facts = (by_part.join(part, by_part.l_partkey == part.p_partkey, "inner")
             .groupBy("quarter", F.col("l_suppkey").alias("area_id"),
                      F.col("p_type").alias("industry"))
             .agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("stores")))
    # One exchange on area_id serves both the foot window (quarter, area_id)
    # and the later join with the area dimension; after aggregation an area
    # holds at most quarters x industries rows, so hashing by area alone
    # cannot skew.
    w = Window.partitionBy("quarter", "area_id")
    return (facts.repartition("area_id")
            .withColumn("foot", F.sum("_qty").over(w).cast("bigint"))
            .drop("_qty"))


def standin_area_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area dimension before cleaning (x/y still projected metres)."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
            .join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(F.col("s_suppkey").alias("area_id"),
                    F.col("r_name").alias("area_type"),
                    F.col("s_name").alias("area_name"),
                    F.nullif(F.col("n_name"), F.lit(STANDIN_NO_DISTRICT)).alias("district"),
                    F.lit(None).cast("string").alias("neighbourhood"),
                    (F.lit(190000) + (F.col("s_suppkey") % 200) * 100).cast("double").alias("x"),
                    (F.lit(440000) + (F.col("s_suppkey") % 170) * 100).cast("double").alias("y")))


def standin_sources(spark: SparkSession, sf_dir: str, p: Params,
                    facts: DataFrame | None = None):
    """The four raw datasets (sales, stores, foot, area) as separate frames."""
    facts = standin_facts(spark, sf_dir, p) if facts is None else facts
    sales = facts.select("quarter", "area_id", "industry", "sales_amt", "sales_cnt",
                         "amt_20s", "amt_30s")
    stores = facts.select("quarter", "area_id", "industry", "stores", "opened", "closed")
    foot = facts.select("quarter", "area_id", "foot").distinct()
    return sales, stores, foot, standin_area_raw(spark, sf_dir)


def standin_master(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """A1 on the stand-in tables, fused.

    Sales, stores and foot come from one aggregate keyed (quarter, area,
    industry) — unique keys on every side — so the pipeline's two inner joins
    reduce to the conjunction of the three sources' filters; only the area
    dimension is joined.  ``tests/test_master.py`` checks this equals
    ``build_master`` over ``standin_sources``.
    """
    facts = (standin_facts(spark, sf_dir, p)
             .filter(sales_ok(p) & stores_ok(p) & foot_ok(p))
             .fillna(0, subset=["amt_20s", "amt_30s", "opened", "closed"]))
    area = clean_area(standin_area_raw(spark, sf_dir))
    return facts.join(area, "area_id", "inner").filter(area_ok(p)).select(*MASTER_COLUMNS)


def export_raw_csv(spark: SparkSession, sf_dir: str, out_dir: str, p: Params) -> str:
    """Write the stand-in sources as raw CSV folders in the source layout:
    ``sales_<year>.csv`` and ``stores_<year>.csv`` (one Korean-header year and
    one English-header year with re-ordered columns), ``foot_traffic.csv``
    and a CP949-encoded ``area.csv`` — the mix the ingest must handle."""
    from ..config import HEADER_ALIASES
    from .csv_sources import java_charsets
    ko = {c: pair[0] for c, pair in HEADER_ALIASES.items()}
    en = {c: pair[1] for c, pair in HEADER_ALIASES.items()}
    # the facts are written once; all four datasets are projections of them
    sales, stores, foot, area = standin_sources(spark, sf_dir, p, materialize(
        standin_facts(spark, sf_dir, p)))
    root = out_dir.rstrip("/")

    def dump(df: DataFrame, names: dict, path: str, encoding: str = "UTF-8", reverse=False):
        cols = list(reversed(df.columns)) if reverse else df.columns
        out = df.select(*[F.col(c).cast("string").alias(names[c]) for c in cols])
        (out.write.mode("overwrite").option("header", True).option("encoding", encoding)
         .csv(path))

    year = (F.col("quarter") / 10).cast("int")
    for i, (df, name) in enumerate(((sales, "sales"), (stores, "stores"))):
        for j, y in enumerate((p.year1, p.year2)):
            korean = (i + j) % 2 == 0
            dump(df.filter(year == y), ko if korean else en, f"{root}/{name}_{y}.csv",
                 reverse=not korean)
    dump(foot, ko, f"{root}/foot_traffic.csv")
    # two area files: CP949, and UTF-8 with a byte order mark in the header
    with java_charsets(spark):
        dump(area.filter("area_id % 2 = 0"), ko, f"{root}/area.csv/cp949", encoding="x-windows-949")
    marked = ko | {area.columns[0]: "\ufeff" + ko[area.columns[0]]}
    dump(area.filter("area_id % 2 = 1"), marked, f"{root}/area.csv/utf8")
    return root


def export_by_area(spark: SparkSession, sf_dir: str, out_dir: str, p: Params, files: int = 20) -> str:
    """The stand-in sales and stores as ``files`` CSV files each, one per
    remainder of area_id (``<dataset>/part=<k>/...``), in key order, the sales in
    CP949 with the Korean header and the stores in UTF-8 with the English one."""
    from ..config import HEADER_ALIASES
    from .csv_sources import java_charsets
    sales, stores, _, _ = standin_sources(spark, sf_dir, p, materialize(standin_facts(spark, sf_dir, p)))
    root = out_dir.rstrip("/")
    with java_charsets(spark):
        for df, name, encoding, side in ((sales, "sales", "x-windows-949", 0), (stores, "stores", "UTF-8", 1)):
            named = df.select((F.col("area_id") % files).alias("part"), *[
                F.col(c).cast("string").alias(HEADER_ALIASES[c][side]) for c in df.columns],
                F.col("quarter").alias("_q"), F.col("area_id").alias("_a"), F.col("industry").alias("_i"))
            keys = [HEADER_ALIASES[c][side] for c in df.columns]
            (named.repartition(files, "part").sortWithinPartitions("part", "_q", "_a", "_i")
             .select("part", *keys).write.mode("overwrite").option("header", True).option("encoding", encoding)
             .partitionBy("part").csv(f"{root}/{name}"))
    return root
