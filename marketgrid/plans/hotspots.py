"""Q2: proven ("mega") and emerging ("rising") hot spots over eight quarters.

A5 ``growth_metrics``: monthly sales per store per quarter for every
(area, industry), pivoted to eight columns (a missing quarter counts as 0),
half-year means, growth and the number of quarter-on-quarter rises.
A6 ``mega`` / A7 ``rising``: threshold bands, per-industry min-max scores,
top-k.  A9 ``tab2_hotplaces``: both lists with class tag and coordinates.

Scale notes.
* The master is already at (quarter, area, industry) grain, so the two
  aggregation levels share one hash partitioning on the pair keys
  (``repartition`` on the coarser keys satisfies both); a hot pair has at
  most one row per quarter.
* The per-industry min/max of the mega score is a groupBy (partial
  aggregation, one row per industry) joined back with a broadcast — its size
  is bounded by the industry list — instead of a window partitioned by
  industry, which would put a whole industry in one task.
* top-k is ``orderBy().limit()``, planned as TakeOrderedAndProject: each
  task keeps k rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (MEGA_COUNT_WEIGHT, MEGA_SPEED_WEIGHT, MEGA_TAG,
                      MEGA_VOLUME_WEIGHT, RISING_TAG, Params)
from ..functions.exprs import mean_of, minmax_scale, safe_div, up_count
from ..operators.lineage import materialize

PAIR = ["area_id", "area_name", "district", "industry"]
QCOLS = [f"q{i}" for i in range(1, 9)]


def growth_metrics(master: DataFrame, p: Params, places: bool = False) -> DataFrame:
    """A5; with ``places`` also lon and lat, which are the area's."""
    place = [F.max(c).alias(c) for c in ("lon", "lat")] if places else []
    qtr = (master.repartition(*PAIR)
           .groupBy(*PAIR, "quarter")
           .agg((safe_div(F.sum("sales_amt"), F.sum("stores")) / 3.0).alias("m_per_store"),
                F.avg("stores").alias("q_stores"), *place))
    qs = list(p.quarters)
    half = len(qs) // 2
    cols = [f"q{i}" for i in range(1, len(qs) + 1)]
    pivot = qtr.groupBy(*PAIR).agg(
        F.count_distinct("quarter").alias("n_quarters"),
        F.avg("q_stores").alias("avg_stores"), *place,
        *[F.coalesce(F.max(F.when(F.col("quarter") == q, F.col("m_per_store"))), F.lit(0.0))
          .alias(c) for q, c in zip(qs, cols)])
    h1, h2 = mean_of(cols[:half]), mean_of(cols[half:])
    return (pivot.filter(F.col("n_quarters") >= p.min_quarters)
            .withColumn("h1", h1).withColumn("h2", h2)
            .withColumn("abs_growth", F.col("h2") - F.col("h1"))
            .withColumn("growth_rate", safe_div("h2", "h1") - 1.0)
            .withColumn("up_count", up_count(cols).cast("bigint")))


def mega_candidates(metrics: DataFrame, p: Params) -> DataFrame:
    m = metrics.filter((F.col("avg_stores") >= p.mega_min_stores)
                       & (F.col("h1") >= p.mega_min_h1) & (F.col("growth_rate") > 0))
    ind = m.groupBy("industry").agg(
        F.min("abs_growth").alias("min_vol"), F.max("abs_growth").alias("max_vol"),
        F.min("growth_rate").alias("min_spd"), F.max("growth_rate").alias("max_spd"))
    n_steps = float(len(p.quarters) - 1)
    score = (minmax_scale("abs_growth", "min_vol", "max_vol") * MEGA_VOLUME_WEIGHT
             + minmax_scale("growth_rate", "min_spd", "max_spd") * MEGA_SPEED_WEIGHT
             + (F.col("up_count") / n_steps * 100) * MEGA_COUNT_WEIGHT)
    # one row per listed industry: the broadcast side is bounded by the list
    return m.join(F.broadcast(ind), "industry").withColumn("mega_score", score)


def rising_candidates(metrics: DataFrame, p: Params) -> DataFrame:
    (s_lo, s_hi), (h_lo, h_hi) = p.rising_stores, p.rising_h1
    return metrics.filter((F.col("avg_stores") >= s_lo) & (F.col("avg_stores") < s_hi)
                          & (F.col("h1") >= h_lo) & (F.col("h1") < h_hi)
                          & (F.col("growth_rate") >= p.rising_min_growth)
                          & (F.col("up_count") >= p.rising_min_up))


def _display(df: DataFrame, with_score: bool) -> DataFrame:
    cols = [
        "area_id", "area_name", "district", "industry",
        F.round("avg_stores", 1).alias("avg_stores"),
        F.round(F.col("h1") / 10000, 0).alias("h1_10k"),
        F.round(F.col("h2") / 10000, 0).alias("h2_10k"),
        F.round(F.col("growth_rate") * 100, 1).alias("growth_pct"),
        "up_count",
    ]
    if with_score:
        cols.append(F.round("mega_score", 2).alias("mega_score"))
    return df.select(*cols)


def mega(master: DataFrame, p: Params, metrics: DataFrame | None = None) -> DataFrame:
    """A6 (Q2-1): top-k mega hot spots by score (ties: area, industry)."""
    m = mega_candidates(metrics if metrics is not None else growth_metrics(master, p), p)
    top = m.orderBy(F.desc("mega_score"), "area_id", "industry").limit(p.top_k)
    return _display(top, True)


def rising(master: DataFrame, p: Params, metrics: DataFrame | None = None) -> DataFrame:
    """A7 (Q2-2): top-k rising hot spots by growth rate (ties: area, industry)."""
    r = rising_candidates(metrics if metrics is not None else growth_metrics(master, p), p)
    top = r.orderBy(F.desc("growth_rate"), "area_id", "industry").limit(p.top_k)
    return _display(top, False)


def tab2_hotplaces(master: DataFrame, p: Params) -> DataFrame:
    """Mega ∪ rising with class tag, raw figures and coordinates.

    The master is read once: the metrics carry the area's coordinates, and are
    written, since both lists and the mega scores' ranges read them.
    """
    metrics = materialize(growth_metrics(master, p, places=True))
    keep = ["area_id", "area_name", "district", "industry", "avg_stores", "h1", "h2",
            "growth_rate", "up_count", "lon", "lat"]
    mg = (mega_candidates(metrics, p).orderBy(F.desc("mega_score"), "area_id", "industry")
          .limit(p.top_k).select(*keep, F.lit(MEGA_TAG).alias("class"), "mega_score"))
    rs = (rising_candidates(metrics, p).orderBy(F.desc("growth_rate"), "area_id", "industry")
          .limit(p.top_k).select(*keep, F.lit(RISING_TAG).alias("class"),
                                 F.lit(None).cast("double").alias("mega_score")))
    return mg.unionByName(rs).select(
        "area_id", "area_name", "district", "industry", "class",
        F.round("avg_stores", 1).alias("avg_stores"), "h1", "h2", "growth_rate", "up_count",
        F.round("mega_score", 2).alias("mega_score"),
        F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"),
        F.round(F.col("h1") / 10000, 0).cast("bigint").alias("h1_10k"),
        F.round(F.col("h2") / 10000, 0).cast("bigint").alias("h2_10k"),
        F.round(F.col("growth_rate") * 100, 1).alias("growth_pct"))
