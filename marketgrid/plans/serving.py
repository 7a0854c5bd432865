"""Serving tables and dashboard figures.

* ``tab3_map`` (A18): ranking ⋈ coordinates ⋈ second-year monthly revenue per
  store; rows without coordinates dropped.
* ``filtered_view`` (A19): revenue cap (default: integer part of the exact
  95th percentile of revenue), industry list, minimum fit.
* ``threshold_slices`` (A20): counts and mean fit at fit ≥ 0, .3, .5, .7.
* ``kpi_leaders`` (T4) and ``kpi_means`` (G18): the summary cards.

The ranking and hot-spot lists are small by construction (candidates after
eight filters; top-k lists), but the joins are still planned from the large
side: coordinates and revenue are aggregated only for the areas/pairs in the
list (semi-join first), so nothing scales with the master here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FIT_SLICES, MEGA_TAG, RISING_TAG, Params
from ..functions.exprs import safe_div
from ..operators.joins import attach_scalars
from ..operators.lineage import materialize
from ..operators.ranking import exact_median, exact_quantiles


def tab3_map(pairs: DataFrame, ranking: DataFrame, p: Params) -> DataFrame:
    """A18 from the pair table: coordinates per area, second-year monthly
    revenue per store per pair, joined to the (small) ranking."""
    keys = ranking.select("area_id", "industry")
    areas = keys.select("area_id").distinct()
    coords = (pairs.join(areas, "area_id", "left_semi").groupBy("area_id")
              .agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"),
                   F.max("district").alias("district")))
    rev = (pairs.join(keys, ["area_id", "industry"], "left_semi")
           .select("area_id", "industry",
                   F.round(safe_div("s_amt_y2", "s_st_y2") / 3.0 / 1e4, 0)
                   .alias("monthly_per_store_10k")))
    t = (ranking.join(coords, "area_id", "left")
         .join(rev, ["area_id", "industry"], "left")
         .filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()))
    t = t.select("area_id", "area_name", "district", "industry", "lon", "lat",
                 "monthly_per_store_10k", "mz_share", "rel_vitality", "store_lq", "density",
                 "fit", "entry", "score")
    # the serving table is written once; the dashboard figures all read it
    return materialize(t)


def dashboard_frame(tab3: DataFrame) -> DataFrame:
    """The dashboard's loaded view: entry null -> median, revenue null -> 0."""
    med = exact_median(tab3, "entry", name="_med_entry")
    return (attach_scalars(tab3, med)
            .withColumn("entry", F.coalesce("entry", "_med_entry")).drop("_med_entry")
            .fillna(0.0, subset=["monthly_per_store_10k"]))


def revenue_cap(view: DataFrame, q: float = 0.95) -> DataFrame:
    """One row: integer part of the exact q-quantile of monthly revenue."""
    cap = exact_quantiles(view, "monthly_per_store_10k", [q], [], ["_q"])
    return cap.select(F.floor("_q").cast("bigint").alias("cap"))


def filtered_view(tab3: DataFrame, cap: float | None = None,
                  industries: Sequence[str] | None = None, min_fit: float = 0.0) -> DataFrame:
    v = dashboard_frame(tab3)
    v = attach_scalars(v, revenue_cap(v)) if cap is None else v.withColumn("cap", F.lit(cap))
    cond = ((F.col("monthly_per_store_10k") > 0)
            & (F.col("monthly_per_store_10k") <= F.col("cap"))
            & (F.col("fit") >= min_fit))
    if industries is not None:
        cond = cond & F.col("industry").isin(list(industries))
    return v.filter(cond).drop("cap")


def filtered_kpis(tab3: DataFrame, cap: float | None = None,
                  industries: Sequence[str] | None = None, min_fit: float = 0.0) -> DataFrame:
    """The cards above the map: candidates before the filter, rows after it,
    their mean fit and mean entry."""
    before = dashboard_frame(tab3).agg(F.count(F.lit(1)).alias("n_before"))
    after = filtered_view(tab3, cap, industries, min_fit).agg(
        F.count(F.lit(1)).alias("n_after"), F.avg("fit").alias("mean_fit"),
        F.avg("entry").alias("mean_entry"))
    return attach_scalars(before, after)


def hotplace_bubbles(tab2: DataFrame, least: float = 300.0) -> DataFrame:
    """One bubble per hot spot with coordinates: first-year revenue, clipped."""
    return (tab2.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
            .select("area_id", "industry", "class", "lon", "lat",
                    F.greatest(F.col("h1_10k").cast("double"), F.lit(least)).alias("bubble_size")))


def map_markers(tab3: DataFrame) -> DataFrame:
    """One marker per recommended row with revenue: size from entry, colour
    from fit."""
    return (dashboard_frame(tab3).filter(F.col("monthly_per_store_10k") > 0)
            .select("area_id", "industry", "lon", "lat", "fit",
                    (F.col("entry") * 25 + 5).alias("marker_size")))


def threshold_slices(tab3: DataFrame, thresholds: Sequence[float] = FIT_SLICES) -> DataFrame:
    yo = dashboard_frame(tab3).filter(F.col("monthly_per_store_10k") > 0)
    ths = [float(t) for t in thresholds]
    return yo.agg(*[F.sum(F.when(F.col("fit") >= t, 1).otherwise(0)).alias(f"n_{i}")
                    for i, t in enumerate(ths)],
                  *[F.avg(F.when(F.col("fit") >= t, F.col("fit"))).alias(f"m_{i}")
                    for i, t in enumerate(ths)]).select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"),
                                     F.col(f"n_{i}").cast("bigint").alias("n_rows"),
                                     F.col(f"m_{i}").alias("mean_fit"))
                            for i, t in enumerate(ths)])).alias("s")).select("s.*")


def kpi_leaders(tab1: DataFrame) -> DataFrame:
    """T4: leading district per metric (ties: district name)."""
    metrics = ("total_amt_100m", "amt_per_store_100m", "avg_foot_10k")
    best = tab1.agg(*[F.max(F.col(m)).alias(m) for m in metrics])
    tops = attach_scalars(tab1, best.select(*[F.col(m).alias(f"_{m}") for m in metrics])).agg(
        *[F.struct(F.min(F.when(F.col(m) == F.col(f"_{m}"), F.col("district"))).alias("district"),
                   F.max(m).cast("double").alias("value")).alias(m) for m in metrics])
    return tops.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}.district").alias("district"),
                 F.col(f"{m}.value").alias("value")) for m in metrics])).alias("r")).select("r.*")


def kpi_means(tab1: DataFrame, tab2: DataFrame, tab3: DataFrame) -> DataFrame:
    """The card figures of the three tabs, as (kpi, value) rows."""
    a = tab1.agg(F.count(F.lit(1)).cast("double").alias("n_districts"))
    b = tab2.agg(
        F.sum(F.when(F.col("class") == MEGA_TAG, 1).otherwise(0)).cast("double").alias("n_mega"),
        F.sum(F.when(F.col("class") == RISING_TAG, 1).otherwise(0)).cast("double").alias("n_rising"),
        F.avg(F.when(F.col("class") == MEGA_TAG, F.col("growth_pct"))).alias("mega_mean_growth_pct"),
        F.avg(F.when(F.col("class") == RISING_TAG, F.col("growth_pct"))).alias("rising_mean_growth_pct"))
    v = dashboard_frame(tab3)
    yo = v.filter(F.col("monthly_per_store_10k") > 0)
    c = v.agg(F.count(F.lit(1)).cast("double").alias("n_candidates"))
    d = yo.agg(F.count(F.lit(1)).cast("double").alias("n_recommended"),
               F.avg("fit").alias("mean_fit"))
    e = filtered_view(tab3).agg(F.avg("entry").alias("mean_entry"))
    row = attach_scalars(attach_scalars(attach_scalars(attach_scalars(a, b), c), d), e)
    names = ["n_districts", "n_mega", "n_rising", "mega_mean_growth_pct", "rising_mean_growth_pct",
             "n_candidates", "n_recommended", "mean_fit", "mean_entry"]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("kpi"), F.col(n).alias("value")) for n in names])).alias("k")
    ).select("k.*")


def top_recommendations(tab3: DataFrame, n: int = 15, digits: int = 3) -> DataFrame:
    """The top-n table by score, ties by key, figures rounded for
    display (n is the feature here: a top-k report)."""
    v = dashboard_frame(tab3).filter(F.col("monthly_per_store_10k") > 0)
    top = v.orderBy(F.desc("score"), "area_id", "industry").limit(n)
    return top.select("area_id", "area_name", "district", "industry", "monthly_per_store_10k",
                      *[F.round(c, digits).alias(c) for c in
                        ("mz_share", "fit", "entry", "score")])


def chart_ranges(tab2: DataFrame, tab3: DataFrame, axis_pad: float = 1.08,
                 min_bubble: float = 300.0) -> DataFrame:
    """The chart derivations as one row — axis maximum of the
    first-year/second-year scatter (max of both × 1.08), the smallest
    bubble after clipping at 300, the fit colour range, and the marker size
    range (entry·25 + 5) of the map."""
    a = tab2.agg((F.greatest(F.max("h1_10k"), F.max("h2_10k")) * axis_pad).alias("axis_max"),
                 F.min(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(),
                              F.greatest(F.col("h1_10k"), F.lit(min_bubble)))).alias("min_bubble"))
    yo = dashboard_frame(tab3).filter(F.col("monthly_per_store_10k") > 0)
    b = yo.agg(F.min(F.col("entry") * 25 + 5).alias("marker_min"),
               F.max(F.col("entry") * 25 + 5).alias("marker_max"))
    c = filtered_view(tab3).agg(F.min("fit").alias("fit_min"), F.max("fit").alias("fit_max"))
    return attach_scalars(attach_scalars(a, b), c)
