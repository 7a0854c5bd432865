"""Q3 data preparation: foot-traffic percentile, settlement label, features,
Tukey fences, candidate filter and the entry/score formula.

Plan shape.  The master (one row per quarter × area × industry) is read in
one pass:

* ``pair_stats``: one groupBy per (area, industry) with conditional
  aggregates per year and per quarter-of-year — means, sums, sample std,
  distinct quarters, last open quarter.  Every later per-pair, per-industry
  or per-area figure (label, both years' features, fences, active pairs) is
  derived from this table, which is 1/8 of the master and written once
  (``materialize``) so the many small branches below it re-read it instead of
  re-aggregating the master;
* the per-area foot percentile is derived from the pair table (per-quarter
  foot columns), so the master is read exactly once; the direct form
  ``foot_percentile(master)`` is kept for the standalone query and tested
  equal.

City-wide per-industry figures are groupBy(industry) tables (rows bounded by
the industry list, broadcast); city totals are one-row aggregates attached as
scalar subqueries; medians and quantiles come from
``operators.ranking`` (no group ever held by one task).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (ENTRY_DENSITY_WEIGHT, ENTRY_FOOT_TARGET, ENTRY_FOOT_WEIGHT, TUKEY_K,
                      Params)
from ..functions.exprs import clip_lower, quarter_of_year, quarter_year, safe_div
from ..operators.joins import attach_scalars
from ..operators.lineage import materialize
from ..operators.ranking import exact_median, exact_quantiles, pct_rank_average

FEATURES = ["mz_share", "rel_vitality", "rel_ticket", "store_lq", "cv"]
PAIR = ["area_id", "industry"]
PAIR_NAMES = ["area_id", "area_name", "area_type", "industry"]
YEARS = ("y1", "y2")


def with_year(master: DataFrame) -> DataFrame:
    return (master.fillna(0, subset=["sales_amt", "sales_cnt", "amt_20s", "amt_30s", "stores"])
            .withColumn("year", quarter_year("quarter"))
            .withColumn("qoy", quarter_of_year("quarter")))


def _qoys(quarters) -> list[int]:
    return sorted({q % 10 for q in quarters})


def pair_stats(master: DataFrame, p: Params) -> DataFrame:
    """One row per (area, industry): both years' figures in one aggregation."""
    df = with_year(master)
    aggs: list[Column] = []
    for sfx, year in zip(YEARS, (p.year1, p.year2)):
        c = F.col("year") == year

        def w(col: str, cond: Column = c) -> Column:
            return F.when(cond, F.col(col))

        aggs += [F.avg(w("sales_amt")).alias(f"amt_{sfx}"),
                 F.avg(w("sales_cnt")).alias(f"cnt_{sfx}"),
                 F.avg(w("amt_20s")).alias(f"amt20_{sfx}"),
                 F.avg(w("amt_30s")).alias(f"amt30_{sfx}"),
                 F.avg(w("stores")).alias(f"stores_{sfx}"),
                 F.sum(w("opened")).alias(f"opened_{sfx}"),
                 F.sum(w("closed")).alias(f"closed_{sfx}"),
                 F.stddev_samp(w("sales_amt")).alias(f"std_{sfx}")]
    # first-year sums per quarter-of-year (for the like-for-like revenue base)
    for k in _qoys(p.year1_quarters):
        c = (F.col("year") == p.year1) & (F.col("qoy") == k)
        aggs += [F.sum(F.when(c, F.col("sales_amt"))).alias(f"f_amt_{k}"),
                 F.sum(F.when(c, F.col("stores"))).alias(f"f_st_{k}"),
                 F.count(F.when(c, 1)).alias(f"f_n_{k}")]
    # second-year row counts per quarter-of-year (which quarters exist)
    for k in _qoys(p.year2_quarters):
        c = (F.col("year") == p.year2) & (F.col("qoy") == k)
        aggs.append(F.count(F.when(c, 1)).alias(f"n2_{k}"))
    # per-quarter foot traffic (an area-level value repeated on each pair),
    # second-year revenue sums and coordinates, so that nothing downstream
    # needs another pass over the master
    aggs += [F.max(F.when(F.col("quarter") == q, F.col("foot"))).alias(f"foot_{i}")
             for i, q in enumerate(p.quarters)]
    y2 = F.col("year") == p.year2
    aggs += [F.sum(F.when(y2, F.col("sales_amt"))).alias("s_amt_y2"),
             F.sum(F.when(y2, F.col("stores"))).alias("s_st_y2"),
             F.max("lon").alias("lon"), F.max("lat").alias("lat"),
             F.max("district").alias("district")]
    aggs += [F.max("quarter").alias("last_q"),
             F.max(F.when(F.col("stores") > 0, F.col("quarter"))).alias("last_open_q")]
    # distinct quarters per year as a sum of per-quarter presence flags: the
    # master only holds the listed quarters, and plain max() aggregates avoid
    # the row-expanding plan of count(distinct) next to other aggregates
    aggs += [F.max(F.when(F.col("quarter") == q, 1).otherwise(0)).alias(f"_has_{i}")
             for i, q in enumerate(p.quarters)]
    out = df.groupBy(*PAIR_NAMES).agg(*aggs)
    for sfx, year in zip(YEARS, (p.year1, p.year2)):
        flags = [F.col(f"_has_{i}") for i, q in enumerate(p.quarters) if q // 10 == year]
        out = out.withColumn(f"nq_{sfx}", sum(flags, F.lit(0)).cast("bigint"))
    return out.drop(*[f"_has_{i}" for i in range(len(p.quarters))])


def area_foot_percentile(pairs: DataFrame, p: Params) -> DataFrame:
    """A10 from the pair table: per area and quarter the peak foot traffic
    is the max over the area's pairs; its mean over the quarters present,
    then the average-tie percent rank over all areas."""
    n = len(p.quarters)
    per_area = pairs.groupBy("area_id").agg(*[F.max(f"foot_{i}").alias(f"f{i}") for i in range(n)])
    total = sum((F.coalesce(F.col(f"f{i}"), F.lit(0)) for i in range(n)), F.lit(0))
    present = sum((F.col(f"f{i}").isNotNull().cast("int") for i in range(n)), F.lit(0))
    avg = per_area.select("area_id", (total / present).alias("avg_foot"))
    return pct_rank_average(avg, "avg_foot", [], "foot_pct")


def foot_percentile(master: DataFrame, write: bool = True) -> DataFrame:
    """A10: mean over quarters of the per-quarter peak foot traffic per area,
    then its average-tie percent rank over all areas."""
    per_q = master.groupBy("area_id", "quarter").agg(F.max("foot").alias("q_foot"))
    avg = per_q.groupBy("area_id").agg(F.avg("q_foot").alias("avg_foot"))
    if write:
        avg = materialize(avg)
    return pct_rank_average(avg, "avg_foot", [], "foot_pct")


@dataclass
class Q3Base:
    """The inputs of the Q3 chain: the written pair table, and the foot
    percentile, a join of written ranks with a small sum over the pairs."""
    pairs: DataFrame
    foot: DataFrame

    @classmethod
    def build(cls, master: DataFrame, p: Params) -> "Q3Base":
        """One pass over the master."""
        pairs = materialize(pair_stats(master, p))
        return cls(pairs, area_foot_percentile(pairs, p))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a per-industry table (rows bounded by the industry list)."""
    return F.broadcast(df)


def _y2_quarter_count(pairs: DataFrame, p: Params) -> DataFrame:
    """One row: number of distinct second-year quarters-of-year present, and
    a 0/1 flag per first-year quarter-of-year telling whether it exists in
    the second year."""
    ks2 = _qoys(p.year2_quarters)
    present = pairs.agg(*[F.max(F.when(F.col(f"n2_{k}") > 0, 1).otherwise(0)).alias(f"has2_{k}")
                          for k in ks2])
    nq2 = sum((F.col(f"has2_{k}") for k in ks2), F.lit(0)).cast("bigint").alias("nq2")
    flags = [(F.col(f"has2_{k}") if k in ks2 else F.lit(0)).alias(f"avail_{k}")
             for k in _qoys(p.year1_quarters)]
    return present.select(nq2, *flags)


def settle_label(pairs: DataFrame, p: Params) -> DataFrame:
    """The cohort's yearly figures and the 0/1 settlement label."""
    scal = _y2_quarter_count(pairs, p)
    cohort = pairs.filter(F.col("nq_y1") == len(p.year1_quarters))

    raw2 = pairs.filter(F.col("nq_y2") > 0)
    city = (attach_scalars(raw2, scal).groupBy("industry")
            .agg(F.sum("closed_y2").alias("city_closed"),
                 F.sum(F.col("stores_y2") * F.col("nq2")).alias("city_store_years"))
            .select("industry",
                    safe_div("city_closed", "city_store_years").alias("city_close_rate")))
    ml = attach_scalars(cohort.join(_bounded(city), "industry", "inner"), scal)

    ks = _qoys(p.year1_quarters)
    def matched(c: str) -> Column:
        return sum((F.col(f"avail_{k}") * F.coalesce(F.col(f"{c}_{k}"), F.lit(0)) for k in ks),
                   F.lit(0))

    s_amt, s_st, s_n = matched("f_amt"), matched("f_st"), matched("f_n")
    fair = safe_div(safe_div(s_amt, s_n), safe_div(s_st, s_n))

    per_store_y2 = safe_div("amt_y2", "stores_y2")
    survival = safe_div("closed_y2", F.col("stores_y2") * F.col("nq2")) <= F.col("city_close_rate")
    persist = F.col("stores_y2") >= F.col("stores_y1") * p.persist_ratio
    revenue = per_store_y2 >= F.col("fair_per_store_y1") * p.revenue_ratio
    return (ml.withColumn("fair_per_store_y1", fair)
            .withColumn("per_store_y2", per_store_y2)
            .withColumn("target", F.when(survival & persist & revenue, 1).otherwise(0)))


def _industry_ratio(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    """sum(num)/sum(den) per industry, null unless sum(den) > 0."""
    return df.groupBy("industry").agg(
        F.when(F.sum(den) > 0, F.sum(num) / F.sum(den)).alias(name))


def _fill_median(df: DataFrame, c: str) -> DataFrame:
    med = exact_median(df, c, name="_med")
    return attach_scalars(df, med).withColumn(c, F.coalesce(F.col(c), F.col("_med"))).drop("_med")


def _year_features(base: DataFrame, year_rows: DataFrame, foot: DataFrame, sfx: str) -> DataFrame:
    """Shared feature block: ``base`` rows get the five features computed
    against city figures of ``year_rows`` (all pairs active that year)."""
    amt, cnt, st = f"amt_{sfx}", f"cnt_{sfx}", f"stores_{sfx}"
    ind = (year_rows.groupBy("industry").agg(
        F.when(F.sum(cnt) > 0, F.sum(amt) / F.sum(cnt)).alias("city_ticket"),
        F.when(F.sum(st) > 0, F.sum(cnt) / F.sum(st)).alias("city_vitality"),
        F.sum(st).alias("ind_stores")))
    total = year_rows.agg(F.sum(st).alias("city_stores"))
    ind = attach_scalars(ind, total).select(
        "industry", "city_ticket", "city_vitality",
        safe_div("ind_stores", "city_stores").alias("city_share"))
    area_st = year_rows.groupBy("area_id").agg(F.sum(st).alias("area_stores"))
    c = (base.join(foot, "area_id", "inner").join(_bounded(ind), "industry")
         .join(area_st, "area_id", "inner"))
    ticket, vitality = safe_div(amt, cnt), safe_div(cnt, st)
    share = safe_div(st, "area_stores")
    c = c.withColumns({
        "mz_share": safe_div(F.col(f"amt20_{sfx}") + F.col(f"amt30_{sfx}"), amt),
        "ticket": ticket,
        "rel_ticket": safe_div(ticket, "city_ticket"),
        "vitality": vitality,
        "rel_vitality": safe_div(vitality, "city_vitality"),
        "density": F.col("area_stores") / (F.col("avg_foot") + 1),
        "share_in_area": share,
        "store_lq": safe_div(share, "city_share"),
        "cv": safe_div(f"std_{sfx}", amt),
    })
    # written once: the feature table feeds several quantile passes and joins
    return materialize(_fill_median(c, "cv"))


def train_features(base: Q3Base, p: Params) -> DataFrame:
    """Label table plus the five model features from the first year."""
    ml = settle_label(base.pairs, p)
    return _year_features(ml, base.pairs.filter(F.col("nq_y1") > 0), base.foot, "y1")


def train_set(features: DataFrame, p: Params) -> DataFrame:
    """Alley areas with at least ``min_pair_stores`` stores, no null."""
    t = features.filter((F.col("area_type") == p.alley_type)
                        & (F.col("stores_y1") >= p.min_pair_stores))
    return t.dropna(subset=["target", *FEATURES])


def infer_features(base: Q3Base, p: Params) -> DataFrame:
    """The same features from the second year, for every pair."""
    cur = base.pairs.filter(F.col("nq_y2") > 0)
    c = _year_features(cur, cur, base.foot, "y2")
    return (c.withColumnRenamed("amt_y2", "amt").withColumnRenamed("cnt_y2", "cnt")
            .withColumnRenamed("stores_y2", "stores"))


def industry_fences(alley: DataFrame, p: Params) -> DataFrame:
    """Per-industry Tukey fences on sales per store and ticket size."""
    # both measures in one rank pass: groups are (industry, measure)
    long = alley.unpivot(["industry"], ["sales_per_store", "ticket"], "_m", "_v")
    q = exact_quantiles(long, "_v", [0.25, 0.75], ["industry", "_m"], ["_q1", "_q3"])

    def pick(m: str, c: str) -> Column:
        return F.max(F.when(F.col("_m") == m, F.col(c)))

    f = q.groupBy("industry").agg(pick("sales_per_store", "_q1").alias("sps_q1"),
                                  pick("sales_per_store", "_q3").alias("sps_q3"),
                                  pick("ticket", "_q1").alias("tk_q1"),
                                  pick("ticket", "_q3").alias("tk_q3"))
    iqr_s, iqr_t = F.col("sps_q3") - F.col("sps_q1"), F.col("tk_q3") - F.col("tk_q1")
    return f.select(
        "industry", "sps_q1", "sps_q3",
        (F.col("sps_q3") + TUKEY_K * iqr_s).alias("sales_upper"),
        "tk_q1", "tk_q3",
        clip_lower(F.col("tk_q1") - TUKEY_K * iqr_t, p.ticket_floor).alias("ticket_lower"),
        (F.col("tk_q3") + TUKEY_K * iqr_t).alias("ticket_upper"))


def alley_rows(cur: DataFrame, p: Params) -> DataFrame:
    return (cur.filter(F.col("area_type") == p.alley_type)
            .withColumn("sales_per_store", safe_div("amt", "stores")))


def active_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs open (stores > 0) in the latest quarter of the data."""
    latest = pairs.agg(F.max("last_q").alias("_latest"))
    return (attach_scalars(pairs, latest)
            .filter(F.col("last_open_q") == F.col("_latest")).select(*PAIR))


def area_fence(alley: DataFrame) -> DataFrame:
    """One-row fence on the total stores of the distinct remaining areas."""
    areas = alley.select("area_id", "area_stores").distinct()
    aq = exact_quantiles(areas, "area_stores", [0.25, 0.75], [], ["as_q1", "as_q3"])
    return aq.withColumn("area_stores_upper",
                         F.col("as_q3") + TUKEY_K * (F.col("as_q3") - F.col("as_q1")))


def tukey_fences(base: Q3Base, p: Params, cur: DataFrame | None = None):
    """(alley rows with all fences, industry fences, area fence).

    Industry fences are computed over all alley rows *before* the active-pair
    filter; the area fence over distinct areas *after* it.
    """
    cur = cur if cur is not None else infer_features(base, p)
    alley = alley_rows(cur, p)
    fences = industry_fences(alley, p)
    alley = alley.join(_bounded(fences), "industry", "left")
    alley = alley.join(active_pairs(base.pairs), PAIR, "left_semi")
    af = area_fence(alley)
    return attach_scalars(alley, af), fences, af


def candidates(base: Q3Base, p: Params, cur: DataFrame | None = None) -> DataFrame:
    """The eight candidate conditions plus no null feature."""
    a = tukey_fences(base, p, cur)[0]
    c = F.col
    keep = ((c("foot_pct") >= p.min_foot_pct) & (c("stores") >= p.min_pair_stores)
            & (c("area_stores") <= c("area_stores_upper"))
            & (c("sales_per_store") >= p.min_sales_per_store)
            & (c("sales_per_store") <= c("sales_upper"))
            & (c("ticket") >= c("ticket_lower")) & (c("ticket") <= c("ticket_upper"))
            & (c("mz_share") >= p.min_mz_share))
    return a.filter(keep).dropna(subset=FEATURES)


def require_candidates(found: DataFrame) -> DataFrame:
    """The candidates, written once; ValueError if no pair meets all
    conditions, as there is nothing to rank then."""
    found = materialize(found)
    if found.isEmpty():
        raise ValueError("no candidate meets all conditions")
    return found


def recommend(scored: DataFrame) -> DataFrame:
    """entry = (1 − minmax(density))·0.7 + max(0, 1 − |pct − 0.65|/0.65)·0.3;
    score = fit · entry.  ``scored`` carries a ``fit`` column (model output)."""
    mm = scored.agg(F.min("density").alias("_lo"), F.max("density").alias("_hi"))
    s = attach_scalars(scored, mm)
    comp = F.when(F.col("_hi") > F.col("_lo"),
                  (F.col("density") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
                  ).otherwise(F.col("density") * 0)
    foot_fit = clip_lower(1 - F.abs(F.col("foot_pct") - ENTRY_FOOT_TARGET) / ENTRY_FOOT_TARGET, 0.0)
    entry = (1 - comp) * ENTRY_DENSITY_WEIGHT + foot_fit * ENTRY_FOOT_WEIGHT
    return (s.withColumn("entry", entry)
            .withColumn("score", F.col("fit") * F.col("entry"))
            .select("area_id", "area_name", "industry", "mz_share", "rel_vitality", "store_lq",
                    "density", "fit", "entry", "score", "foot_pct"))
