"""SQL access to the analysis tables through temporary views.

The texts take their thresholds as named arguments (``spark.sql(text, args)``),
so a value is never pasted into SQL and one text serves all thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import UNKNOWN, Params

MASTER_VIEW = "commercial_master"
RESULT_VIEW = "recommendation_result"


def register_views(master: DataFrame, result: DataFrame | None = None) -> None:
    master.createOrReplaceTempView(MASTER_VIEW)
    if result is not None:
        result.createOrReplaceTempView(RESULT_VIEW)


#: The landmark industry of each district (A4) for SQL users; the DataFrame
#: form is ``plans.district.landmark_lq``.
LANDMARK_SQL = f"""
WITH cell AS (
  SELECT district, industry, SUM(sales_amt) AS rev, SUM(stores) AS st
  FROM {MASTER_VIEW} WHERE district IS NOT NULL AND district <> '{UNKNOWN}'
  GROUP BY district, industry
), margin AS (
  SELECT *, SUM(rev) OVER (PARTITION BY district) AS d_rev, SUM(st) OVER (PARTITION BY district) AS d_st,
         SUM(rev) OVER (PARTITION BY industry) AS i_rev, SUM(st) OVER (PARTITION BY industry) AS i_st
  FROM cell
), quotient AS (
  SELECT district, industry, (rev / d_rev) / (i_rev / (SELECT SUM(rev) FROM cell)) AS by_rev,
         (st / d_st) / (i_st / (SELECT SUM(st) FROM cell)) AS by_st
  FROM margin
), best AS (
  SELECT district, MIN_BY(STRUCT(industry, by_rev, by_st),
                          STRUCT(-(0.7D * by_rev + 0.3D * by_st) AS w, industry)) AS top
  FROM quotient GROUP BY district
)
SELECT district, top.industry AS landmark_industry,
       ROUND(0.7D * top.by_rev + 0.3D * top.by_st, 2) AS lq,
       ROUND(top.by_rev, 2) AS rev_lq, ROUND(top.by_st, 2) AS store_lq
FROM best ORDER BY lq DESC, district"""


#: Monthly sales per store of a pair's eight quarters (a missing one is 0),
#: half-year means and rises (A5), for the two texts below.
GROWTH_SQL = f"""
WITH quarterly AS (
  SELECT area_id, area_name, district, industry, quarter, AVG(stores) AS n_stores,
         try_divide(SUM(sales_amt), SUM(stores)) / 3.0D AS per_store
  FROM {MASTER_VIEW} GROUP BY area_id, area_name, district, industry, quarter
), series AS (
  SELECT area_id, area_name, district, industry, AVG(n_stores) AS avg_stores,
         MAP_FROM_ENTRIES(COLLECT_LIST(STRUCT(quarter, COALESCE(per_store, 0.0D)))) AS seen
  FROM quarterly GROUP BY area_id, area_name, district, industry HAVING COUNT(*) >= :min_quarters
), filled AS (
  SELECT area_id, area_name, district, industry, avg_stores,
         TRANSFORM(:quarters, q -> COALESCE(seen[q], 0.0D)) AS v
  FROM series
), growth AS (
  SELECT area_id, area_name, district, industry, avg_stores,
         (v[0] + v[1] + v[2] + v[3]) / 4 AS h1, (v[4] + v[5] + v[6] + v[7]) / 4 AS h2,
         CAST(SIZE(FILTER(v, (x, i) -> i > 0 AND x > v[i - 1])) AS BIGINT) AS up_count
  FROM filled
), measured AS (
  SELECT *, h2 - h1 AS abs_growth, try_divide(h2, h1) - 1.0D AS growth_rate FROM growth
)"""

_SHOWN = """area_id, area_name, district, industry, ROUND(avg_stores, 1) AS avg_stores,
       ROUND(h1 / 10000, 0) AS h1_10k, ROUND(h2 / 10000, 0) AS h2_10k,
       ROUND(growth_rate * 100, 1) AS growth_pct, up_count"""

MEGA_SQL = GROWTH_SQL + f""", proven AS (
  SELECT * FROM measured WHERE avg_stores >= :min_stores AND h1 >= :min_h1 AND growth_rate > 0
), ranges AS (
  SELECT industry, MIN(abs_growth) AS vol_lo, MAX(abs_growth) AS vol_hi,
         MIN(growth_rate) AS rate_lo, MAX(growth_rate) AS rate_hi
  FROM proven GROUP BY industry
), rated AS (
  SELECT p.*, COALESCE((abs_growth - vol_lo) / NULLIF(vol_hi - vol_lo, 0) * 100, 50.0D) * 0.6D
              + COALESCE((growth_rate - rate_lo) / NULLIF(rate_hi - rate_lo, 0) * 100, 50.0D) * 0.2D
              + up_count / 7.0D * 100 * 0.2D AS rating
  FROM proven p JOIN ranges r ON r.industry = p.industry
)
SELECT {_SHOWN}, ROUND(rating, 2) AS mega_score
FROM rated ORDER BY rating DESC, area_id, industry LIMIT :k"""

RISING_SQL = GROWTH_SQL + f"""
SELECT {_SHOWN} FROM measured
WHERE avg_stores >= :stores_from AND avg_stores < :stores_below AND h1 >= :h1_from AND h1 < :h1_below
  AND growth_rate >= :min_growth AND up_count >= :min_up
ORDER BY growth_rate DESC, area_id, industry LIMIT :k"""

RESULT_SQL = f"""
WITH places AS (
  SELECT area_id, MAX(district) AS district FROM {MASTER_VIEW} GROUP BY area_id
)
SELECT district, COUNT(*) AS n_pairs,
       MIN_BY(STRUCT(r.area_id, r.industry), STRUCT(-r.score AS s, r.area_id AS a, r.industry AS i)) AS best,
       ROUND(MAX(r.score), 9) AS best_score
FROM {RESULT_VIEW} r JOIN places p ON p.area_id = r.area_id
GROUP BY district HAVING COUNT(*) >= :least"""


def _growth_args(spark: SparkSession, p: Params) -> dict:
    from pyspark.sql import functions as F
    if len(p.quarters) != 8:
        raise ValueError("the text has two halves of four quarters")
    return {"quarters": F.array(*map(F.lit, p.quarters)), "min_quarters": p.min_quarters, "k": p.top_k}


def mega_by_sql(spark: SparkSession, p: Params) -> DataFrame:
    """A6 from SQL text, equal to ``plans.hotspots.mega``."""
    return spark.sql(MEGA_SQL, _growth_args(spark, p) | {"min_stores": p.mega_min_stores, "min_h1": p.mega_min_h1})


def rising_by_sql(spark: SparkSession, p: Params) -> DataFrame:
    """A7 from SQL text, equal to ``plans.hotspots.rising``."""
    (s_lo, s_hi), (h_lo, h_hi) = p.rising_stores, p.rising_h1
    return spark.sql(RISING_SQL, _growth_args(spark, p) | {
        "stores_from": s_lo, "stores_below": s_hi, "h1_from": h_lo, "h1_below": h_hi,
        "min_growth": p.rising_min_growth, "min_up": p.rising_min_up})


def result_by_sql(spark: SparkSession, least: int = 1) -> DataFrame:
    """Per district with ``least`` recommended pairs or more their number and
    the best one."""
    return spark.sql(RESULT_SQL, {"least": least}).select("district", "n_pairs", "best.area_id", "best.industry",
                                                          "best_score")
