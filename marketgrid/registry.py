"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query rebuilds what it needs from the driver's tables in ``sf_dir``
(through the stand-in master), so its work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import STANDIN
from .plans import district, hotspots, model, serving, settlement
from .functions.exprs import safe_div
from .operators.joins import attach_scalars
from .operators.lineage import materialize
from .sources.standin import standin_master

P = STANDIN
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy master: for queries that read it once."""
    return standin_master(spark, sf_dir, P)


def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master written once to the checkpoint folder: for queries that read it
    many times (the Q3 chain reads it for labels, features, fences, ranks)."""
    return materialize(standin_master(spark, sf_dir, P))


@query("master_build")
def q_master_build(spark, sf_dir):
    m = master(spark, sf_dir)
    return m.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


@query("district_scale")
def q_district_scale(spark, sf_dir):
    return district.district_scale(master(spark, sf_dir))


@query("district_efficiency")
def q_district_efficiency(spark, sf_dir):
    return district.district_efficiency(master(spark, sf_dir))


@query("landmark_lq")
def q_landmark_lq(spark, sf_dir):
    return district.landmark_lq(master(spark, sf_dir))


@query("tab1_gu_summary")
def q_tab1_gu_summary(spark, sf_dir):
    return district.tab1_gu_summary(master(spark, sf_dir))


@query("growth_metrics")
def q_growth_metrics(spark, sf_dir):
    return hotspots.growth_metrics(master(spark, sf_dir), P)


@query("mega_hotspots")
def q_mega(spark, sf_dir):
    return hotspots.mega(master(spark, sf_dir), P)


@query("rising_hotspots")
def q_rising(spark, sf_dir):
    return hotspots.rising(master(spark, sf_dir), P)


@query("tab2_hotplaces")
def q_tab2(spark, sf_dir):
    return hotspots.tab2_hotplaces(master(spark, sf_dir), P)


# --- Q3 ---------------------------------------------------------------------

#: Columns of the published result.
RESULT_COLUMNS = ["area_id", "area_name", "industry", "mz_share", "rel_vitality", "store_lq", "density", "fit",
                  "entry", "score"]
R9 = 9  # ratios near 1
R4 = 4  # money-scale values (cents)


def _r(c: str, nd: int = R9):
    return F.round(c, nd).alias(c)


_FEAT = ["mz_share", "rel_vitality", "rel_ticket", "store_lq", "cv", "density"]


def q3_base(spark: SparkSession, sf_dir: str, m: DataFrame | None = None):
    """Q3 reads the master once (pair statistics), so it stays lazy here."""
    m = m if m is not None else master(spark, sf_dir)
    return m, settlement.Q3Base.build(m, P)


@query("foot_percentile")
def q_foot_percentile(spark, sf_dir):
    return settlement.foot_percentile(master(spark, sf_dir)).select("area_id", "avg_foot",
                                                                    "foot_pct")


@query("settle_label")
def q_settle_label(spark, sf_dir):
    ps = materialize(settlement.pair_stats(master(spark, sf_dir), P))  # read three times
    t = settlement.settle_label(ps, P)
    return t.select("area_id", "area_name", "area_type", "industry", "stores_y1", "stores_y2",
                    "closed_y2", "per_store_y2", "fair_per_store_y1", _r("city_close_rate"),
                    "target")


@query("train_features")
def q_train_features(spark, sf_dir):
    _, base = q3_base(spark, sf_dir)
    t = settlement.train_features(base, P)
    return t.select("area_id", "industry", "area_type", "stores_y1", "target", "foot_pct",
                    *[_r(c) for c in _FEAT])


def _train(base) -> DataFrame:
    return settlement.train_set(settlement.train_features(base, P), P)


@query("train_set")
def q_train_set(spark, sf_dir):
    t = _train(q3_base(spark, sf_dir)[1])
    return t.select("area_id", "industry", "target", *[_r(c) for c in _FEAT])


@query("infer_features")
def q_infer_features(spark, sf_dir):
    t = settlement.infer_features(q3_base(spark, sf_dir)[1], P)
    return t.select("area_id", "industry", "area_type", "stores", "foot_pct", _r("area_stores"),
                    _r("ticket", R4), *[_r(c) for c in _FEAT])


@query("tukey_fences")
def q_tukey_fences(spark, sf_dir):
    _, fences, af = settlement.tukey_fences(q3_base(spark, sf_dir)[1], P)
    return attach_scalars(fences, af).select(
        "industry", *[_r(c, R4) for c in ["sps_q1", "sps_q3", "sales_upper", "tk_q1", "tk_q3",
                                          "ticket_lower", "ticket_upper"]],
        *[_r(c) for c in ["as_q1", "as_q3", "area_stores_upper"]])


@query("candidate_filter")
def q_candidate_filter(spark, sf_dir):
    c = settlement.candidates(q3_base(spark, sf_dir)[1], P)
    return c.select("area_id", "industry", "stores", _r("area_stores"), _r("sales_per_store", R4),
                    _r("ticket", R4), "foot_pct", *[_r(x) for x in _FEAT])


def prior_ranking(base) -> DataFrame:
    cand = model.prior_fit(_train(base), settlement.candidates(base, P))
    return settlement.recommend(cand)


@query("recommend_ranking")
def q_recommend_ranking(spark, sf_dir):
    r = prior_ranking(q3_base(spark, sf_dir)[1])
    return r.select("area_id", "area_name", "industry",
                    *[_r(c) for c in ["mz_share", "rel_vitality", "store_lq", "density", "fit",
                                      "entry", "score"]]).orderBy(F.desc("score"), "area_id",
                                                                 "industry")


# --- Q3 model (M1-M9) ---------------------------------------------------------

@query("class_weight")
def q_class_weight(spark, sf_dir):
    t = model.class_weights(_train(q3_base(spark, sf_dir)[1]))
    return t.select("area_id", "industry", "target", _r("weight"))


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    t = model.stratified_folds(_train(q3_base(spark, sf_dir)[1]), P.folds)
    return t.select("area_id", "industry", "target", "fold")


@query("stratified_holdout")
def q_stratified_holdout(spark, sf_dir):
    t = model.stratified_holdout(_train(q3_base(spark, sf_dir)[1]), P.holdout)
    return t.select("area_id", "industry", "target", "is_test")


def _unpivot_features(t: DataFrame) -> DataFrame:
    return t.unpivot(["area_id", "industry", "target"], settlement.FEATURES, "feature", "v")


@query("auc_exact")
def q_auc_exact(spark, sf_dir):
    """Exact rank-sum AUC of each feature used alone as the score."""
    u = _unpivot_features(_train(q3_base(spark, sf_dir)[1]))
    a = model.auc_exact(u, "v", "target", ["feature"])
    return a.select("feature", _r("auc"), "n_pos", "n_neg")


def _rule_pred(spark, sf_dir):
    t = _train(q3_base(spark, sf_dir)[1])
    return t.withColumn("pred", (F.col("rel_vitality") >= 1.0).cast("int"))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    """Confusion counts of the rule 'vitality above the city level'."""
    return model.confusion(_rule_pred(spark, sf_dir))


@query("class_report")
def q_class_report(spark, sf_dir):
    r = model.class_report(_rule_pred(spark, sf_dir))
    return r.select("cls", _r("precision"), _r("recall"), _r("f1"), "support")


def gbt_ranking(spark, sf_dir, p=None):
    _, base = q3_base(spark, sf_dir)
    fitted = model.fit_gbt(_train(base), p or P)
    found = settlement.require_candidates(settlement.candidates(base, P))
    scored = model.score(fitted, found).withColumnRenamed("prob", "fit")
    return settlement.recommend(scored)


# A fitted model's own figures have no SQL form.  The queries below fit and
# score in full and return the columns that do not depend on the fit, with
# flags that hold the fitted figures to their definitions.

@query("recommend_gbt")
def q_recommend_gbt(spark, sf_dir):
    r = materialize(gbt_ranking(spark, sf_dir))
    return r.select("area_id", "area_name", "industry",
                    *[_r(c) for c in ["mz_share", "rel_vitality", "store_lq", "density", "entry"]],
                    F.col("fit").between(0.0, 1.0).alias("fit_in_range"),
                    (F.abs(F.col("score") - F.col("fit") * F.col("entry")) < 1e-9).alias("score_is_product"))


@query("gbt_cv_auc")
def q_gbt_cv_auc(spark, sf_dir):
    a = model.cv_auc(_train(q3_base(spark, sf_dir)[1]), P)
    return a.select("fold", "n_pos", "n_neg", F.col("auc").between(0.0, 1.0).alias("auc_in_range"),
                    F.col("auc_mean").between(0.0, 1.0).alias("mean_in_range"))


@query("gbt_holdout_report")
def q_gbt_holdout_report(spark, sf_dir):
    scored = materialize(model.holdout_scores(_train(q3_base(spark, sf_dir)[1]), P))
    auc = model.auc_exact(scored).select(F.lit("auc").alias("cls"),
                                         F.col("auc").between(0.0, 1.0).alias("in_range"),
                                         (F.col("n_pos") + F.col("n_neg")).alias("support"))
    ok = (F.col("precision").between(0.0, 1.0) & F.col("recall").between(0.0, 1.0)
          & F.col("f1").between(0.0, 1.0))
    return model.class_report(scored).select("cls", ok.alias("in_range"), "support").unionByName(auc)


@query("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    train = materialize(_train(q3_base(spark, sf_dir)[1]))
    fitted = model.fit_gbt(train, P)
    i = model.permutation_importance(fitted, train, P)
    return i.select("feature", F.col("base_auc").between(0.0, 1.0).alias("base_in_range"),
                    F.col("perm_auc").between(0.0, 1.0).alias("perm_in_range"),
                    F.col("importance").between(-1.0, 1.0).alias("drop_in_range"))


@query("tree_importance")
def q_tree_importance(spark, sf_dir):
    fitted = model.fit_gbt(_train(q3_base(spark, sf_dir)[1]), P)
    i = model.tree_importance(fitted)
    total = i.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"))
    return attach_scalars(i.select("feature", (F.col("importance") >= 0).alias("not_negative")), total)


@query("boost_first_tree")
def q_boost_first_tree(spark, sf_dir):
    """M1: the first tree's splits and leaves, as values."""
    from .operators import boosting
    t = boosting.fit(_train(q3_base(spark, sf_dir)[1]), settlement.FEATURES, "target",
                     model.boost_params(P.with_(gbt_iter=1)))
    names = F.array(*[F.lit(f) for f in settlement.FEATURES])
    return t.select("node", F.when(F.col("feature") >= 0, F.get(names, F.col("feature"))).alias("feature"),
                    _r("threshold"), _r("value"), _r("cover"))


@query("recommend_first_tree")
def q_recommend_first_tree(spark, sf_dir):
    """The ranking by the first tree's probability, as values."""
    r = gbt_ranking(spark, sf_dir, P.with_(gbt_iter=1))
    return r.select("area_id", "industry", *[_r(c) for c in ["fit", "entry", "score"]])


@query("boost_first_cv_auc")
def q_boost_first_cv_auc(spark, sf_dir):
    """M3: cross-validated AUC of the folds' first trees, as values."""
    s = model.held_out_scores(_train(q3_base(spark, sf_dir)[1]), P.with_(gbt_iter=1))
    a = model.auc_exact(materialize(s.withColumn("prob", F.round("prob", 9))), "prob", "target", ["fold"])
    return a.select("fold", _r("auc"), "n_pos", "n_neg")


@query("shap_first_tree")
def q_shap_first_tree(spark, sf_dir):
    """M8: mean absolute attributions of the first tree, as values."""
    return model.shap_importance(_train(q3_base(spark, sf_dir)[1]), P.with_(gbt_iter=1)).select(
        "feature", _r("mean_abs"), "adds_up")


@query("shap_importance")
def q_shap_importance(spark, sf_dir):
    """M8: mean absolute attributions of all trees.  No SQL form; a test holds
    it against all subsets of features."""
    return model.shap_importance(_train(q3_base(spark, sf_dir)[1]), P).select(
        "feature", _r("mean_abs"), "adds_up").orderBy(F.desc("mean_abs"), "feature")


# --- serving (A18-A23) ---------------------------------------------------------

def _tab3(spark, sf_dir, base=None):
    if base is None:
        base = q3_base(spark, sf_dir)[1]
    return serving.tab3_map(base.pairs, prior_ranking(base), P)


_T3 = ["mz_share", "rel_vitality", "store_lq", "density", "fit", "entry", "score"]


@query("tab3_map")
def q_tab3_map(spark, sf_dir):
    t = _tab3(spark, sf_dir)
    return t.select("area_id", "area_name", "district", "industry", _r("lon", 6), _r("lat", 6),
                    "monthly_per_store_10k", *[_r(c) for c in _T3])


@query("filtered_view")
def q_filtered_view(spark, sf_dir):
    v = serving.filtered_view(_tab3(spark, sf_dir))
    return v.select("area_id", "industry", "monthly_per_store_10k", _r("fit"), _r("entry"),
                    _r("score"))


#: A choice of the dashboard's filters: industries, revenue cap, minimum fit.
CHOICE = {"cap": 180.0, "industries": ["LARGE", "PROMO", "SMALL"], "min_fit": 0.12}


@query("filtered_view_choice")
def q_filtered_view_choice(spark, sf_dir):
    v = serving.filtered_view(_tab3(spark, sf_dir), **CHOICE)
    return v.select("area_id", "industry", "monthly_per_store_10k", _r("fit"), _r("entry"),
                    _r("score"))


@query("filtered_kpis")
def q_filtered_kpis(spark, sf_dir):
    t = _tab3(spark, sf_dir)
    rows = [serving.filtered_kpis(t, **args).select(F.lit(name).alias("filter"), "n_before", "n_after",
                                                    _r("mean_fit"), _r("mean_entry"))
            for name, args in (("default", {}), ("choice", CHOICE))]
    return rows[0].unionByName(rows[1])


@query("hotplace_bubbles")
def q_hotplace_bubbles(spark, sf_dir):
    b = serving.hotplace_bubbles(hotspots.tab2_hotplaces(master(spark, sf_dir), P))
    return b.select("area_id", "industry", "class", _r("lon", 6), _r("lat", 6), "bubble_size")


@query("map_markers")
def q_map_markers(spark, sf_dir):
    m = serving.map_markers(_tab3(spark, sf_dir))
    return m.select("area_id", "industry", _r("lon", 6), _r("lat", 6), _r("fit"), _r("marker_size"))


@query("threshold_slices")
def q_threshold_slices(spark, sf_dir):
    s = serving.threshold_slices(_tab3(spark, sf_dir), P.fit_slices)
    return s.select("threshold", "n_rows", _r("mean_fit"))


@query("kpi_leaders")
def q_kpi_leaders(spark, sf_dir):
    return serving.kpi_leaders(district.tab1_gu_summary(master(spark, sf_dir)))


@query("kpi_means")
def q_kpi_means(spark, sf_dir):
    m = master_table(spark, sf_dir)  # read by three analyses: written once
    _, base = q3_base(spark, sf_dir, m)
    k = serving.kpi_means(district.tab1_gu_summary(m), hotspots.tab2_hotplaces(m, P),
                          _tab3(spark, sf_dir, base))
    return k.select("kpi", _r("value", 6))


# --- single primitives --------------------------------------------------------

@query("tm_to_lonlat")
def q_tm_to_lonlat(spark, sf_dir):
    from .plans.master import clean_area
    from .sources.standin import standin_area_raw
    raw = standin_area_raw(spark, sf_dir)
    a = clean_area(raw).join(raw.select("area_id", "x", "y"), "area_id")
    return a.select("area_id", "x", "y", _r("lon", 6), _r("lat", 6))


@query("cohort_pairs")
def q_cohort_pairs(spark, sf_dir):
    m = settlement.with_year(master(spark, sf_dir))
    y1 = m.filter(F.col("year") == P.year1)
    return (y1.groupBy("area_id", "industry").agg(F.count_distinct("quarter").alias("nq"))
            .filter(F.col("nq") == len(P.year1_quarters)).select("area_id", "industry"))


@query("active_pairs")
def q_active_pairs(spark, sf_dir):
    return settlement.active_pairs(settlement.pair_stats(master(spark, sf_dir), P))


@query("quarterly_cv")
def q_quarterly_cv(spark, sf_dir):
    ps = settlement.pair_stats(master(spark, sf_dir), P).filter(F.col("nq_y1") > 0)
    return ps.select("area_id", "industry",
                     F.round(safe_div("std_y1", "amt_y1"), R9).alias("cv"))


@query("sample_extract")
def q_sample_extract(spark, sf_dir):
    """The first 100 rows of each raw dataset, written as raw CSV before."""
    from .operators.lineage import table_dir
    from .sources.sinks import sample_counts
    from .sources.standin import export_raw_csv
    root = export_raw_csv(spark, sf_dir, table_dir(spark.range(1)), P)
    years = (P.year1, P.year2)
    names = [f"{d}_{y}.csv" for d in ("sales", "stores") for y in years]
    return sample_counts(spark, root, [*names, "foot_traffic.csv", "area.csv"])


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    """The first 100 rows of every raw file, from one pass over all."""
    from .operators.lineage import table_dir
    from .sources.sinks import file_heads
    from .sources.standin import export_by_area
    root = export_by_area(spark, sf_dir, table_dir(master(spark, sf_dir)), P)
    parts = F.split("file", "/")
    return file_heads(spark, f"{root}/*", 100).select(
        F.element_at(parts, -3).alias("dataset"),
        F.regexp_extract(F.element_at(parts, -2), r"(\d+)$", 1).cast("bigint").alias("part"), "line",
        F.md5(F.col("text").cast("binary")).alias("digest"))


@query("master_round_trip")
def q_master_round_trip(spark, sf_dir):
    """The master written by quarter and read back."""
    from .operators.lineage import table_dir
    from .sources.sinks import write_master
    path = table_dir(spark.range(1))
    write_master(master(spark, sf_dir), path)
    return _shown_master(spark.read.parquet(path))


def _shown_master(m: DataFrame) -> DataFrame:
    return m.select("quarter", "area_id", "industry", "sales_amt", "sales_cnt", "stores", "foot",
                    "area_type", "area_name", "district", _r("lon", 6), _r("lat", 6))


@query("master_quarter_refresh")
def q_master_quarter_refresh(spark, sf_dir):
    """All quarters are written, then one comes again with corrected sales
    and one area less; the others stay as written."""
    from .operators.lineage import table_dir
    from .sources.sinks import write_master
    m = master_table(spark, sf_dir)
    path = table_dir(m)
    write_master(m, path)
    late = m.filter(F.col("quarter") == P.quarters[-1])
    write_master(late.filter("area_id % 10 <> 3").withColumn("sales_amt", F.col("sales_amt") + F.col("sales_cnt")),
                 path)
    return _shown_master(spark.read.parquet(path))


@query("result_round_trip")
def q_result_round_trip(spark, sf_dir):
    """The result table published twice; readers get the second version."""
    from .operators.lineage import table_dir
    from .sources.published import publish, read_published
    result = materialize(prior_ranking(q3_base(spark, sf_dir)[1]).select(*RESULT_COLUMNS))
    path = table_dir(result)
    publish(result.limit(1), path)
    publish(result, path)
    return read_published(spark, path).select(
        "area_id", "area_name", "industry", *[_r(c) for c in RESULT_COLUMNS[3:]])


@query("serving_csv_round_trip")
def q_serving_csv_round_trip(spark, sf_dir):
    """The district summary as a serving CSV, read back by schema."""
    from .operators.lineage import table_dir
    from .sources.sinks import read_serving_csv, write_serving_csv
    path = table_dir(spark.range(1))
    t = district.tab1_gu_summary(master(spark, sf_dir))
    write_serving_csv(t, path)
    return read_serving_csv(spark, path, t.schema.simpleString()[len("struct<"):-1].replace(":", " "))


@query("view_landmark")
def q_view_landmark(spark, sf_dir):
    """The landmark analysis as SQL over the registered view."""
    from .sources.views import LANDMARK_SQL, register_views
    register_views(master(spark, sf_dir))
    return spark.sql(LANDMARK_SQL)


@query("view_mega")
def q_view_mega(spark, sf_dir):
    """The proven hot spots as SQL with thresholds as arguments."""
    from .sources.views import mega_by_sql, register_views
    register_views(master(spark, sf_dir))
    return mega_by_sql(spark, P)


@query("view_rising")
def q_view_rising(spark, sf_dir):
    """The emerging hot spots as SQL with thresholds as arguments."""
    from .sources.views import register_views, rising_by_sql
    register_views(master(spark, sf_dir))
    return rising_by_sql(spark, P)


@query("view_result")
def q_view_result(spark, sf_dir):
    """The published result and the master in one SQL text: the best pair of
    each district with at least two recommendations."""
    from .operators.lineage import table_dir
    from .sources.published import publish, read_published
    from .sources.views import register_views, result_by_sql
    m = master_table(spark, sf_dir)
    path = table_dir(m)
    publish(prior_ranking(q3_base(spark, sf_dir, m)[1]).select(*RESULT_COLUMNS), path)
    register_views(m, read_published(spark, path))
    return result_by_sql(spark, least=2)


@query("raw_csv_master")
def q_raw_csv_master(spark, sf_dir):
    """A1 end to end through the raw-file path: the stand-in sources are
    written as mixed-dialect/mixed-encoding CSV, read back by the generic
    ingest and joined by ``build_master``."""
    from .operators.lineage import table_dir
    from .plans.master import build_master
    from .sources.csv_sources import read_sources
    from .sources.standin import export_raw_csv
    root = export_raw_csv(spark, sf_dir, table_dir(spark.range(1)), P)
    m = build_master(*read_sources(spark, root), P)
    return m.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


@query("top_recommendations")
def q_top_recommendations(spark, sf_dir):
    return serving.top_recommendations(_tab3(spark, sf_dir))


@query("chart_ranges")
def q_chart_ranges(spark, sf_dir):
    m = master_table(spark, sf_dir)  # read by the hot-spot list and the Q3 base
    _, base = q3_base(spark, sf_dir, m)
    c = serving.chart_ranges(hotspots.tab2_hotplaces(m, P), _tab3(spark, sf_dir, base))
    return c.select("axis_max", "min_bubble", _r("fit_min"), _r("fit_max"), _r("marker_min"),
                    _r("marker_max"))
