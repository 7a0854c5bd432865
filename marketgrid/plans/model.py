"""Q3 model: boosted trees, stratified validation, metrics, scoring.

* M1 ``fit_gbt``: second-order boosted trees on binned cells
  (``operators.boosting``): two jobs, whatever the number of trees.
* M2 class weight n_neg / (n_pos + 1e-9) for positives.
* M3/M4 stratified folds and hold-out: per-label row positions ordered by
  md5 of the pair key (``operators.ranking.row_positions``, no task holds a
  whole label class); fold = position mod k.
* M5 exact AUC by the rank-sum (Mann-Whitney) formula with average ranks.
* M6/M7 confusion matrix and per-class report by conditional aggregation.
  The folds' models grow in the same jobs, as does the hold-out's.
* M8 importance: mean absolute Shapley value, besides split gains and
  permutation (each feature's values re-assigned along a seeded order of the
  rows, AUC drop).
* ``prior_fit``: an oracle-checkable stand-in for the model's probability —
  the positive share of the pair's industry in the training set.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..operators import boosting
from ..operators.joins import attach_scalars
from ..operators.lineage import materialize
from ..operators.ranking import row_positions, value_positions
from .settlement import FEATURES

def pair_key():
    return F.concat_ws("|", F.col("area_id").cast("string"), F.col("industry"))


def class_weights(train: DataFrame, label: str = "target") -> DataFrame:
    """M2: weight = n_neg / (n_pos + 1e-9) for positives, 1 for negatives."""
    cnt = train.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_npos"),
                    F.count(F.lit(1)).alias("_n"))
    w = (F.col("_n") - F.col("_npos")) / (F.col("_npos") + 1e-9)
    return (attach_scalars(train, cnt)
            .withColumn("weight", F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))
            .drop("_npos", "_n"))


def stratified_folds(train: DataFrame, k: int, label: str = "target",
                     salt: str = "fold") -> DataFrame:
    """M3: fold id 0..k-1, balanced inside each label class."""
    t = train.withColumn("_h", F.md5(F.concat_ws("|", pair_key(), F.lit(salt)))).withColumn("_key", pair_key())
    t = row_positions(t, [label], ["_h", "_key"], "_pos")
    return t.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_h", "_key", "_pos",
                                                                    "n_group")


def stratified_holdout(train: DataFrame, frac: float, label: str = "target",
                       salt: str = "holdout") -> DataFrame:
    """M4: ``is_test`` for ceil(frac·N) rows in all, shared between the label
    classes in proportion (whole parts first, then the largest remainders,
    ties to the smaller label), in seeded hash order inside a class."""
    t = train.withColumn("_h", F.md5(F.concat_ws("|", pair_key(), F.lit(salt)))).withColumn("_key", pair_key())
    t = row_positions(t, [label], ["_h", "_key"], "_pos")
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))   # one row per class
    every = Window.partitionBy()
    total = F.ceil(F.sum("_n").over(every) * frac)
    share = (sizes.withColumn("_all", F.sum("_n").over(every)).withColumn("_total", total)
             .withColumn("_whole", F.expr("_total * _n div _all"))
             .withColumn("_rest", F.expr("_total * _n % _all"))
             .withColumn("_rank", F.row_number().over(every.orderBy(F.desc("_rest"), label)))
             .withColumn("_extra", F.col("_total") - F.sum("_whole").over(every))
             .select(label, (F.col("_whole") + F.when(F.col("_rank") <= F.col("_extra"), 1)
                             .otherwise(0)).alias("_take")))
    return (t.join(F.broadcast(share), label).withColumn("is_test", F.col("_pos") < F.col("_take"))
            .drop("_h", "_key", "_pos", "n_group", "_take"))


def auc_exact(scored: DataFrame, score: str = "prob", label: str = "target",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """M5: ROC AUC = (Σ avg-rank of positives − n1(n1+1)/2) / (n1·n0), from the
    table of distinct scores with their positives; no row is joined back."""
    g = list(group_cols)
    pos = value_positions(scored, g, [score],
                          sums={"_np": F.when(F.col(label) == 1, 1).otherwise(0)})
    agg = pos.groupBy(*g).agg(
        F.sum(F.col("_np") * (F.col("n_before") + (F.col("n_equal") + 1) / 2.0)).alias("_rs"),
        F.sum("_np").alias("n_pos"), F.sum(F.col("n_equal") - F.col("_np")).alias("n_neg"))
    n1, n0 = F.col("n_pos"), F.col("n_neg")
    auc = F.when((n1 > 0) & (n0 > 0), (F.col("_rs") - n1 * (n1 + 1) / 2.0) / (n1 * n0))
    return agg.select(*g, auc.alias("auc"), "n_pos", "n_neg")


def confusion(pred: DataFrame, label: str = "target", pcol: str = "pred") -> DataFrame:
    """M6: counts by (label, prediction)."""
    return pred.groupBy(F.col(label).alias("label")).agg(
        F.sum(F.when(F.col(pcol) == 0, 1).otherwise(0)).alias("pred_0"),
        F.sum(F.when(F.col(pcol) == 1, 1).otherwise(0)).alias("pred_1"))


def class_report(pred: DataFrame, label: str = "target", pcol: str = "pred") -> DataFrame:
    """M7: precision, recall, F1 and support per class (zero division -> 0),
    plus accuracy, macro and weighted averages as extra rows."""
    y, yp = F.col(label), F.col(pcol)
    c = pred.agg(*[F.sum(F.when((y == a) & (yp == b), 1).otherwise(0)).alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
        rows.append(c.select(F.lit(str(k)).alias("cls"), prec.alias("precision"),
                             rec.alias("recall"), (tp + fn).alias("support")))
    per = rows[0].unionByName(rows[1])
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    tot = per.agg(F.sum("support").alias("_n"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n_all = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = c.select(((F.col("c00") + F.col("c11")) / n_all).alias("acc"))
    extra = attach_scalars(tot, acc).select(
        F.explode(F.array(
            F.struct(F.lit("accuracy").alias("cls"), F.col("acc").alias("precision"),
                     F.col("acc").alias("recall"), F.col("acc").alias("f1"),
                     F.col("_n").alias("support")),
            F.struct(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                     F.col("_n").alias("support")),
            F.struct(F.lit("weighted avg").alias("cls"), (F.col("wp") / F.col("_n")).alias("precision"),
                     (F.col("wr") / F.col("_n")).alias("recall"),
                     (F.col("wf") / F.col("_n")).alias("f1"), F.col("_n").alias("support"))
        )).alias("r")).select("r.*")
    return per.select("cls", "precision", "recall", "f1", "support").unionByName(
        extra.select("cls", "precision", "recall", "f1", "support"))


def prior_fit(train: DataFrame, scored: DataFrame) -> DataFrame:
    """Positive share of the industry in the training set (overall share for
    an industry never seen); a transparent, SQL-checkable fit column."""
    ind = train.groupBy("industry").agg(F.avg(F.col("target").cast("double")).alias("_fi"))
    allr = train.agg(F.avg(F.col("target").cast("double")).alias("_fa"))
    s = attach_scalars(scored.join(F.broadcast(ind), "industry", "left"), allr)
    return s.withColumn("fit", F.coalesce("_fi", "_fa")).drop("_fi", "_fa")


# ----------------------------------------------------------------------------
# boosted trees
# ----------------------------------------------------------------------------

@dataclass
class Fitted:
    """Models by the part that they leave out, and their trees as a table."""
    trees: DataFrame
    models: dict[int, boosting.Ensemble]


def boost_params(p: Params) -> boosting.BoostParams:
    return boosting.BoostParams(trees=p.gbt_iter, depth=p.gbt_depth, step=p.gbt_step)


def _fit(train: DataFrame, p: Params, part: str | None = None, leave_out: Sequence[int] = (boosting.WHOLE,)
         ) -> Fitted:
    trees = boosting.fit(train, FEATURES, "target", boost_params(p), part, leave_out)
    return Fitted(trees, boosting.ensembles(trees, len(FEATURES)))


def fit_gbt(train: DataFrame, p: Params) -> Fitted:
    """M1: boosted trees; positives weigh n_neg / (n_pos + 1e-9) (M2)."""
    # the thresholds and the cells read it
    return _fit(materialize(train.select(*FEATURES, "target")), p)


def _with_prob(df: DataFrame, margin: Column) -> DataFrame:
    prob = 1 / (1 + F.exp(-margin))
    return df.withColumn("prob", prob).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


def score(model: Fitted, df: DataFrame, which: Column | None = None) -> DataFrame:
    """M9: probability of class 1 and the 0.5-threshold prediction, by the
    whole model or by the one that leaves the part ``which`` out."""
    return _with_prob(df, boosting.margin_of(model.models, FEATURES, which))


def held_out_scores(train: DataFrame, p: Params) -> DataFrame:
    """fold, target, prob: every row scored by the model grown without its
    fold.  All folds' models come from one set of jobs."""
    folded = materialize(stratified_folds(train, p.folds))
    fitted = _fit(folded, p, "fold", range(p.folds))
    return score(fitted, folded, F.col("fold")).select("fold", "target", "prob")


def cv_auc(train: DataFrame, p: Params) -> DataFrame:
    """M3: stratified cross-validated AUC, one row per fold plus mean and
    (population) std."""
    per_fold = auc_exact(materialize(held_out_scores(train, p)), "prob", "target", ["fold"])
    stats = per_fold.agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    return attach_scalars(per_fold, stats)


def holdout_scores(train: DataFrame, p: Params) -> DataFrame:
    """target, prob, pred of the hold-out by a model grown without it."""
    split = materialize(stratified_holdout(train, p.holdout).withColumn("_test", F.col("is_test").cast("int")))
    fitted = _fit(split, p, "_test", [1])
    return score(fitted, split.filter("is_test"), F.lit(1)).select("target", "prob", "pred")


def shap_importance(train: DataFrame, p: Params) -> DataFrame:
    """M8: mean absolute attribution per feature over the training rows."""
    train = materialize(train.select(*FEATURES, "target"))
    ensemble = _fit(train, p).models[boosting.WHOLE]
    return boosting.mean_absolute(boosting.attributions(train, ensemble, FEATURES), FEATURES)


def permutation_importance(fitted, data: DataFrame, p: Params) -> DataFrame:
    """M8 (re-aimed from SHAP): AUC drop when one feature's values are
    re-assigned to other rows along a seeded hash order.  The order does not
    depend on the feature, so one join brings the values of all features, and
    one pass scores all variants."""
    t = data.withColumn("_key", pair_key()).withColumn("_h", F.md5(F.concat_ws("|", pair_key(), F.lit(p.seed))))
    by_key = row_positions(t, [], ["_key"], "_pk").drop("n_group")
    by_hash = row_positions(t.select("_key", "_h", *[F.col(f).alias(f"_p_{f}") for f in FEATURES]),
                            [], ["_h", "_key"], "_pk").drop("_key", "_h", "n_group")
    variants = [F.struct(F.lit(v).alias("feature"),
                         *[F.col(f"_p_{f}" if f == v else f).alias(f) for f in FEATURES])
                for v in ["", *FEATURES]]
    rows = (by_key.join(by_hash, "_pk")
            .select("target", F.explode(F.array(*variants)).alias("v")).select("target", "v.*"))
    auc = auc_exact(materialize(score(fitted, rows).select("feature", "target", "prob")),
                    "prob", "target", ["feature"])
    auc = materialize(auc.select("feature", "auc"))
    base = auc.filter("feature = ''").select(F.col("auc").alias("base_auc"))
    return attach_scalars(auc.filter("feature <> ''").withColumnRenamed("auc", "perm_auc"),
                          base.agg(F.max("base_auc").alias("base_auc"))
                          ).withColumn("importance", F.col("base_auc") - F.col("perm_auc"))


def tree_importance(fitted: Fitted) -> DataFrame:
    """Share of the whole model's split gains per feature (0 if unused)."""
    gains = fitted.trees.filter(F.col("model") == boosting.WHOLE).agg(
        *[F.sum(F.when(F.col("feature") == k, F.col("gain")).otherwise(0.0)).alias(f)
          for k, f in enumerate(FEATURES)])
    total = sum((F.col(f) for f in FEATURES), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"),
                              F.coalesce(F.try_divide(F.col(f), total), F.lit(0.0)).alias("importance"))
                     for f in FEATURES])
    return gains.select(F.explode(rows).alias("r")).select("r.*")
