"""Model helpers: folds, exact AUC, reports, GBT smoke."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marketgrid.config import STANDIN
from marketgrid.plans import model


def _scored(spark, n=120, seed=3):
    rnd = random.Random(seed)
    rows = [(i, f"I{i % 3}", int(rnd.random() < 0.3), float(rnd.randint(0, 20))) for i in range(n)]
    return spark.createDataFrame(rows, "area_id bigint, industry string, target int, prob double"), rows


def test_auc_matches_pairwise_count(spark):
    df, rows = _scored(spark)
    pos = [r[3] for r in rows if r[2] == 1]
    neg = [r[3] for r in rows if r[2] == 0]
    wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
    got = model.auc_exact(df).first()
    assert got.auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_folds_are_stratified(spark):
    df, rows = _scored(spark)
    f = model.stratified_folds(df, 5).groupBy("target", "fold").count().collect()
    for t in (0, 1):
        sizes = [r["count"] for r in f if r.target == t]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_holdout_share(spark):
    df, rows = _scored(spark)
    h = model.stratified_holdout(df, 0.25)
    n = [sum(1 for r in rows if r[2] == t) for t in (0, 1)]
    total = -(-sum(n) // 4)                      # a quarter of all rows, rounded up
    exact = [total * k for k in n]
    take = [e // sum(n) for e in exact]
    for t in sorted((0, 1), key=lambda t: (-(exact[t] % sum(n)), t))[:total - sum(take)]:
        take[t] += 1
    got = {r.target: r["count"] for r in h.filter("is_test").groupBy("target").count().collect()}
    assert got == {t: take[t] for t in (0, 1)} and sum(take) == total


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "target int, pred int")
    rep = {r.cls: r for r in model.class_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["0"].recall == 1.0
    assert rep["accuracy"].f1 == pytest.approx(2 / 3) and rep["weighted avg"].support == 3


def test_gbt_fit_and_score(spark):
    rnd = random.Random(1)
    rows = [(i, "X", int(i % 3 == 0), *[rnd.random() for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "area_id bigint, industry string, target int, mz_share double, "
                                     "rel_vitality double, rel_ticket double, store_lq double, cv double")
    fitted = model.fit_gbt(df, STANDIN.with_(gbt_iter=3))
    probs = [r.prob for r in model.score(fitted, df).collect()]
    assert len(probs) == 60 and all(0.0 <= p <= 1.0 for p in probs)
