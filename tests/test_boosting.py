"""Boosted trees against row-by-row boosting, attributions against subsets."""

import itertools
import math
import random

import numpy as np
import pytest
from helpers import SF_CHECK
from pyspark.sql import functions as F

from marketgrid.config import STANDIN
from marketgrid.operators import boosting as bo
from marketgrid.plans import model
from marketgrid.plans.settlement import FEATURES

NAMES = ["a", "b", "c"]


def sample(seed, n, ties=True):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rnd.gauss(0, 1), rnd.randint(0, 4) if ties else rnd.random(), rnd.random()]
        rows.append((*map(float, x), int(x[0] + 0.5 * x[1] + rnd.gauss(0, 1) > 1.5), rnd.randint(0, 2)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, c double, y int, part int").repartition(3)


def slow_cuts(rows, bins):
    return [sorted({float(np.quantile([r[k] for r in rows], q / bins)) for q in range(1, bins)}) for k in range(3)]


def slow_boost(rows, cuts, p):
    """Row by row, node by node: {(tree, node): (feature, threshold, value, cover)}."""
    n0, n1 = sum(r[3] == 0 for r in rows), sum(r[3] == 1 for r in rows)
    up = n0 / (n1 + 1e-9)
    margin, out = [0.0] * len(rows), {}

    def side(g, h):
        return g * g / (h + p.l2)

    for tree in range(p.trees):
        gh = []
        for m, r in zip(margin, rows):
            q, w = 1 / (1 + math.exp(-m)), up if r[3] else 1.0
            gh.append((w * (q - r[3]), w * q * (1 - q)))

        def grow(node, members, depth):
            g, h = (sum(gh[i][j] for i in members) for j in (0, 1))
            best = None
            if depth < p.depth:
                for f, c in ((f, c) for f in range(3) for c in cuts[f]):
                    left = [i for i in members if rows[i][f] <= c]
                    gl, hl = (sum(gh[i][j] for i in left) for j in (0, 1))
                    if not 0 < len(left) < len(members) or round(min(hl, h - hl), 9) < p.least_hessian:
                        continue
                    gain = round(side(gl, hl) + side(g - gl, h - hl) - side(g, h), 9)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = gain, f, c, left
            if best is None:
                value = -p.step * g / (h + p.l2)
                out[tree, node] = (-1, None, value, h)
                for i in members:
                    margin[i] += value
            else:
                _, f, c, left = best
                out[tree, node] = (f, c, 0.0, h)
                grow(2 * node + 1, left, depth + 1)
                grow(2 * node + 2, [i for i in members if i not in set(left)], depth + 1)

        grow(0, list(range(len(rows))), 0)
    return out, margin


def held(found, expected):
    got = {(r["tree"], r["node"]): (r["feature"], r["threshold"], r["value"], r["cover"]) for r in found}
    assert got.keys() == expected.keys()
    for k, (f, t, v, c) in expected.items():
        assert got[k][0] == f and (t is None) == (got[k][1] is None)
        assert t is None or got[k][1] == pytest.approx(t, abs=1e-12)
        assert got[k][2:] == pytest.approx((v, c), abs=1e-9)


@pytest.mark.parametrize("seed,n,depth", [(1, 90, 3), (2, 160, 5), (3, 12, 2)])
def test_trees_equal_row_by_row_boosting(spark, seed, n, depth):
    rows, p = sample(seed, n), bo.BoostParams(trees=6, depth=depth, step=0.3, bins=8)
    trees = bo.fit(frame(spark, rows), NAMES, "y", p)
    expected, margin = slow_boost(rows, slow_cuts(rows, 8), p)
    held(trees.collect(), expected)
    ensemble = bo.ensembles(trees, 3)[bo.WHOLE]
    assert ensemble.margin(np.array([r[:3] for r in rows])) == pytest.approx(np.array(margin), abs=1e-9)


def test_all_parts_in_one_fit_equal_separate_fits(spark):
    rows, p = sample(5, 150), bo.BoostParams(trees=4, depth=3, step=0.2, bins=8)
    cuts = slow_cuts(rows, 8)
    trees = bo.fit(frame(spark, rows), NAMES, "y", p, "part", [0, 1, 2, bo.WHOLE]).collect()
    for m in (0, 1, 2, bo.WHOLE):
        held([r for r in trees if r["model"] == m], slow_boost([r for r in rows if r[4] != m], cuts, p)[0])


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    rows, p = sample(8, 200), bo.BoostParams(trees=20, depth=4, bins=16)
    first = sorted(map(tuple, bo.fit(frame(spark, rows), NAMES, "y", p).collect()), key=str)
    again = sorted(map(tuple, bo.fit(frame(spark, rows[::-1]).repartition(7), NAMES, "y", p).collect()), key=str)
    assert first == again


@pytest.mark.parametrize("rows", [[(0.5, 1.0, 2.0, 1, 0)] * 5, [(0.5, 1.0, 2.0, 0, 0), (0.7, 1.0, 2.0, 0, 1)]])
def test_one_label_or_equal_rows(spark, rows):
    trees = bo.fit(frame(spark, rows), NAMES, "y", bo.BoostParams(trees=3))
    assert {r["feature"] for r in trees.collect()} == {-1}
    assert len(bo.ensembles(trees, 3)[bo.WHOLE].margin(np.zeros((2, 3)))) == 2


def test_too_many_cells_are_refused(spark):
    with pytest.raises(ValueError):
        bo.fit(frame(spark, sample(1, 5)), NAMES, "y", bo.BoostParams(bins=128))
    with pytest.raises(ValueError):
        bo.BoostParams(bins=1)


def brute_value(tree, x, known):
    """Expectation of one tree given the features in ``known``."""
    def walk(node):
        f, t, v, _ = tree[node]
        if f < 0:
            return v
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return walk(right if x[f] > t else left)
        cl, cr = tree[left][3], tree[right][3]
        return (cl * walk(left) + cr * walk(right)) / (cl + cr)
    return walk(0)


def test_attributions_equal_all_orders_of_features(spark):
    """Shapley's definition: the mean gain over all orders."""
    rows, p = sample(9, 80), bo.BoostParams(trees=5, depth=4, step=0.3, bins=8)
    df = frame(spark, rows)
    trees = bo.fit(df, NAMES, "y", p)
    expected, _ = slow_boost(rows, slow_cuts(rows, 8), p)
    per_tree = [{n: v for (t, n), v in expected.items() if t == k} for k in range(p.trees)]
    found = bo.attributions(df, bo.ensembles(trees, 3)[bo.WHOLE], NAMES).collect()
    got = sorted((round(r["margin"], 9), *(round(r[n], 9) for n in NAMES)) for r in found)
    want = []
    for r in rows:
        def value(known):
            return sum(brute_value(t, r, known) for t in per_tree)
        phi = [0.0] * 3
        for order in itertools.permutations(range(3)):
            for k, f in enumerate(order):
                phi[f] += (value(set(order[:k + 1])) - value(set(order[:k]))) / 6
        want.append((round(value({0, 1, 2}), 9), *(round(x, 9) for x in phi)))
    assert np.array(got) == pytest.approx(np.array(sorted(want)), abs=1e-8)
    total = bo.mean_absolute(bo.attributions(df, bo.ensembles(trees, 3)[bo.WHOLE], NAMES), NAMES).collect()
    assert all(r["adds_up"] for r in total) and [r["feature"] for r in total] == NAMES
    assert [r["mean_abs"] for r in total] == pytest.approx(
        [float(np.mean([abs(w[1 + k]) for w in want])) for k in range(3)], abs=1e-8)


def _train(spark):
    from marketgrid import registry
    return registry._train(registry.q3_base(spark, SF_CHECK)[1])


def test_cross_validation_as_five_fits_in_few_jobs(spark):
    p = STANDIN.with_(gbt_iter=30)
    train = model.materialize(_train(spark))
    folded = model.materialize(model.stratified_folds(train, p.folds))
    cuts = bo.cut_points(folded, FEATURES, 16)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("one-fit", "")
    fitted = model._fit(folded, p, "fold", range(p.folds))
    sc.setJobGroup("", "")
    # thresholds, cells, trees: far fewer than trees x levels
    assert len(tracker.getJobIdsForGroup("one-fit")) <= 30
    scored = model.score(fitted, folded, F.col("fold")).select("area_id", "industry", "fold", "prob").collect()
    for k in range(p.folds):
        alone = bo.fit(folded.filter(F.col("fold") != k), FEATURES, "target", model.boost_params(p), cuts=cuts)
        single = model.Fitted(alone, bo.ensembles(alone, 5))
        expected = {(r.area_id, r.industry): r.prob
                    for r in model.score(single, folded.filter(F.col("fold") == k)).collect()}
        got = {(r.area_id, r.industry): r.prob for r in scored if r.fold == k}
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_cv_auc_is_the_pairwise_count(spark):
    p = STANDIN.with_(gbt_iter=20)
    train = model.materialize(_train(spark))
    scored = model.held_out_scores(train, p).collect()
    got = model.cv_auc(train, p).collect()
    assert len(got) == p.folds
    for r in got:
        pos, neg = ([s.prob for s in scored if s.fold == r.fold and s.target == t] for t in (1, 0))
        wins = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg)
        assert r.auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    assert got[0].auc_mean == pytest.approx(np.mean([r.auc for r in got]))
