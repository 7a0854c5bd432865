"""Second-order gradient boosting on binned cells, and exact attributions.

**Fit.**  Feature values are binned at exact quantiles, and rows with equal bins
and label collapse into *cells*: one groupBy with partial aggregation.  There
are at most ``bins ** features`` cells (``CELLS`` bounds that number and with it
the bins), however many rows.  All that boosting reads of the data is in the
cells, since equal bins have equal gradients, so a model is grown from the cells
alone, in one task, without a further job: per level, gradient and Hessian sums
by (node, feature, bin), the split with the largest regularised gain, Newton
leaves.

**Many models at once.**  A row has a ``part``.  A model is named by the part
that it leaves out (or none); the cells of all models come from the same
groupBy, and the models grow side by side, one task each.  So cross-validation
costs as many jobs as one fit.

**Attributions.**  The Shapley values of a row's margin, with the conditional
expectation of a tree given some features: known ones take the row's branch,
others both branches by the Hessian sums that reached them in training.  All
2^F subsets of the F features are worked out, tree by tree, for a batch of rows
at a time; base value and attributions add up to the margin.

Trees have at most 2^(depth + 1) - 1 nodes, so an ensemble's size is set by its
parameters; it comes to the driver once and goes into the scoring expressions.

Ties between splits (gains equal to nine decimals) go to the feature that comes
first, then to the smaller threshold, so a fit does not depend on the order of
rows.  Null features are refused by the sums (callers drop them).  Without rows,
or of one label only, every tree is a leaf.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import materialize
from .ranking import exact_quantiles

# workers get these functions by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most cells of a model.
CELLS = 1 << 20
#: Name of the model that leaves nothing out.
WHOLE = -1
TREES = ("model int, tree int, node int, feature int, threshold double, value double, cover double, "
         "gain double")


@dataclass(frozen=True)
class BoostParams:
    trees: int = 200
    depth: int = 5
    step: float = 0.05
    l2: float = 1.0                 # added to Hessian sums
    least_hessian: float = 1.0      # of either side of a split
    bins: int = 16

    def __post_init__(self):
        if self.trees < 1 or self.depth < 1 or self.bins < 2:
            raise ValueError("trees, depth and bins must be positive, bins at least 2")


# -- cells -----------------------------------------------------------------------

def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Ascending distinct thresholds per feature: its bins - 1 inner quantiles.
    A value above k of them lies in bin k."""
    if bins ** len(features) > CELLS:
        raise ValueError(f"{bins} bins of {len(features)} features may make more than {CELLS} cells")
    names = [f"q{k}" for k in range(1, bins)]
    long = rows.unpivot([], list(features), "_feature", "_value")
    found = {r["_feature"]: sorted({r[n] for n in names}) for r in exact_quantiles(
        long, "_value", [k / bins for k in range(1, bins)], ["_feature"], names).collect()}
    return [found.get(f, []) for f in features]


def bin_of(value: Column, cuts: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"),
                           lambda c: value > c)).cast("int")


def cells(rows: DataFrame, features: Sequence[str], cuts: list[list[float]], label: str, part: str | None
          ) -> DataFrame:
    """One row per (part, bins): numbers of rows with label 0 and 1."""
    keys = [bin_of(F.col(f), c).alias(f"b{k}") for k, (f, c) in enumerate(zip(features, cuts))]
    part_of = F.lit(WHOLE) if part is None else F.col(part)
    return rows.groupBy(part_of.cast("int").alias("part"), *keys).agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))


# -- growing ---------------------------------------------------------------------

def grow(bins: np.ndarray, n0: np.ndarray, n1: np.ndarray, cuts: list[list[float]], p: BoostParams
         ) -> list[tuple]:
    """(tree, node, feature, threshold, value, cover, gain) of all nodes; the
    children of node i are 2i + 1 and 2i + 2, the feature of a leaf is -1."""
    n, width = bins.shape
    positive = n0.sum() / (n1.sum() + 1e-9)
    up = positive * n1
    margin, out = np.zeros(n), []
    last = np.array([len(c) for c in cuts])
    size = int(last.max(initial=0)) + 1
    flat = bins + np.arange(width) * size            # (feature, bin) as one number
    settled = 2 ** (p.depth + 1) - 1                 # behind all nodes
    for tree in range(p.trees):
        chance = 1 / (1 + np.exp(-margin))
        g, h = n0 * chance + up * (chance - 1), (n0 + up) * chance * (1 - chance)
        node, open_ = np.zeros(n, np.int64), [0]
        totals = {0: (g.sum(), h.sum())}
        for level in range(p.depth + 1):
            grown = []
            if level < p.depth and open_:
                slot = np.full(settled + 1, -1)
                slot[open_] = np.arange(len(open_))
                at = np.flatnonzero(slot[node] >= 0)
                key = (slot[node[at]][:, None] * (width * size) + flat[at]).ravel()
                shape = (len(open_), width, size)
                gs, hs, seen = (np.bincount(key, np.repeat(x[at], width), int(np.prod(shape))).reshape(shape)
                                for x in (g, h, n0 + n1))
                grown = _splits(open_, gs, hs, seen, last, p)
            for k in open_:
                feature, cut, gain = grown[open_.index(k)] if grown else (-1, -1, 0.0)
                gk, hk = totals[k]
                if feature < 0:
                    value = -p.step * gk / (hk + p.l2) if hk + p.l2 > 0 else 0.0
                    out.append((tree, k, -1, math.nan, value, hk, 0.0))
                    margin[node == k] += value
                    node[node == k] = settled
                else:
                    out.append((tree, k, feature, cuts[feature][cut], 0.0, hk, gain))
            split = [(k, f, c) for k, (f, c, _) in zip(open_, grown) if f >= 0]
            open_ = []
            for k, f, c in split:
                own = np.flatnonzero(node == k)
                right = bins[own, f] > c
                node[own] = 2 * k + 1 + right
                for child, rows in ((2 * k + 1, own[~right]), (2 * k + 2, own[right])):
                    totals[child] = g[rows].sum(), h[rows].sum()
                    open_.append(child)
            if not open_:
                break
    return out


def _splits(open_: list[int], gs: np.ndarray, hs: np.ndarray, seen: np.ndarray, last: np.ndarray,
            p: BoostParams) -> list[tuple[int, int, float]]:
    """(feature, cut, gain) per node, (-1, -1, 0) where no split gains."""
    left_g, left_h, left_n = (np.cumsum(x, axis=2)[:, :, :-1] for x in (gs, hs, seen))
    all_g, all_h, all_n = (x.sum(axis=2, keepdims=True) for x in (gs, hs, seen))
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = (left_g ** 2 / (left_h + p.l2) + right_g ** 2 / (right_h + p.l2) - all_g ** 2 / (all_h + p.l2))
    cut = np.arange(gain.shape[2])
    may = ((cut[None, :] < last[:, None])[None] & (left_n > 0) & (left_n < all_n)
           & (np.round(np.minimum(left_h, right_h), 9) >= p.least_hessian))
    gain = np.where(may, np.round(gain, 9), 0.0).reshape(len(open_), -1)
    if not gain.shape[1]:
        return [(-1, -1, 0.0)] * len(open_)
    best = np.argmax(gain, axis=1)
    return [(int(b) // len(cut), int(b) % len(cut), float(x[b])) if x[b] > 1e-6 else (-1, -1, 0.0)
            for b, x in zip(best, gain)]


def fit(rows: DataFrame, features: Sequence[str], label: str, p: BoostParams, part: str | None = None,
        leave_out: Sequence[int] = (WHOLE,), cuts: list[list[float]] | None = None) -> DataFrame:
    """The trees (``TREES``) of one model per entry of ``leave_out``, written
    once.  ``cuts``: thresholds to use; else quantiles of all rows."""
    cuts = cut_points(rows, features, p.bins) if cuts is None else cuts
    names = [f"b{k}" for k in range(len(features))]
    models = F.filter(F.array(*[F.lit(int(m)) for m in leave_out]), lambda m: m != F.col("part"))
    if WHOLE in leave_out and part is None:
        models = F.array(F.lit(WHOLE))
    per_model = (cells(rows, features, cuts, label, part).withColumn("model", F.explode(models))
                 .groupBy("model", *names).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        found = found.sort_by([(c, "ascending") for c in names])
        bins = np.stack([found[c].to_numpy() for c in names], axis=1).astype(np.int64)
        nodes = grow(bins, *(found[c].to_numpy().astype(float) for c in ("n0", "n1")), cuts, p)
        tree, node, feature, threshold, value, cover, gain = map(list, zip(*nodes))
        return pa.table({"model": pa.array([key[0].as_py()] * len(nodes), pa.int32()),
                         "tree": pa.array(tree, pa.int32()), "node": pa.array(node, pa.int32()),
                         "feature": pa.array(feature, pa.int32()),
                         "threshold": pa.array([None if math.isnan(t) else t for t in threshold], pa.float64()),
                         "value": pa.array(value, pa.float64()), "cover": pa.array(cover, pa.float64()),
                         "gain": pa.array(gain, pa.float64())})

    return materialize(per_model.groupBy("model").applyInArrow(run, TREES))


# -- using -----------------------------------------------------------------------

class Ensemble:
    """The trees of one model as arrays (tree, node)."""

    def __init__(self, rows: Sequence, features: int):
        trees = max((r["tree"] for r in rows), default=-1) + 1
        size = max((r["node"] for r in rows), default=0) + 1
        self.depth = int(math.log2(size + 1) - 1e-9) + 1
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1)
        self.threshold = np.zeros((trees, size))
        self.value, self.cover = np.zeros((trees, size)), np.zeros((trees, size))
        for r in rows:
            at = r["tree"], r["node"]
            self.feature[at], self.value[at], self.cover[at] = r["feature"], r["value"], r["cover"]
            if r["threshold"] is not None:
                self.threshold[at] = r["threshold"]
        self.width = features

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > threshold[node]))
            total += value[node]
        return total

    def expectations(self, x: np.ndarray) -> np.ndarray:
        """(2^F, rows): the margin's expectation where the features in the
        bits of the first index are known."""
        subsets = np.arange(2 ** self.width)
        total = np.zeros((len(subsets), len(x)))
        for feature, threshold, value, cover in zip(self.feature, self.threshold, self.value, self.cover):
            total += self._expected(0, feature, threshold, value, cover, subsets, x)
        return total

    def _expected(self, k, feature, threshold, value, cover, subsets, x):
        f = feature[k]
        if f < 0:
            return np.full((len(subsets), len(x)), value[k])
        left, right = (self._expected(c, feature, threshold, value, cover, subsets, x)
                       for c in (2 * k + 1, 2 * k + 2))
        share = cover[2 * k + 1] / (cover[2 * k + 1] + cover[2 * k + 2])
        taken = np.where(x[:, f] > threshold[k], right, left)
        return np.where((subsets >> f & 1)[:, None] == 1, taken, share * left + (1 - share) * right)

    def shapley(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base value, attributions (rows, F))."""
        v, n = self.expectations(x), self.width
        out = np.zeros((len(x), n))
        for f in range(n):
            others = [k for k in range(n) if k != f]
            for size in range(n):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                for s in itertools.combinations(others, size):
                    bits = sum(1 << k for k in s)
                    out[:, f] += weight * (v[bits | 1 << f] - v[bits])
        return v[0], out


def ensembles(trees: DataFrame, features: int) -> dict[int, Ensemble]:
    """The models of a tree table; its size is bounded by their parameters."""
    by_model: dict[int, list] = {}
    for r in trees.collect():
        by_model.setdefault(r["model"], []).append(r)
    return {m: Ensemble(rows, features) for m, rows in by_model.items()}


def margin_of(models: dict[int, Ensemble], features: Sequence[str], model: Column | None = None) -> Column:
    """The margin of a row by the model that ``model`` names (default: the
    whole one)."""
    @F.pandas_udf("double")
    def margin(which: pd.Series, *values: pd.Series) -> pd.Series:
        x, out = np.stack([v.to_numpy(float) for v in values], axis=1), np.zeros(len(which))
        for m in which.unique():
            own = (which == m).to_numpy()
            out[own] = models[int(m)].margin(x[own])
        return pd.Series(out)

    which = F.lit(WHOLE) if model is None else model
    return margin(which.cast("int"), *[F.col(f).cast("double") for f in features])


def attributions(rows: DataFrame, ensemble: Ensemble, features: Sequence[str]) -> DataFrame:
    """Per row of ``rows`` the attribution of every feature, under its name,
    with the base value and the margin."""
    names = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(c, float) for c in b.columns], axis=1) if b.num_rows else None
            for at in range(0, b.num_rows, 2048):
                part = x[at:at + 2048]
                base, phi = ensemble.shapley(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(phi[:, k]) for k in range(len(names))]
                    + [pa.array(base), pa.array(ensemble.margin(part))], names=[*names, "base", "margin"])

    fields = ", ".join(f"{n} double" for n in [*names, "base", "margin"])
    return rows.select(*[F.col(f).cast("double") for f in names]).mapInArrow(run, fields)


def mean_absolute(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean_abs and adds_up: whether base and attributions give the
    margin in every row."""
    total = sum((F.col(f) for f in features), F.col("base"))
    one = attributed.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features],
                         F.min((F.abs(total - F.col("margin")) < 1e-9).cast("int")).alias("_ok"))
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs"))
                                          for f in features])).alias("r"), (F.col("_ok") == 1).alias("adds_up"))
    return long.select("r.feature", "r.mean_abs", "adds_up")
