"""Distributed order statistics against pandas on the same values."""

import numpy as np
import pandas as pd
import pytest

from marketgrid.operators import ranking
from marketgrid.operators.ranking import (exact_median, exact_quantiles, pct_rank_average,
                                          row_positions)


def _frame(spark, n=2000, groups=3, seed=1, hot=True):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    if hot:  # one group holds most rows
        g[: n // 2] = 0
    v = rng.integers(0, 300, n).astype(float)
    v[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"g": g.astype(int), "v": v, "k": np.arange(n)})
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))


def test_pct_rank_ties_small(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    out = sorted(r.pct_rank for r in pct_rank_average(df, "v").collect())
    assert out == [0.25, 0.625, 0.625, 1.0]


def test_pct_rank_matches_pandas(spark):
    pdf, df = _frame(spark)
    got = pct_rank_average(df, "v", ["g"]).toPandas().sort_values("k")
    exp = pdf.groupby("g")["v"].rank(pct=True, method="average")
    np.testing.assert_allclose(got["pct_rank"].to_numpy(dtype=float),
                               exp.to_numpy(dtype=float), rtol=0, atol=1e-15)


@pytest.mark.parametrize("qs", [[0.25, 0.75], [0.5], [0.95, 0.05]])
def test_quantiles_match_pandas(spark, qs):
    pdf, df = _frame(spark, seed=3)
    got = exact_quantiles(df, "v", qs, ["g"], names=[f"x{i}" for i in range(len(qs))])
    got = got.toPandas().set_index("g").sort_index()
    for i, q in enumerate(qs):
        exp = pdf.groupby("g")["v"].quantile(q).sort_index()
        np.testing.assert_allclose(got[f"x{i}"].to_numpy(dtype=float), exp.to_numpy(), rtol=1e-12)


def test_global_median_and_single_value(spark):
    pdf, df = _frame(spark, seed=5)
    got = exact_median(df, "v").collect()[0]["median"]
    assert got == pytest.approx(pdf["v"].median(), rel=1e-12)
    one = spark.createDataFrame([(7.0,)], "v double")
    assert exact_quantiles(one, "v", [0.25, 0.75]).collect()[0][0] == 7.0


def test_row_positions_unique_and_dense(spark):
    pdf, df = _frame(spark, seed=7)
    got = row_positions(df, ["g"], ["k"]).toPandas()
    for _, grp in got.groupby("g"):
        assert sorted(grp["pos"]) == list(range(len(grp)))
        assert (grp.sort_values("k")["pos"].to_numpy() == np.arange(len(grp))).all()


@pytest.mark.parametrize("parts", [None, 7])
def test_value_positions_across_partitions(spark, parts):
    from marketgrid.operators.ranking import value_positions
    pdf, df = _frame(spark, n=3000, seed=11)
    got = value_positions(df, ["g"], ["v"], num_partitions=parts).toPandas()
    if parts:  # the hot group really spans several range partitions
        from pyspark.sql import functions as F
        spread = (df.filter("v is not null").groupBy("g", "v").count()
                  .repartitionByRange(parts, "g", "v")
                  .select("g", F.spark_partition_id().alias("p")).distinct()
                  .filter("g = 0").count())
        assert spread > 1
    for _, r in got.iterrows():
        grp = pdf[(pdf.g == r.g) & pdf.v.notna()]
        assert r.n_before == (grp.v < r.v).sum()
        assert r.n_equal == (grp.v == r.v).sum()
        assert r.n_group == len(grp)


@pytest.mark.parametrize("small", [200, 10_000])
def test_quantiles_by_selection(spark, monkeypatch, small):
    """Sketched brackets and whole groups give the same exact values: ties,
    tiny groups, a group with most rows, null values, extreme shares."""
    monkeypatch.setattr(ranking, "SMALL", small)
    monkeypatch.setattr(ranking, "ACCURACY", 200)
    rng = np.random.default_rng(4)
    groups = {"hot": np.round(rng.lognormal(0, 3, 6000), 3), "ties": rng.integers(0, 3, 900).astype(float),
              "one": np.array([7.5]), "two": np.array([-1.0, 4.0]), "wide": np.array([1e300, -1e300, 0.0, 1e-300]),
              "steps": np.arange(1000.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: list(r)[1:] for r in ranking.exact_quantiles(df, "v", qs, ["g"], [f"q{k}" for k in range(7)]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx([float(np.quantile(vs, q)) for q in qs], rel=1e-12)
    every = ranking.exact_quantiles(df.filter("g <> 'wide'"), "v", qs, [], [f"q{k}" for k in range(7)]).first()
    values = np.concatenate([v for g, v in groups.items() if g != "wide"])
    assert list(every) == pytest.approx([float(np.quantile(values, q)) for q in qs], rel=1e-12)
    assert list(ranking.exact_quantiles(df.limit(0), "v", [0.5]).first()) == [None]


def test_selection_writes_nothing_and_orders_no_range(spark):
    df = spark.createDataFrame([(k % 3, float(k)) for k in range(100)], "g int, v double")
    from marketgrid.operators import lineage
    before = len(lineage._written)
    out = ranking.exact_quantiles(df, "v", [0.25, 0.75], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(lineage._written) == before and "rangepartitioning" not in plan
