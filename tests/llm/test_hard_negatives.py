import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgrid.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<float>, score double, anchor int, part string, id bigint"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    kept, out = sorted(kept), []

    def dot(u, v):
        return max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(u, v))))

    for i, label, v in kept:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in kept if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(n, j) for n, j, other in scored
                    if other != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, is_anchor, **how):
    extra = (0.5, 7, "x", 9)
    df = spark.createDataFrame([r + extra for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hn.mine(df, is_anchor, **how).select(*COLUMNS).collect()))


def random_rows(seed, n, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = []
    for k in range(n):
        label = int(rng.integers(4))
        v = centres[label] * rng.random() + rng.normal(size=width) * 0.4
        rows.append((k, label, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("size", [(5, 17), (2048, 4096)])
def test_equals_brute_force(spark, size):
    rows = random_rows(1, 300)
    rows += [(k + 1000, 1 + k % 2, rows[7][2]) for k in range(60)]            # copies of one vector
    rows += [(k + 2000, k % 4, [0.0] * 6) for k in range(9)]                  # zero vectors
    rows += [(3000 + k, k % 3, [round(x, 1) for x in rows[k][2]]) for k in range(60)]     # many ties
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, size=size)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_odd_rows(spark):
    rows = random_rows(2, 80) + [
        (100, None, [1.0] * 6), (110, 1, None), (120, 1, [1.0, None, 1.0]), (130, 2, [float("nan")] * 6),
        (140, 2, [float("inf"), 1.0]), (None, 1, [1.0] * 6), (150, 1, []), (160, 3, [1.0, 2.0]),
        (170, 1, [1.0] * 9), (180, 2, [-1.0] * 6), (200, 0, [1e9] * 6), (201, 0, [1e9] * 6),
        (202, 1, [6e8] * 6), (50, 1, [0.5] * 6), (50, 2, [0.25] * 6)]
    rows += [rows[0], rows[10], rows[10]]                                     # repeated rows
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, size=(4, 30))
    assert got == brute(rows, lambda i: i % 10 == 0) and got
    assert {r[0] for r in got} & {200}


def test_empty_and_lonely(spark):
    everywhere = F.lit(True)
    assert mined(spark, [], everywhere) == []
    assert mined(spark, [(0, 1, [1.0, 2.0])], everywhere) == []
    assert mined(spark, [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0])], everywhere) == []
    assert mined(spark, random_rows(3, 20), F.lit(False)) == []
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.75])]
    assert mined(spark, rows, F.col("vec_id") == 0) == [(0, 1, 1, 2, 256 * 256, 256 * 192)]


def test_other_windows(spark):
    rows = random_rows(5, 200)
    how = dict(positives=2, negatives=4, low=10, high=100, scale=64)
    assert mined(spark, rows, F.col("vec_id") % 20 == 0, size=(3, 40), **how) \
        == brute(rows, lambda i: i % 20 == 0, **how)


def test_bound_holds_and_walks_end_early():
    """No score exceeds the bound at its place, and on clustered vectors most
    of the list is never scored."""
    rng = np.random.default_rng(0)
    centres = np.abs(rng.normal(size=(40, 16))) * 0 + rng.normal(size=(40, 16))
    rows = np.floor(256 * (np.repeat(centres, 300, axis=0) + rng.normal(size=(12_000, 16)) * 0.05))
    members = rows[:8]
    shared = hn.SharedList(members, rows)
    scores = hn.inner(members, rows[shared.order])
    for at in range(0, len(rows), 97):
        assert (scores[:, at:].max(axis=1) <= shared.above(np.arange(8), at)).all()
    seen = []
    exact = hn.inner

    def counting(a, b):
        seen.append(a.shape[0] * b.shape[0])
        return exact(a, b)

    hn.inner = counting
    try:
        best = hn.nearest(np.arange(8), np.zeros(8, int), members, np.arange(12_000), np.zeros(12_000, int),
                          rows, 5)
    finally:
        hn.inner = exact
    truth = exact(members, rows)
    truth[np.arange(8), np.arange(8)] = np.iinfo(np.int64).min
    assert (np.sort(best.score, axis=1) == np.sort(np.partition(truth, -5, axis=1)[:, -5:], axis=1)).all()
    assert sum(seen) < 0.2 * truth.size
