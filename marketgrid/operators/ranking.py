"""Order statistics that never hold a whole group in one task.

A window ``PARTITION BY g ORDER BY v`` (or a global ``ORDER BY`` with no
partition) sends every row of a group to one task; with one group holding a
third of the data, that task is the job.  Here positions are computed on the
*frequency table* of distinct (group, value) pairs, spread over range
partitions, so a hot group spans many tasks:

1. ``freq``: groupBy(g, v).count() — partial aggregation, a repeated value
   collapses to one row per map task.
2. ``repartitionByRange(g, v)``: sampled bounds split a large group over many
   partitions; the partition index is taken as a column and the result is
   written to reliable storage (``lineage.materialize``), so the index is
   fixed even if an executor is lost and a stage re-runs.
3. per (partition, g) totals -> running offsets per g ordered by partition
   (at most one row per partition and group);
4. per (partition, g) running counts inside the partition (bounded by the
   partition size), plus the offset = number of rows before the value.

The average-tie percent rank and row positions for folds are formulas on
(n_before, n_equal, n_group).  Quantiles need the order near a few ranks only and
are selected without ordering the rest (``exact_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach_scalars
from .lineage import materialize


def value_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                    num_partitions: int | None = None, sums: dict | None = None) -> DataFrame:
    """Distinct (group, order values) with ``n_before`` (rows of the group
    strictly before, in ascending order), ``n_equal`` and ``n_group``.
    Rows with a null order value are ignored (as pandas ranks/quantiles do).
    ``sums``: name -> column to be summed per distinct value.
    """
    g, o = list(group_cols), list(order_cols)
    sums = sums or {}
    src = df.select(*g, *o, *[c.alias(n) for n, c in sums.items()])
    for c in o:
        src = src.filter(F.col(c).isNotNull())
    freq = src.groupBy(*g, *o).agg(F.count(F.lit(1)).alias("_n_eq"),
                                   *[F.sum(n).alias(n) for n in sums])
    keys = [F.col(c).asc() for c in g + o]
    # Without an explicit count AQE may coalesce the range partitions; it only
    # merges neighbours, so partition ids stay in key order.  The partition
    # index must not change between the two reads below, so the table is
    # written once (this also survives lost executors).
    ranged = (freq.repartitionByRange(num_partitions, *keys) if num_partitions
              else freq.repartitionByRange(*keys))
    ranged = materialize(ranged.withColumn("_pid", F.spark_partition_id()))
    ptot = ranged.groupBy("_pid", *g).agg(F.sum("_n_eq").alias("_pn"))
    w_off = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ptot = (ptot.withColumn("_off", F.coalesce(F.sum("_pn").over(w_off), F.lit(0)))
            .withColumn("n_group", F.sum("_pn").over(Window.partitionBy(*g))))
    w_loc = (Window.partitionBy("_pid", *g).orderBy(*o)
             .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn("_loc", F.coalesce(F.sum("_n_eq").over(w_loc), F.lit(0)))
    return (local.join(ptot, ["_pid", *g])
            .select(*g, *o, (F.col("_off") + F.col("_loc")).alias("n_before"),
                    F.col("_n_eq").alias("n_equal"), "n_group", *sums))


def pct_rank_average(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                     out_col: str = "pct_rank") -> DataFrame:
    """Percent rank with ties given their average rank (1-based) / n,
    e.g. values 1, 2, 2, 4 -> 0.25, 0.625, 0.625, 1.0.  Null value -> null."""
    g = list(group_cols)
    pos = value_positions(df, g, [value_col])
    pct = (F.col("n_before") + (F.col("n_equal") + 1) / 2.0) / F.col("n_group")
    pos = pos.select(*g, value_col, pct.alias(out_col))
    return df.join(pos, [*g, value_col], "left")


#: Rank error of the sketches (one in so many) that bracket a quantile, and size
#: up to which a group is its own bracket.  Above it, three times the error on
#: either side is three ranks or more, so both neighbours lie inside.
ACCURACY = SMALL = 100_000


def _brackets(src: DataFrame, value_col: str, qs: Sequence[float], g: list[str]) -> DataFrame:
    """Per group ``n`` and ``brackets``: for quantile k the values between which
    both of its neighbours in rank lie."""
    shares = [min(1.0, max(0.0, q + d * 3 / ACCURACY)) for q in qs for d in (-1, 1)]
    s = src.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"),
                            F.percentile_approx(value_col, F.array(*map(F.lit, shares)), ACCURACY).alias("_p"))
    whole = F.col("n") <= SMALL

    def end(k: int, side: int) -> Column:
        least = "_lo" if side == 0 else "_hi"
        return F.when(whole | F.lit(shares[2 * k + side] == side), F.col(least)).otherwise(F.col("_p")[2 * k + side])

    return s.select(*g, "n", F.array(*[F.struct(F.lit(k).alias("k"), end(k, 0).alias("lo"), end(k, 1).alias("hi"))
                                       for k in range(len(qs))]).alias("brackets"))


def exact_quantiles(df: DataFrame, value_col: str, qs: Sequence[float],
                    group_cols: Sequence[str] = (), names: Sequence[str] | None = None
                    ) -> DataFrame:
    """Linear-interpolated quantiles per group (pandas/numpy 'linear',
    SQL ``quantile_cont``): at p = q·(n−1), v[⌊p⌋] + (v[⌈p⌉] − v[⌊p⌋])·(p − ⌊p⌋).
    One row per group.

    Exact by selection: a mergeable sketch per group brackets each quantile
    within 6 / ACCURACY of the group's rows (a group of up to SMALL rows is its
    own bracket); rows below a bracket are counted, and only distinct values
    inside one are sorted.  Values outside are never shuffled, nothing is
    written, and what one task sorts is that small share of a group.
    """
    g = list(group_cols)
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    src = df.select(*g, F.col(value_col).alias("_v")).filter(F.col("_v").isNotNull())
    sketched = _brackets(src, "_v", qs, g)
    placed = src.join(sketched, g) if g else attach_scalars(src, sketched)
    below = placed.groupBy(*g).agg(F.max("n").alias("n"), *[
        F.count_if(F.col("_v") < F.col("brackets")[k]["lo"]).alias(f"_b{k}") for k in range(len(qs))])
    inside = F.filter("brackets", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    near = (placed.select(*g, "_v", F.explode(F.transform(inside, lambda b: b["k"])).alias("_k"))
            .groupBy(*g, "_k", "_v").agg(F.count(F.lit(1)).alias("_n_eq")))
    before = Window.partitionBy(*g, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_in", F.coalesce(F.sum("_n_eq").over(before), F.lit(0)))
    near = near.join(below, g) if g else attach_scalars(near, below)
    aggs = []
    for k, (q, nm) in enumerate(zip(qs, names)):
        p = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(p), F.ceil(p)
        first = F.col(f"_b{k}") + F.col("_in")

        def at(pos: Column) -> Column:
            hit = (F.col("_k") == k) & (first <= pos) & (pos < first + F.col("_n_eq"))
            return F.max(F.when(hit, F.col("_v")))

        aggs += [at(lo).alias(f"_{nm}_lo"), at(hi).alias(f"_{nm}_hi"), F.max(p - lo).alias(f"_{nm}_f")]
    res = near.groupBy(*g).agg(*aggs)
    out = [F.col(f"_{nm}_lo") + (F.col(f"_{nm}_hi") - F.col(f"_{nm}_lo")) * F.col(f"_{nm}_f")
           for nm in names]
    return res.select(*g, *[c.alias(nm) for c, nm in zip(out, names)])


def exact_median(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                 name: str = "median") -> DataFrame:
    return exact_quantiles(df, value_col, [0.5], group_cols, [name])


def row_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  out_col: str = "pos") -> DataFrame:
    """0-based row position inside the group; ``order_cols`` must be unique
    within the group (add the key as a last tie-break)."""
    g, o = list(group_cols), list(order_cols)
    pos = value_positions(df, g, o).select(*g, *o, F.col("n_before").alias(out_col),
                                           "n_group")
    return df.join(pos, [*g, *o], "inner")
