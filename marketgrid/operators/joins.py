"""Join helpers.

* ``attach_scalars``: a global aggregate (no grouping keys) is exactly one
  row; it is attached as a scalar subquery (evaluated once, partial
  aggregation on the executors, the value then shipped to every task) —
  no join, no collect-to-driver of city totals (J10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row global aggregate to every row of df."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_scalars")).scalar()
    return df.withColumn("_scalars", packed).select("*", "_scalars.*").drop("_scalars")

