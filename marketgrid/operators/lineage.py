"""Cutting lineage with a written table on reliable storage.

``materialize`` writes a DataFrame as Parquet under the session's checkpoint
folder (``spark.checkpoint.dir``: shared storage on a cluster) and returns a
frame that reads it back.  Later stages, and retries after a lost executor,
start from the written files instead of recomputing the upstream plan.

Compared with ``Dataset.checkpoint`` this is one job instead of two (a
reliable checkpoint first computes, then runs a second job to write), and
readers get Parquet column pruning and filter pushdown on the written table.

Written tables stay until ``release``, since lazy results read them; a
long-lived session calls it once the results of its queries are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


_written: list[str] = []
_tables: list[str] = []


def table_dir(df: DataFrame) -> str:
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    _written.append(f"{base}/marketgrid-tables/{uuid.uuid4().hex}")
    return _written[-1]


def table_name(kind: str) -> str:
    """A name for a catalog table, which ``release`` drops."""
    _tables.append(f"marketgrid_{kind}_{uuid.uuid4().hex}")
    return _tables[-1]


def release(spark: SparkSession) -> int:
    """Delete every table this process has written, with its entry in the
    catalog; how many folders went."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS `{_tables.pop()}`")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame) -> DataFrame:
    path = table_dir(df)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_small(df: DataFrame) -> DataFrame:
    """``materialize`` for a result far smaller than what it is computed from:
    its rows are shuffled first, so that it has files by its own size and not
    one for each task."""
    return materialize(df.hint("rebalance"))
