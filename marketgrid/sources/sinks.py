"""Sinks (S6-S8, S10) and the serving-table reader.

* ``write_master``: Parquet partitioned by quarter.  Only the quarters that the
  frame holds are replaced (dynamic partition overwrite), so a rerun for a new
  or corrected quarter leaves the files of the others as they are; readers
  prune by quarter.  Rows are rebalanced by quarter: a large quarter is written
  by several tasks, a small one by one, and no ``coalesce(1)`` puts the final
  join into a single task.
* ``write_serving_csv`` / ``read_serving_csv``: header CSV in UTF-8 (Spark
  writes no BOM; a BOM on read is dropped by the reader).
* ``write_samples`` (S10): the first ``n`` rows of every raw file, re-encoded
  as UTF-8 — a structure check of each file, not a statistical sample — in one
  distributed pass, however many files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialize
from .csv_sources import decoded, dialects, java_charsets, read_raw_csv, text_lines


def write_master(master: DataFrame, path: str, whole: bool = False) -> None:
    """Replace the quarters of ``master`` at ``path``; with ``whole`` all that
    is there.  A quarter without rows is no part of the frame and stays."""
    (master.hint("rebalance", "quarter").write.mode("overwrite")
     .option("partitionOverwriteMode", "static" if whole else "dynamic")
     .partitionBy("quarter").parquet(path))


def write_serving_csv(df: DataFrame, path: str, single_file: bool = False,
                      mode: str = "overwrite") -> None:
    """``single_file`` is for the top-k tables, whose size is bounded; other
    tables keep their partitioning."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def read_serving_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def file_heads(spark: SparkSession, pattern: str, n: int = 100) -> DataFrame:
    """The header and the first ``n`` data lines of every file: file, line
    (0 is the header), text.  One scan; a task keeps at most n + 1 lines of a
    file (the rank's limit is applied before the shuffle)."""
    lines = text_lines(spark, pattern)
    found = dialects(lines)
    # a task reads a block's lines in their order, so ids within a block ascend
    ids = lines.withColumn("_id", F.monotonically_increasing_id())
    order = Window.partitionBy("file").orderBy("at", "_id")
    heads = ids.withColumn("line", F.row_number().over(order) - 1).filter(F.col("line") <= n)
    with java_charsets(spark):
        return heads.join(found, "file").select("file", "line", decoded(F.col("value"), F.col("utf8")).alias("text"))


def write_samples(spark: SparkSession, pattern: str, out_dir: str, n: int = 100) -> DataFrame:
    """``file_heads`` as UTF-8 text, one folder ``sample=<name>`` per file
    name below ``out_dir``, all in one job; what was written."""
    name = F.element_at(F.split(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "/"), -1)
    heads = materialize(file_heads(spark, pattern, n).withColumn("sample", name))
    (heads.repartition("sample").sortWithinPartitions("sample", "file", "line")
     .select("sample", "text").write.mode("overwrite").partitionBy("sample").text(out_dir))
    return heads


def sample_counts(spark: SparkSession, raw_dir: str, names: list[str], n: int = 100) -> DataFrame:
    """S10 for raw datasets that are folders of part files: the first n rows of
    each dataset as (dataset, n_rows, n_columns)."""
    parts = []
    for name in names:
        df = read_raw_csv(spark, f"{raw_dir.rstrip('/')}/{name}")
        parts.append(df.limit(n).agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("dataset"), "n_rows",
                             F.lit(len(df.columns)).alias("n_columns")))
    return reduce(DataFrame.unionByName, parts)
