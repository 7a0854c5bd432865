"""Packing documents into batches by optimal length buckets.

1. The lengths of all documents make one global histogram.  Lengths below
   1,024 count as they are; longer ones are rounded up to one of 512 steps
   per power of two, so the histogram stays below 12,000 rows at any size.
2. Dynamic programming chooses ``buckets`` upper bounds out of the lengths
   that occur: best[k][j] = min over i of best[k-1][i] + padding of the
   lengths i+1..j when all are filled up to length j.  The padding is counted
   from true lengths.  Ties go to the smaller i.
3. Documents of a bucket stand in doc_id order and fill batches of
   ``token_budget // bound`` documents (at least one).  Positions come from a
   range partitioning with running totals per partition, so a bucket with a
   third of all rows is spread over many tasks.

Edge cases: a null or empty text has length 0 and is padded like any other;
repeated rows take places of their own; rows without a doc_id come first; fewer distinct lengths than buckets
give one bucket per length; an empty table gives an empty result.  A document
longer than the token budget is a batch of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialize

BUCKETS = 8
TOKEN_BUDGET = 65_536
WORDS = r"[^\x20\x09-\x0D]+"


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens (words) of every whole text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("bigint"),
                                  F.lit(0).cast("bigint")).alias("n_tokens"))


def step_length(n: Column) -> Column:
    """The histogram's length for a length: the next step up."""
    step = F.pow(F.lit(2.0), F.length(F.bin(n)) - 10).cast("bigint")
    return F.when(n < 1024, n).otherwise(F.ceil(n / step) * step).cast("bigint")


def choose_bounds(sizes: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds for ascending ``sizes`` with ``n`` documents of ``total``
    true length each; minimal padding."""
    g = len(sizes)
    k_max = min(buckets, g)
    docs = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    toks = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    best = np.full((k_max + 1, g + 1), np.iinfo(np.int64).max // 4, np.int64)
    cut = np.zeros((k_max + 1, g + 1), np.int64)
    best[0, 0] = 0
    for k in range(1, k_max + 1):
        for j in range(k, g + 1):
            cost = best[k - 1, :j] + sizes[j - 1] * (docs[j] - docs[:j]) - (toks[j] - toks[:j])
            cut[k, j] = i = int(np.argmin(cost))
            best[k, j] = cost[i]
    bounds, j = [], g
    for k in range(k_max, 0, -1):
        bounds.append(int(sizes[j - 1]))
        j = int(cut[k, j])
    return bounds[::-1]


def bucket_bounds(sized: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The bounds for a table with n_tokens.  Only the histogram, bounded as
    described above, comes to the driver."""
    rows = (sized.groupBy(step_length(F.col("n_tokens")).alias("size"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
            .orderBy("size").collect())
    if not rows:
        return []
    return choose_bounds(np.array([r["size"] for r in rows], np.int64),
                         np.array([r["n"] for r in rows], np.int64),
                         np.array([r["total"] for r in rows], np.int64), buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (number in the bucket),
    n_pad of every document."""
    sized = materialize(lengths(docs))
    bounds = bucket_bounds(sized, buckets) or [0]
    levels = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    bucket = F.size(F.filter(levels, lambda b: b < F.col("n_tokens")))
    placed = sized.select("doc_id", "n_tokens", bucket.alias("bucket"))
    ranged = materialize(placed.repartitionByRange("bucket", "doc_id", "n_tokens")
                         .withColumn("part", F.spark_partition_id()))
    # one row per partition and bucket it holds
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("part", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("part", "bucket").orderBy("doc_id", "n_tokens")
    bound = F.element_at(levels, F.col("bucket") + 1)
    fit = F.greatest(F.lit(1).cast("bigint"),
                     F.floor(F.lit(token_budget) / F.nullif(bound, F.lit(0))).cast("bigint"))
    return (ranged.withColumn("place", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), ["part", "bucket"])
            .withColumn("bucket_len", bound)
            .select("doc_id", "n_tokens", "bucket", "bucket_len",
                    F.when(F.col("bucket_len") > 0,
                           F.floor((F.col("start") + F.col("place")) / fit))
                    .otherwise(F.lit(0)).cast("bigint").alias("batch"),
                    (F.col("bucket_len") - F.col("n_tokens")).alias("n_pad")))
