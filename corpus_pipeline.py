"""From raw documents to packed batches, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. quality rules: documents that the rules reject go;
2. language ID: documents without a recognisable language go;
3. near-dedup: of each group linked by 5-word shingles (similarity 0.8 or
   more) the document with the smallest doc_id stays;
4. substring dedup: passages of 50 words that an earlier document holds go
   from the texts (n_chars follows);
5. packing: batches by length buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrid.llm import language_id, near_dedup, packing, quality_rules, substring_dedup
from marketgrid.llm.common import documents, ship_package
from marketgrid.operators.lineage import materialize
from marketgrid.session import ensure_checkpoint_dir


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return near_dedup.keep_one(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    out = substring_dedup.remove_repeated(docs, size=50)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint"))
    return out.select(*docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", batches),
]

#: The language network, the set sketches and the thresholds from sketches
#: have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
