"""Helpers shared by the operators: reading, Arrow slicing, memory of words."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest text payload handled at once inside a task.
SLICE_BYTES = 2 << 20
#: Rows per Arrow batch, unless the session says otherwise: documents are large.
BATCH_ROWS, _SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts read; a null text is empty.
    Other columns, whatever their names, never reach the operator.  A doc_id
    that is a long is taken without an alias: Spark removes one on one side of
    a self join only, and then does not see that both sides shuffle the same."""
    doc_id = F.col("doc_id")
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        doc_id = doc_id.cast("bigint").alias("doc_id")
    return docs.select(doc_id, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes at
    most; a row longer than that stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(sizes), 0))
        part = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, n]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


class TwoGenerations(dict):
    """A bounded memo: ``self[key]`` computes missing values with ``make``.
    When the young generation holds ``size`` bytes (of keys, values and about
    ``ENTRY`` for each pair) it becomes the old one, so keys in steady use
    survive and memory stays below two generations, whatever the keys' length."""

    ENTRY = 200

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old, self.held = make, size, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held >= self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += len(key) + len(value) + self.ENTRY
        return value


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` of ``docs`` and all others in one struct, so that
    none of them can meet a working name of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*others or [F.lit(None).cast("int").alias("none")]).alias("_carried"))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame that came from ``carried(docs)``."""
    held = set(df.schema["_carried"].dataType.names)
    return df.select(*[F.col("_carried")[c].alias(c) if c in held else F.col(c) for c in docs.columns])


def partitions_for(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """Number of groups so that each holds about ``rows_each`` rows; counts
    the rows (for a Parquet scan this reads file footers only)."""
    return max(least, -(-df.count() // rows_each))


def append_columns(df: DataFrame, fields: str,
                   make: Callable[[], Callable[[pa.RecordBatch], list]],
                   column: str = "text") -> DataFrame:
    """``df`` with the columns ``fields`` ("name type, ...") that ``make()``,
    called once per task, gives for every Arrow batch; the rows and columns
    of ``df`` stay."""
    from pyspark.sql.types import StructType
    extra = StructType.fromDDL(fields).fields
    clash = {f.name for f in extra} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = df.columns + [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in slices(batches, column):
            yield pa.RecordBatch.from_arrays([*b.columns, *compute(b)], names=names)

    return df.mapInArrow(run, StructType(df.schema.fields + extra))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: the package
    goes to the executors as a zip file, once per Spark application.  Arrow
    batches of the default number of rows are made smaller."""
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_marketgrid_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="marketgrid-")) / "marketgrid.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._marketgrid_shipped = True
