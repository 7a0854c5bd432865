"""Raw CSV ingest (S1, S2, S3, S9, S11) and per-dataset typing.

The raw files come in two header dialects (Korean names or English API
codes) and two encodings (UTF-8, possibly with a BOM, or CP949).  Spark's CSV
reader takes the column names of *one* file and applies them by position to
every file of a read, so a glob over mixed dialects silently mis-reads
re-ordered columns.  Here all files are read as text, whose lines keep their
bytes and their file:

1. ``dialects``: one aggregation gives each file's header line and whether all
   its lines are valid UTF-8 (else CP949), and with the header the canonical
   names in the file's order.  One row per file, written once; only the number
   of columns and the distinct names come to the driver;
2. ``read_raw_csv``: one scan of the lines joined with that table by file.  A
   line is decoded and split (``from_csv``) as its file's row says, and fields
   go to their names by the file's positions.  So the number of scans does not
   depend on the number of headers, encodings or files, and nothing is done
   file by file.

A required column that no file has is an error.  A line with an odd number of
quotes would be part of a quoted line break, which this line reader refuses
with an error.  Empty lines, and lines of a file's first block that equal its
header, are no rows; an empty file has none.  All columns are read as strings
and typed with ``try_cast`` (malformed text -> null, as the source pipeline's
Spark 2 casts did; ANSI stays on); decimal text such as ``123.0`` is cut to its
whole part for integer columns, as those casts did.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HEADER_ALIASES
from ..operators.lineage import materialize

CP949 = "x-windows-949"  # Java's name; "cp949"/"EUC-KR" lose rare syllables

RENAME: dict[str, str] = {alias: canon for canon, pair in HEADER_ALIASES.items()
                          for alias in pair}

SCHEMAS: dict[str, dict[str, str]] = {
    "sales": {"quarter": "int", "area_id": "string", "industry": "string",
              "sales_amt": "bigint", "sales_cnt": "bigint", "amt_20s": "bigint",
              "amt_30s": "bigint"},
    "stores": {"quarter": "int", "area_id": "string", "industry": "string",
               "stores": "bigint", "opened": "bigint", "closed": "bigint"},
    "foot": {"quarter": "int", "area_id": "string", "foot": "bigint"},
    "area": {"area_id": "string", "area_type": "string", "area_name": "string",
             "district": "string", "neighbourhood": "string", "x": "double", "y": "double"},
}


def text_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of all files below a glob or directory: file, at (begin of the
    block that the line was read in), value (its bytes, as text)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        raise FileNotFoundError(pattern)
    return (spark.read.format("text").option("recursiveFileLookup", True).load(pattern)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("at"), "value"))


@contextmanager
def java_charsets(spark: SparkSession):
    """Spark 4 accepts only the standard charsets unless a setting is on; it
    is on only while frames are planned or written, then as it was."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def decoded(value: Column, utf8: Column) -> Column:
    """Text of a line's bytes, without a byte order mark.  To be planned within
    ``java_charsets``."""
    other = F.decode(value.cast("binary"), CP949)
    return F.regexp_replace(F.when(utf8, value).otherwise(other), "^\ufeff", "")


def dialects(lines: DataFrame) -> DataFrame:
    """File, utf8, header (its line's bytes in hex) and names
    (canonical where known, in the file's order), one row per file."""
    per_file = lines.groupBy("file").agg(
        F.min(F.is_valid_utf8("value").cast("int")).cast("boolean").alias("utf8"),
        F.first(F.when(F.col("at") == 0, F.hex(F.col("value").cast("binary"))),
                ignorenulls=True).alias("header"))
    known = F.create_map(*[F.lit(x) for pair in RENAME.items() for x in pair])
    with java_charsets(lines.sparkSession):
        text = decoded(F.unhex("header").cast("string"), F.col("utf8"))
        parts = F.transform(F.split(text, ","), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
        named = per_file.withColumn("names", F.transform(parts, lambda c: F.coalesce(known[c], c)))
        return materialize(named)


def read_raw_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Read files (glob or directory) with mixed headers/encodings into
    one all-string frame with canonical column names."""
    lines = text_lines(spark, pattern)
    found = dialects(lines)
    wide, names = found.agg(F.max(F.size("names")), F.array_sort(F.array_distinct(
        F.flatten(F.collect_set("names"))))).first()
    if not names:
        raise FileNotFoundError(f"{pattern}: only empty files")
    # the planner broadcasts the table of files if it is small; a large file's
    # lines are split among tasks if not
    rows = (lines.join(found, "file")
            .filter(~((F.col("at") == 0) & (F.hex(F.col("value").cast("binary")) == F.col("header")))))
    with java_charsets(spark):
        text = decoded(F.col("value"), F.col("utf8"))
        quotes = F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit("")))
        broken = F.raise_error(F.concat(F.lit("a quoted line break in "), F.col("file")))
        rows = rows.select("names", F.when(quotes % 2 == 1, broken).otherwise(text).alias("text"))
        rows = rows.filter(F.trim("text") != "")
        schema = ", ".join(f"c{k} string" for k in range(wide))
        rows = rows.select("names", F.from_csv("text", schema, {"mode": "PERMISSIVE"}).alias("c"))
        fields = rows.select("names", F.array(*[F.col(f"c.c{k}") for k in range(wide)]).alias("c"))
        # positions count from 1, 0 stands for no such column
        return fields.select(*[F.get("c", F.array_position("names", n).cast("int") - 1).alias(n) for n in names])


def typed(df: DataFrame, dataset: str) -> DataFrame:
    """Keep the dataset's columns, cast to their types.  A required
    column that is absent from all files raises ValueError."""
    missing = [c for c in SCHEMAS[dataset] if c not in df.columns]
    if missing:
        raise ValueError(f"{dataset}: no file has column(s) {', '.join(missing)}")
    return df.select(*[_cast(name, typ).alias(name) for name, typ in SCHEMAS[dataset].items()])


def _cast(name: str, typ: str) -> Column:
    text = F.trim(F.col(name).cast("string"))
    if typ == "string":
        return F.col(name).cast("string")
    if typ == "double":
        return text.try_cast(typ)
    whole = F.regexp_extract(text, r"^([+-]?\d+)\.\d*$", 1)
    return F.coalesce(text.try_cast(typ), F.nullif(whole, F.lit("")).try_cast(typ))


def read_sources(spark: SparkSession, raw_dir: str):
    """The four raw datasets of a raw folder, typed, canonical names:
    ``sales_*.csv``, ``stores_*.csv``, ``foot_traffic.csv``, ``area.csv``."""
    root = raw_dir.rstrip("/")
    return (typed(read_raw_csv(spark, f"{root}/sales_*.csv"), "sales"),
            typed(read_raw_csv(spark, f"{root}/stores_*.csv"), "stores"),
            typed(read_raw_csv(spark, f"{root}/foot_traffic.csv"), "foot"),
            typed(read_raw_csv(spark, f"{root}/area.csv"), "area"))
