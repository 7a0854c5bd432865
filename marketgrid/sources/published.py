"""Tables that are published in one step.

``publish`` writes a fresh version beside the others and then points to it by
renaming a small file over the former pointer, so a reader meets either the
former version or the new one as a whole, and a write that fails midway changes
nothing for readers.  The last ``keep`` versions stay, since a reader may still
be using one that was current a moment ago; older ones and the remains of
failed writes are removed by the next successful publication.

The rename replaces the pointer atomically on HDFS and local file systems.
There is one publisher of a table at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"
_VERSION = re.compile(r"version-(\d{8})-[0-9a-f]{32}")


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, root.getFileSystem(conf), root


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that readers get, None before the first."""
    jvm, _, fs, root = _files(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(root, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    if not _VERSION.fullmatch(name):
        raise RuntimeError(f"{path}: the pointer holds {name!r}")
    return name


def _point_to(spark: SparkSession, path: str, name: str) -> None:
    jvm, conf, fs, root = _files(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(root, f"_pointer-{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
    context.rename(context.makeQualified(fresh),
                   context.makeQualified(jvm.org.apache.hadoop.fs.Path(root, POINTER)), how)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of versions, finished or not, oldest first."""
    _, _, fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if _VERSION.fullmatch(n))


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Make ``df`` the table at ``path``; the name of its version."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    spark, root = df.sparkSession, path.rstrip("/")
    before = current_version(spark, root)
    number = int(_VERSION.fullmatch(before)[1]) + 1 if before else 1
    name = f"version-{number:08d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{name}")
    _point_to(spark, root, name)
    jvm, _, fs, base = _files(spark, root)
    finished = [n for n in versions(spark, root)
                if fs.exists(jvm.org.apache.hadoop.fs.Path(base, f"{n}/_SUCCESS"))]
    # others that are as new as the former one were never current
    former = [n for n in finished if before and n[:16] < before[:16]] + ([before] if before else [])
    for old in set(versions(spark, root)) - set(former[len(former) - keep + 1:]) - {name}:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, old), True)
    return name


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version; FileNotFoundError before the first."""
    name = current_version(spark, path)
    if name is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")
