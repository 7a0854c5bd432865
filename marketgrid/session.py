"""Session helpers.

``get_session`` is for local runs (tests, bench).  Library code only calls
``ensure_checkpoint_dir``: it uses the cluster's ``spark.checkpoint.dir`` and
creates a private folder only when Spark runs in local mode and none is set.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "marketgrid", cores: int | str = "*",
                shuffle_partitions: int = 8, memory: str = "8g",
                extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local temp folder is only used in
    local mode when nothing is configured.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if re.match(r"local(\[|$)", sc.master):
        path = tempfile.mkdtemp(prefix="marketgrid-ckpt-",
                                dir=os.environ.get("MARKETGRID_SCRATCH"))
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
