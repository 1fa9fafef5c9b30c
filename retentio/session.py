"""Spark session defaults used by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # history tables are rewritten one assessment date at a time
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "retentio",
              extra: dict | None = None) -> SparkSession:
    """Create (or return) a session with the library defaults.

    On a cluster the master and sizing come from ``spark-submit``: ``master`` and
    ``shuffle_partitions`` are set only when given (local runs). ``spark.sql.shuffle.partitions``
    should be sized so one shuffle partition holds ~128-256 MB at the target scale; AQE
    coalesces small ones.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, else the one the context already has.

    Only where neither is set, ``fallback`` is used; without one, a fresh temporary folder in
    local mode, and an error on a cluster, whose executors could not see a folder of the driver's.
    """
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not cur:
        one_machine = sc.master == "local" or sc.master.startswith("local[")
        if not fallback and not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = fallback or tempfile.mkdtemp(prefix="retentio-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(cur)
    return cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)
