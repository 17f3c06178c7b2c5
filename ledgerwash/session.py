"""Spark session helpers.

The library itself never creates a session: every public function takes a
DataFrame (or a ``SparkSession``) from the caller. These helpers are for tests,
``bench.py`` and ad-hoc runs on a single machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness and for the plans this library expects;
# all can be set on a running session. The rest is left to the cluster defaults.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keep every generated method under HotSpot's 8000-byte JIT limit (the
    # Spark docs recommend this on HotSpot): the cleaning projection fused
    # with a scan can outgrow it, and an uncompiled method runs interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
BASE_CONF = {
    **RUNTIME_CONF,
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ledgerwash",
                  extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("LEDGERWASH_DRIVER_MEMORY", "8g")))
    for key, value in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Where it is unset, a ``local`` master (one
    machine, as in tests) gets a scratch folder; any other master raises,
    since executors do not share their local disks."""
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="ledgerwash-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
