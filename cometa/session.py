"""Session helpers: building a local session for tests and resolving the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# The audit fuses ~40 regex checks into one CASE; whole-stage code that big
# exceeds HotSpot's 8000-byte JIT limit and runs interpreted (measured 2x
# slower). This documented knob makes Spark fall back to per-expression
# codegen for just those subtrees. ``local_session`` sets it; the operators
# never change a caller's session (see "Cluster settings" in the README).
HUGE_METHOD_KEY = "spark.sql.codegen.hugeMethodLimit"
JIT_METHOD_LIMIT = "8000"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cometa") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config(HUGE_METHOD_KEY, JIT_METHOD_LIMIT)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    filesystem path). Only in a one-machine ``local`` session where it is
    unset -- tests -- do we pick a scratch folder of our own; on a cluster a
    folder of the driver's machine would hold only part of each table.
    """
    conf_dir = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not conf_dir:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="cometa-ckpt-", dir=os.environ.get("COMETA_SCRATCH", "/tmp"))
        spark.conf.set(CHECKPOINT_KEY, conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and return it read back: the lineage is cut (later passes -- class
    weights, feature fits, validation -- read the table instead of recomputing
    scans, joins and windows), and a lost executor costs a re-read, not a
    recomputation."""
    path = shared_path(df.sparkSession, f"{name}_{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
