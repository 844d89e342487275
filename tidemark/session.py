"""Session defaults.

Only settings a job may change at run time are touched on a session it was given; memory,
cores and shuffle width belong to the cluster.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins are left unhinted: the adaptive planner broadcasts a side only after it has
    # measured it, and splits a skewed partition otherwise, also where that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, app: str = "tidemark", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint directory.

    Only a session on one machine may go without the setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def written(df: DataFrame) -> DataFrame:
    """The rows from files in the shared folder: read more than once without being computed again, kept by
    no executor, and removed when no frame refers to them any more (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same rows for several readers: each reads all columns, so the plans below are alike and Spark reuses their
    shuffles instead of computing one for every choice of columns.

    Rows stay where `keys` dealt them; conditions on other columns do not go below.
    """
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.select(*keys, F.inline(F.array(rest))).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """For heavy work on rows: a table that lies in fewer pieces than there are cores is dealt out to all of them first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
