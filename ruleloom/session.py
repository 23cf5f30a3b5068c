"""Sessions, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "ruleloom", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster the caller's own session does."""
    n = cores or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.master(f"local[{n}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8" if n == "*" else n,
    }
    return builder.config(map=defaults | conf).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir; a temporary folder only where none is set and everything runs on this machine."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ruleloom-"))
    return df.checkpoint()
