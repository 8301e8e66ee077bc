"""A session for local runs and tests; a cluster brings its own."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "folioseek", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_scratch(spark)
    return spark


def ensure_scratch(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only where none is set (tests, one machine) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folioseek-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
