"""Session helpers shared by queries, tests and the command line."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package wherever the driver was started."""
    have = os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep) and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}{os.pathsep}{have}" if have else ROOT
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests, the bench and the command line."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("genoloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_workers(spark)
