"""Tables between stages, in the folder that all machines share.

``spark.checkpoint.dir`` names that folder.  Where it is unset (tests, local
mode) a temporary one is made and set.  A written table cuts the lineage and
survives the loss of executors; tables are removed when the driver ends or by
:func:`clean`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="genoloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    The session still refers to the last query it ran; a trivial one takes its place first.
    """
    import gc

    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing reads any more; other frames and None are left."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            remove(df.sparkSession, path)


def clean() -> None:
    """Removes every table made by this process."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


atexit.register(clean)
