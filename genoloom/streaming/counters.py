"""Per-sample counters over a stream of variant shards.

An extension beyond the batch commands: heterozygous and called counts are sums,
so shards of a bound panel that arrive as files can be added up as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..model import AUTOSOMES

SHARD = "canonical_row long, chrom int, g array<tinyint>"


def stream_shards(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet shards of bound variants."""
    return spark.readStream.schema(SHARD).parquet(path)


def running_counters(shards: DataFrame) -> DataFrame:
    """out_ord, het, called so far; autosomes alone.  Works on a stream and on a table."""
    return cells.place_sums(shards.where(F.col("chrom").between(min(AUTOSOMES), max(AUTOSOMES)))).drop("n")
