"""A hash of a panel's variants that does not depend on their source or order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_lines(variants: DataFrame) -> DataFrame:
    """line: chrom, pos, ref, alt between tabs, in that order of rows; ids and genetic positions do not count."""
    ordered = variants.select("chrom", "pos", "ref", "alt").orderBy("chrom", "pos", "ref", "alt")
    return ordered.select(F.concat_ws("\t", F.col("chrom").cast("string"), F.col("pos").cast("string"), "ref", "alt").alias("line"))


def canonical_bytes(variants: DataFrame) -> Iterator[bytes]:
    """The canonical text in pieces; the driver holds one partition's at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(["".join(f"{x}\n" for x in lines).encode()], pa.binary())], ["piece"])

    for row in canonical_lines(variants).mapInArrow(join, "piece binary").toLocalIterator(prefetchPartitions=True):
        yield bytes(row.piece)


def variant_set_hash(variants: DataFrame) -> tuple[str, int, int]:
    """(sha256 in hex, variants, bytes)."""
    digest, n, size = hashlib.sha256(), 0, 0
    for piece in canonical_bytes(variants):
        digest.update(piece)
        n += piece.count(b"\n")
        size += len(piece)
    return digest.hexdigest(), n, size


def fingerprint(raw: DataFrame, variants: DataFrame) -> DataFrame:
    """sha, n_hashed, n_raw in one row."""
    sha, n, _ = variant_set_hash(variants)
    return raw.agg(F.count("*").alias("n_raw")).select(F.lit(sha).alias("sha"), F.lit(n).cast("long").alias("n_hashed"), F.col("n_raw").cast("long").alias("n_raw"))
