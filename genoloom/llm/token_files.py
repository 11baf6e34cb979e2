"""Token ids in Parquet files, in document order (operator 3).

Layout under one folder::

    tokens/    doc_id, part, start_in_part, n_tokens, ids list<int>
    manifest/  part, first_doc_id, n_docs, n_tokens, start

Rows are range-partitioned and sorted by doc_id, so the files in order of
``part`` are the corpus in order.  ``ids`` is dictionary-encoded, falling back
to (or, if asked for, always) delta binary packing; row groups and pages are
kept small and indexed, so that a reader of a few documents, or of the metadata
alone, skips the other pages and the ids.  ``start_in_part`` and the manifest
give the place of a document among all ids without reading any of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkernel import list_array

TOKENS = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Most ids of one Arrow batch on the way back to the JVM.
BATCH_IDS = 1_000_000


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 512,
) -> None:
    """Encodes every whole text, appends end_id and writes the files.

    Null text is an empty one (its ids are end_id alone).  Rows with equal
    doc_id are ordered by text, null ids come first; an empty table gives files
    without rows.  encoding is ``dictionary`` or ``delta``.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from . import bpe

        tok = bpe.load(tokenizer)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in bpe.blocks(batch.column(1)):
                ids, counts = tok.encode(data, offsets)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                counts = counts + 1
                stop = np.cumsum(counts)
                row = 0
                while row < len(counts):
                    done = stop[row] - counts[row]
                    end = max(row + 1, int(np.searchsorted(stop, done + BATCH_IDS, side="right")))
                    n = counts[row:end]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a + row, end - row),
                            pa.array(np.full(end - row, part, np.int32)),
                            pa.array(start + stop[row:end] - n),
                            pa.array(n),
                            list_array(ids[done : stop[end - 1]], n, pa.int32()),
                        ],
                        ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                    )
                    row = end
                start += int(stop[-1]) if len(stop) else 0

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, TOKENS)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    rows.write.options(**options).parquet(f"{path}/tokens")
    tokens = docs.sparkSession.read.schema(TOKENS).parquet(f"{path}/tokens")
    parts = tokens.groupBy("part").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # one row a file: small enough for one task, however many documents there are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, metadata_only: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, unless metadata_only, ids.

    Filters on doc_id and the choice of columns reach the Parquet pages.
    """
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    manifest = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("part_start"))
    out = tokens.join(manifest, "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))
    return out.select("doc_id", "start", "n_tokens", *([] if metadata_only else ["ids"]))


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            ids = batch.column(3)
            raw = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
            stop = np.cumsum(batch.column(2).to_numpy()).tolist()
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip([0, *stop], stop, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
