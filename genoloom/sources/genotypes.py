"""Genotype files as rows of dosage arrays.

A Spark data source reads any range of rows of a binary file by itself.  Records
of fixed width are decoded by a table look-up over whole blocks.  For .pgen files of
variable width each task reads the part of the header that is about its own rows
(see :mod:`.pgen`), so the driver never holds an entry for each variant.  Codes are
from the public format descriptions.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import IOFailed
from . import pgen
from .text import numbered_lines

MISSING = -9
SCHEMA = "row_idx long, g array<tinyint>"
#: Cells that one task decodes at most, about.
TASK_CELLS = 64_000_000

# Dosage of ALT by two-bit code, of each format (None: missing).
CODES = {
    "bed": (2, None, 1, 0),
    "pgen": (0, 1, 2, None),
    "geno": (2, 1, 0, None),
}


@dataclass(frozen=True)
class Layout:
    """Where records are and how they are packed."""

    kind: str
    path: str
    n_variants: int
    n_samples: int
    start: int
    width: int


def layout(path: str, n_variants: int, n_samples: int) -> Layout:
    """Looks at the first bytes of a .bed, .pgen or packed .geno file, and checks its size."""
    with open(path, "rb") as f:
        head = f.read(64)
    width = (n_samples + 3) // 4
    if head[:3] == b"\x6c\x1b\x01":
        out = Layout("bed", path, n_variants, n_samples, 3, width)
    elif head[:2] == b"\x6c\x1b" and head[2:3] == b"\x02":
        counts = np.frombuffer(head[3:11], dtype="<u4")
        if int(counts[1]) != n_samples:
            raise IOFailed(f"{path} has {counts[1]} samples, its sample table {n_samples}")
        out = Layout("pgen", path, int(counts[0]), n_samples, 12, width)
    elif head[:5] == b"GENO ":
        width = max(48, width)
        counts = head.split(b"\0")[0].split()
        if int(counts[1]) != n_samples:
            raise IOFailed(f"{path} has {counts[1].decode()} samples, its sample table {n_samples}")
        out = Layout("geno", path, int(counts[2]), n_samples, width, width)
    elif head[:3] == b"\x6c\x1b\x10":
        counts = np.frombuffer(head[3:11], dtype="<u4")
        if int(counts[1]) != n_samples:
            raise IOFailed(f"{path} has {counts[1]} samples, its sample table {n_samples}")
        out = Layout("pgen-variable", path, int(counts[0]), n_samples, 12, 0)
        if os.path.getsize(path) < pgen.first_record(path):
            raise IOFailed(f"{path} ends before its first record")
    elif head[:2] == b"\x6c\x1b":
        raise IOFailed(f"{path}: storage mode 0x{head[2]:02x} is not supported; rewrite it with fixed-width records")
    else:
        raise IOFailed(f"{path} is no genotype file that is known here")
    if os.path.getsize(path) < out.start + out.width * out.n_variants:
        raise IOFailed(f"{path} ends before its last record")
    return out


def is_packed_eigenstrat(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(6).startswith((b"GENO ", b"TGENO "))


def decode(raw: bytes, rows: int, n_samples: int, kind: str) -> np.ndarray:
    """rows x n_samples dosages, MISSING where there is none."""
    table = np.array([MISSING if x is None else x for x in CODES[kind]], dtype=np.int8)
    shifts = (6, 4, 2, 0) if kind == "geno" else (0, 2, 4, 6)
    every = np.array([[table[b >> s & 3] for s in shifts] for b in range(256)], dtype=np.int8)
    packed = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
    return every[packed].reshape(rows, -1)[:, :n_samples]


def encode_pgen(g: np.ndarray) -> bytes:
    """Fixed-width records of dosages 0, 1, 2 (anything else is missing)."""
    rows, n = g.shape
    code = np.full((rows, (n + 3) // 4 * 4), 0, dtype=np.uint8)
    code[:, :n] = np.where((g >= 0) & (g <= 2), g, 3)
    code = code.reshape(rows, -1, 4)
    return (code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6).tobytes()


def pgen_header(n_variants: int, n_samples: int) -> bytes:
    return b"\x6c\x1b\x02" + np.array([n_variants, n_samples], dtype="<u4").tobytes() + b"\x40"


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))


def _batch(first: int, g: np.ndarray, rows: int, n_samples: int) -> pa.RecordBatch:
    values = pa.array(g, type=pa.int8(), mask=g == MISSING)
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * n_samples)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows, dtype=np.int64)), pa.ListArray.from_arrays(offsets, values)], ["row_idx", "g"])


class _Reader(DataSourceReader):
    def __init__(self, where: Layout):
        self.where = where

    def partitions(self) -> list[InputPartition]:
        n, step = self.where.n_variants, max(1, TASK_CELLS // max(1, self.where.n_samples))
        step = min(step, max(1, -(-n // 8)))
        return [_Range(a, min(a + step, n)) for a in range(0, n, step)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, end = partition.value
        w = self.where
        block = max(1, 4_000_000 // max(1, w.n_samples))
        if w.kind == "pgen-variable":
            for a, g in pgen.read_rows(w.path, first, end, block):
                yield _batch(a, g.ravel(), len(g), w.n_samples)
            return
        with open(w.path, "rb") as f:
            f.seek(w.start + first * w.width)
            for a in range(first, end, block):
                rows = min(block, end - a)
                g = decode(f.read(rows * w.width), rows, w.n_samples, w.kind).ravel()
                yield _batch(a, g, rows, w.n_samples)


class GenotypeSource(DataSource):
    """Options: kind, path, variants, samples, start, width, as in :class:`Layout`."""

    @classmethod
    def name(cls) -> str:
        return "genoloom_genotypes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(Layout(o["kind"], o["path"], int(o["variants"]), int(o["samples"]), int(o["start"]), int(o["width"])))


def read_binary(spark: SparkSession, where: Layout) -> DataFrame:
    """row_idx, g of a binary file on a path that all machines see."""
    spark.dataSource.register(GenotypeSource)
    return spark.read.format("genoloom_genotypes").option("kind", where.kind).option("path", where.path).option("variants", where.n_variants).option("samples", where.n_samples).option("start", where.start).option("width", where.width).load()


def read_ascii(spark: SparkSession, path: str, n_variants: int, n_samples: int) -> DataFrame:
    """row_idx, g of a matrix of digits, a line for each variant; 9 is missing, other digits count REF."""
    lines = numbered_lines(spark, path, F.col("value") != "")
    check = lines.agg(F.count("*").alias("n"), F.max((F.length("value") != n_samples).cast("int")).alias("odd")).first()
    if check.n != n_variants or check.odd:
        raise IOFailed(f"{path}: expected {n_variants} lines of {n_samples} digits")
    bad = lines.where(~F.col("value").rlike("^[0129]*$")).head(1)
    if bad:
        raise IOFailed(f"{path}: a line holds something else than 0, 1, 2 and 9")
    digits = F.filter(F.split("value", ""), lambda c: c != "")
    return lines.select("row_idx", F.transform(digits, lambda c: F.when(c == "9", F.lit(None)).otherwise(F.lit(2) - c.cast("int")).cast("tinyint")).alias("g"))
