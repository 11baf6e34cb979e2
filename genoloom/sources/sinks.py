"""Files of bound panels and reports.

Text rows are formatted where they are and stream through the driver into one
file; a dataset at scale is better written as Parquet (:func:`write_parquet`).
Files are made under a temporary name and renamed when all are there.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import IOFailed
from ..operators.identity import sample_columns
from .genotypes import MISSING, encode_pgen, pgen_header

# Fixed value: header of the report.
REPORT_HEADER = "variant_id\tchr\tpos\tinput_index\taction\treason"
#: Bytes of a report row, about, and the size from which to warn.
ROW_BYTES, LARGE_REPORT = 100, 100_000_000

# Kinds of filesystems that are on other machines.
NETWORK_FILESYSTEMS = ("nfs", "nfs4", "cifs", "smb", "smb3", "smbfs", "afs", "lustre", "gpfs", "beegfs", "ceph", "glusterfs", "fuse.sshfs")


def _remove(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path)
    elif os.path.exists(path):
        os.unlink(path)


class Staged:
    """Files and folders under temporary names, moved into place together or removed."""

    def __init__(self) -> None:
        self._made: list[tuple[str, str]] = []

    def path(self, final: str) -> str:
        os.makedirs(os.path.dirname(os.path.abspath(final)), exist_ok=True)
        tmp = f"{final}.part{os.getpid()}"
        self._made.append((tmp, final))
        return tmp

    def commit(self) -> None:
        for tmp, final in self._made:
            if os.path.isdir(final):
                _remove(final)
            os.replace(tmp, final)
        self._made.clear()

    def discard(self) -> None:
        for tmp, _ in self._made:
            _remove(tmp)
        self._made.clear()


def network_filesystem(path: str, mounts: str = "/proc/self/mountinfo") -> str | None:
    """The kind of the network filesystem that path lies on, as far as the system tells."""
    folder = os.path.dirname(os.path.realpath(path))
    best, kind = "", None
    try:
        with open(mounts) as f:
            for line in f:
                before, _, after = line.partition(" - ")
                point = before.split()[4] if len(before.split()) > 4 else None
                if point and after and (folder + "/").startswith(point.rstrip("/") + "/") and len(point) > len(best):
                    best, kind = point, after.split()[0]
    except OSError:
        return None
    return kind if kind in NETWORK_FILESYSTEMS else None


@contextmanager
def output_lock(prefix: str) -> Iterator[None]:
    """Holds ``<prefix>.lock``; the file stays when it is released."""
    os.makedirs(os.path.dirname(os.path.abspath(prefix)), exist_ok=True)
    kind = network_filesystem(prefix)
    if kind:
        warnings.warn(f"{prefix} is on a network filesystem ({kind}), where the lock may not keep other machines out", stacklevel=3)
    with open(f"{prefix}.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise IOFailed(f"another run is writing to {prefix}") from e
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def write_lines(lines: DataFrame, header: str | None, path: str) -> None:
    """The one string column of lines, in its order."""
    try:
        with open(path, "w", encoding="utf-8", newline="") as f:
            if header is not None:
                f.write(header + "\n")
            for row in lines.toLocalIterator(prefetchPartitions=True):
                f.write(row[0] + "\n")
    except OSError as e:
        raise IOFailed(f"cannot write {path}: {e}") from e


def _tabbed(df: DataFrame, columns: list[str], null: str = "NA") -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns]).alias("line"))


def rendered(ordered: DataFrame, columns: list[str], number: str | None = None) -> DataFrame:
    """The columns between tabs; doubles by a C format or, without one, by their shortest digits; unknown ones are nan."""
    show = repr if number is None else (lambda x: number % x)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [["nan" if x is None else show(x) for x in c.to_pylist()] if pa.types.is_floating(c.type) else ["" if x is None else str(x) for x in c.to_pylist()] for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(["\t".join(row) for row in zip(*cells, strict=True)], pa.string())], ["line"])

    return ordered.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(render, "line string")


def write_variants(kept: DataFrame, path: str) -> None:
    """#CHROM POS ID REF ALT CM in canonical order."""
    lines = rendered(kept.orderBy("canonical_row"), ["chrom", "pos", "variant_id", "ref", "alt", "cm"])
    write_lines(lines, "#CHROM\tPOS\tID\tREF\tALT\tCM", path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Fixed columns, then others by name; what is unknown is NA."""
    columns = sample_columns(samples.columns)
    write_lines(_tabbed(samples.orderBy("out_ord"), columns), "#" + "\t".join(columns), path)


def write_pgen(bound: DataFrame, n_variants: int, n_samples: int, path: str) -> None:
    """Fixed-width two-bit records in canonical order; the counts must be right."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten()
            g = flat.fill_null(MISSING).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([encode_pgen(np.ascontiguousarray(g))], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["piece", "n"])

    rows = 0
    try:
        with open(path, "wb") as f:
            f.write(pgen_header(n_variants, n_samples))
            for row in bound.orderBy("canonical_row").select("g").mapInArrow(pack, "piece binary, n long").toLocalIterator(prefetchPartitions=True):
                f.write(row.piece)
                rows += row.n
    except OSError as e:
        raise IOFailed(f"cannot write {path}: {e}") from e
    if rows != n_variants:
        raise IOFailed(f"{path}: wrote {rows} of {n_variants} variants")


def write_parquet(bound: DataFrame, path: str) -> None:
    """Bound variants by chromosome, each chromosome's rows in position order."""
    bound.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A row for each variant and other panel, dropped ones too."""
    ordered = rows.orderBy("input_index", "canonical_row")
    write_lines(_tabbed(ordered, ["variant_id", "chr", "pos", "input_index", "action", "reason"], null=""), REPORT_HEADER, path)


def write_json(document: dict[str, Any], path: str) -> None:
    try:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(document, f, indent=2)
            f.write("\n")
    except OSError as e:
        raise IOFailed(f"cannot write {path}: {e}") from e


def human_bytes(n: int) -> str:
    """Whole units of 1,024, shown with one decimal but for bytes."""
    power = min(4, max(0, (n.bit_length() - 1) // 10))
    amount = n >> 10 * power
    return f"{amount:,} B" if not power else f"{amount} TB" if power == 4 else f"{amount:.1f} {' KMG'[power]}B"
