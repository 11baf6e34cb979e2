"""Work on every cell of a dosage matrix, in Arrow batches and numpy.

A batch of rows is one matrix of bytes, variants by samples; rows of another
length are a matrix of their own.  Nothing here makes a row for a cell, and what
is known about the samples goes along as arrays, so that neither the plan nor the
shuffle grows with variants times samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -1
#: Cells that are worked on at once.
CELLS = 1 << 24
#: The same where cells are made in the worker; few enough for its caches.
MADE = 1 << 21


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the column, their cells as int8, missing as -1), a pair for each length of rows; null rows are left out."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    cells = column.flatten().cast(pa.int8()).fill_null(MISSING).to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for width in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == width)
        if len(rows) == len(size):
            yield rows, cells.reshape(len(rows), width)
        else:
            yield rows, cells[first[rows][:, None] + np.arange(width)]


def as_lists(cells: np.ndarray) -> pa.Array:
    """A list<int8> column of the rows of a matrix, whose memory it keeps; -1 is null."""
    flat = np.ascontiguousarray(cells, dtype=np.int8).ravel()
    offsets = np.arange(0, flat.size + 1, cells.shape[1]) if cells.shape[1] else np.zeros(len(cells) + 1, np.int64)
    there = np.packbits(flat != MISSING, bitorder="little")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.Array.from_buffers(pa.int8(), flat.size, [pa.py_buffer(there), pa.py_buffer(flat)]))


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about CELLS cells in column ``at``."""
    per = max(1, len(batch.column(at).flatten()) // max(1, batch.num_rows))
    step = max(1, CELLS // per)
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


Reader = Callable[[list[pa.Array]], np.ndarray]


@dataclass(frozen=True)
class Packed:
    """Dosages whose rows stay small in joins and shuffles, and become cells in the worker alone.

    rows: row_idx and the columns ``payload``.  reader(places) is called once a task and
    gives what makes the cells (int8, -1: missing) of these places from a batch of the
    payload; a place of -1 and a row of nulls are missing.
    """

    rows: DataFrame
    payload: list[str]
    width: int
    reader: Callable[[np.ndarray], Reader]


def packed(dosages: DataFrame, width: int) -> Packed:
    """Dosages with an array g as they are."""

    def reader(places: np.ndarray) -> Reader:
        def read(columns: list[pa.Array]) -> np.ndarray:
            out = np.full((len(columns[0]), len(places)), MISSING, np.int8)
            for chosen, cells in matrices(columns[0]):
                there = np.flatnonzero((places >= 0) & (places < cells.shape[1]))
                out[chosen[:, None], there] = cells[:, places[there]]
            return out

        return read

    return Packed(dosages, ["g"], width, reader)


def spread(rows: DataFrame, width: int) -> DataFrame:
    """Small rows of many cells dealt over all cores, which their size alone would not do."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if width >= 32 * cores else rows


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, MADE // max(1, width))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def _added_up(places: np.ndarray) -> np.ndarray:
    """Sums of a boolean matrix by column."""
    out = np.zeros(places.shape[1], np.int64)
    for k in range(0, len(places), 255):
        out += np.add.reduce(places[k : k + 255].view(np.uint8), axis=0, dtype=np.uint8)
    return out


def packed_sums(rows: DataFrame, dosages: Packed) -> DataFrame:
    """place, het, called, n of every place over the rows, which have the payload."""
    names, width, reader = dosages.payload, dosages.width, dosages.reader

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, read = np.zeros((3, width), np.int64), reader(np.arange(width))
        for piece in _pieces(batches, width):
            cells = read(piece.columns)
            total[0] += _added_up(cells == 1)
            total[1] += _added_up(cells >= 0)
            total[2] += len(cells)
        if total[2].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, total)], ["place", "het", "called", "n"])

    parts = spread(rows.select(*names), width).mapInArrow(add, "place int, het long, called long, n long")
    return parts.groupBy("place").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("het", "called", "n")])


def unpacked(rows: DataFrame, parts: list[tuple[Packed, list[str], list[int], list[int], str | None]], width: int) -> DataFrame:
    """rows with an array g of width places in place of what the parts are packed in.

    A part: dosages, the columns of rows with their payload, the places taken from it,
    the places that they get, and a column of rows that tells where g is to be 2 - g.
    """
    gone = {c for _, columns, *_ in parts for c in columns} | {swap for *_, swap in parts if swap}
    rest = [c for c in rows.columns if c not in gone]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in rest) + ", g array<tinyint>"
    plans = [(p.reader, columns, np.array(own, dtype=np.int64), np.array(to, dtype=np.int64), swap) for p, columns, own, to, swap in parts]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [(reader(own), columns, _run(to), swap) for reader, columns, own, to, swap in plans]
        for piece in _pieces(batches, width):
            out = np.full((piece.num_rows, width), MISSING, np.int8)
            for read, columns, to, swap in readers:
                cells = read([piece.column(c) for c in columns])
                if swap:
                    at = np.flatnonzero(piece.column(swap).fill_null(False).to_numpy(zero_copy_only=False))
                    turned = cells[at]
                    cells[at] = np.where(turned == MISSING, np.int8(MISSING), np.int8(2) - turned)
                out[:, to] = cells
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in rest] + [as_lists(out)], [*rest, "g"])

    return spread(rows, width).mapInArrow(make, schema)


def _run(places: np.ndarray):
    """The places as a slice, if they are one."""
    return slice(int(places[0]), int(places[0]) + len(places)) if len(places) and (np.diff(places) == 1).all() else places


def packed_group_sums(rows: DataFrame, dosages: Packed, groups: list[list[int]], ploidy: list[int]) -> DataFrame:
    """:func:`group_sums` for rows that have the payload.

    Each group's diploid and pseudohaploid places stand side by side, filled up with
    missing ones to whole words of 8 bytes, so that 8 cells are added at once.
    """
    names, reader = dosages.payload, dosages.reader
    order: list[int] = []
    runs: list[tuple[int, int, int, int]] = []
    for g, own in enumerate(groups):
        for weight in sorted({ploidy[p] for p in own}):
            mine = [p for p in own if ploidy[p] == weight]
            mine += [-1] * (-len(mine) % 8)
            runs.append((g, weight, len(order) // 8, len(mine) // 8))
            order += mine
    places = np.array(order, dtype=np.int64)
    rest = [f for f in rows.schema.fields if f.name not in names or f.name == "row_idx"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", alt_count array<double>, called array<long>"

    def word_sums(words: np.ndarray, most: int) -> np.ndarray:
        step, total = 255 // most, np.zeros(len(words), np.int64)
        for k in range(0, words.shape[1], step):
            lanes = np.add.reduce(words[:, k : k + step], axis=1)
            total += lanes.view(np.uint8).reshape(len(words), 8).sum(axis=1, dtype=np.int64)
        return total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(places)
        for piece in _pieces(batches, len(places)):
            alt, called = np.zeros((2, piece.num_rows, len(groups)), np.int64)
            if len(places):
                cells = np.ascontiguousarray(read([piece.column(c) for c in names]))
                there = (cells >= 0).view(np.uint64)
                values = np.maximum(cells, 0)
                most = max(1, int(values.max(initial=0)))
                values = values.view(np.uint64)
                for g, weight, first, n in runs:
                    alt[:, g] += weight * word_sums(values[:, first : first + n], most)
                    called[:, g] += weight * word_sums(there[:, first : first + n], 1)
            offsets = pa.array(np.arange(0, alt.size + 1, len(groups)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (alt * 0.5, called)]
            yield pa.RecordBatch.from_arrays([piece.column(f.name) for f in rest] + lists, [f.name for f in rest] + ["alt_count", "called"])

    return spread(rows, len(places)).mapInArrow(add, schema)


def place_sums(dosages: DataFrame) -> DataFrame:
    """out_ord, het, called, n of every place of the arrays g, added up in each task before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 0), np.int64)
        for batch in batches:
            for piece in _slices(batch, 0):
                for _, cells in matrices(piece.column(0)):
                    if cells.shape[1] > total.shape[1]:
                        total = np.pad(total, ((0, 0), (0, cells.shape[1] - total.shape[1])))
                    own = total[:, : cells.shape[1]]
                    own[0] += np.count_nonzero(cells == 1, axis=0)
                    own[1] += np.count_nonzero(cells >= 0, axis=0)
                    own[2] += len(cells)
        if total.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], ["out_ord", "het", "called", "n"])

    parts = dosages.select("g").mapInArrow(add, "out_ord int, het long, called long, n long")
    return parts.groupBy("out_ord").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("het", "called", "n")])


def picked(rows: DataFrame, column: str, places: list[int]) -> DataFrame:
    """rows with only those places of the arrays in ``column``, in that order; a place that is not there is missing."""
    at, want = rows.columns.index(column), np.array(places, dtype=np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, at):
                out = np.full((piece.num_rows, len(want)), MISSING, np.int8)
                for chosen, cells in matrices(piece.column(at)):
                    there = np.flatnonzero(want < cells.shape[1])
                    out[chosen[:, None], there] = cells[:, want[there]]
                made = as_lists(out)
                if piece.column(at).null_count:
                    made = pa.array(made.to_pylist(), made.type, mask=np.asarray(piece.column(at).is_null()))
                yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(piece.columns)], rows.columns)

    return rows.mapInArrow(pick, rows.schema)


def group_sums(rows: DataFrame, column: str, groups: list[list[int]], ploidy: list[int]) -> DataFrame:
    """rows with alt_count and called, arrays of a number for each group of places, in place of ``column``.

    ploidy: 2 for a place whose dosage counts in 2 called alleles, 1 for one of
    which half counts in 1.  A null row has nothing called.
    """
    at = rows.columns.index(column)
    order = np.array([p for g in groups for p in g], dtype=np.int64)
    sizes = np.array([len(g) for g in groups], dtype=np.int64)
    first, some = (np.cumsum(sizes) - sizes)[sizes > 0], np.flatnonzero(sizes)
    weight = np.array(ploidy, dtype=np.int64)
    doubled = weight[order] if len(order) else weight[:0]
    rest = [f for i, f in enumerate(rows.schema.fields) if i != at]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", alt_count array<double>, called array<long>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, at):
                alt, called = np.zeros((2, piece.num_rows, len(groups)), np.int64)
                for chosen, cells in matrices(piece.column(at)):
                    if len(some):
                        own = cells[:, order]
                        there = own >= 0
                        for out, values in ((alt, own * there), (called, there)):
                            out[chosen[:, None], some] = np.add.reduceat(values * doubled, first, axis=1)
                offsets = pa.array(np.arange(0, alt.size + 1, len(groups)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (alt * 0.5, called)]
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(piece.columns) if i != at] + lists, [f.name for f in rest] + ["alt_count", "called"])

    return rows.mapInArrow(add, schema)
