"""Removal of long repeated spans by de Bruijn compaction (operator 7).

Token k-mers, the windows of 13 words, are the edges of a de Bruijn graph; its
nodes are the 12 words that a window shares with the next.  As usual for large
graphs, edges are dealt to buckets by their least 5-mer (the anchor, which depends
on their words alone) and compacted within those first:

1. Every text gives (anchor, path, document) for each run of windows under one
   anchor.  An aggregation by anchor finds those that several documents share, and
   whether all follow the same path there.  All else cannot repeat and is left.
2. What is left gives units with their coordinates (row, place): the runs.  An
   aggregation finds the units of several documents, and a join their source, the
   smallest document.  Where an anchor branches, runs of unlike extent may share
   windows; so the runs of sources, each distinct one once, give their windows as
   units too, which are found and joined in the same way.
3. The nodes at both ends of every repeated unit are made at its source's
   coordinates, and their degrees counted.  Units that follow one another in the
   source over a node of one unit in and one out are linked, and nonbranching
   paths are compacted by joins that double the length of the links.
4. The units of each document join into spans along a path, with the
   coordinates of both the document and the source.
5. Spans longer than two windows are verified word by word with the words at the
   source's coordinates; shorter ones have two 64-bit hashes in common.  Their words
   are dropped.

Two documents that share a window share its anchor, so no repeat is lost.
Aggregations combine before the shuffle, and joins have a side with one row a
key, so a passage in a third of all documents is split over tasks.  Nothing is
compared in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize, release_shuffles
from .textkernel import EXACT, SPACED, Words, inside_one_text, list_array, mix64, ngram_hashes, signed, sliding_min, string_chunks

WINDOW = 13
KMER = 5


class _Paths:
    """The windows of a block: place of the first word, hash, anchor; and the paths they form."""

    def __init__(self, words: Words, window: int, kmer: int):
        at = inside_one_text(words, window)
        self.at = at
        if not len(at):
            self.hash = self.anchor = self.path_hash = np.zeros(0, np.uint64)
            self.first = np.zeros(0, np.int64)
            self.path = np.zeros(0, np.int64)
            return
        self.hash = ngram_hashes(words.hash, window)[at]
        self.anchor = sliding_min(ngram_hashes(words.hash, kmer), window - kmer + 1)[at]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (self.anchor[1:] != self.anchor[:-1]))
        self.first = np.flatnonzero(new)
        self.path = np.cumsum(new) - 1
        step = (np.arange(len(at)) - self.first[self.path]).astype(np.uint64)
        odd = step * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)
        self.path_hash = np.add.reduceat(self.hash * odd, self.first)


def _member(row: np.ndarray, key: np.ndarray, of: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Whether (row, key) is among (of, keys); rows are below n."""
    _, number = np.unique(np.concatenate([keys, key]), return_inverse=True)
    return np.isin(number[len(keys) :] * n + row, number[: len(keys)] * n + of)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements as unsigned) of a list<int64> column; null is empty."""
    size = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def paths(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """anchor, path, doc_id: the paths of every text, once each in a row (columns doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in string_chunks(batch.column(1)):
                words = Words(data, offsets, SPACED, EXACT)
                p = _Paths(words, window, kmer)
                if not len(p.first):
                    continue
                doc, anchor = words.doc[p.at[p.first]], p.anchor[p.first]
                order = np.lexsort((p.path_hash, anchor, doc))
                doc, anchor, path = doc[order], anchor[order], p.path_hash[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (path[1:] != path[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[new])), pa.array(signed(path[new])), pa.array(ids[a + doc[new]].astype(np.int64))], ["anchor", "path", "doc_id"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(cut, "anchor long, path long, doc_id long")


_MARKED = "row long, doc_id long, n_words long, kept_sha256 string, text string, place array<int>, size array<int>, unit array<long>, check array<long>, straight array<boolean>"


def _finish(text: bytes, gone: np.ndarray) -> str:
    """sha256 of the words that are left."""
    kept = text.split()
    if gone.any():
        kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _second(words: Words) -> np.ndarray:
    """Word hashes for a second, independent hash of windows."""
    return mix64(words.hash ^ np.uint64(0x2545F4914F6CDD1D))


def _runs(words: Words, p: _Paths, chosen: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(place, size in words, unit, check) of the chosen paths."""
    second = ngram_hashes(_second(words), window)[p.at]
    odd = (np.arange(len(p.at)) - p.first[p.path]).astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)
    length = np.diff(np.append(p.first, len(p.at)))
    unit, check = (mix64(x + length.astype(np.uint64)) for x in (p.path_hash, np.add.reduceat(second * odd, p.first)))
    return p.at[p.first[chosen]], length[chosen] + window - 1, unit[chosen], check[chosen]


def _settle(joined: DataFrame, window: int, kmer: int) -> DataFrame:
    """Every row, numbered: final if it shares no anchor, otherwise with its text and runs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(1)):
                n = b - a
                words = Words(data, offsets, SPACED, EXACT)
                plain, branching = _flat(batch.column(2).slice(a, n)), _flat(batch.column(3).slice(a, n))
                open_ = np.zeros(n, dtype=bool)
                of, lists = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
                if len(plain[0]) or len(branching[0]):
                    p = _Paths(words, window, kmer)
                    doc, anchor = words.doc[p.at[p.first]], p.anchor[p.first]
                    straight = _member(doc, anchor, *plain, n)
                    chosen = np.flatnonzero(straight | _member(doc, anchor, *branching, n))
                    place, size, unit, check = _runs(words, p, chosen, window)
                    of = words.doc[place]
                    open_[of] = True
                    lists = [place - words.first[of], size, signed(unit), signed(check), straight[chosen]]
                raw = data.tobytes()
                none = np.zeros(0, dtype=bool)
                whole = [raw[offsets[k] : offsets[k + 1]] for k in range(n)]
                shas = [None if o else _finish(t, none) for t, o in zip(whole, open_.tolist(), strict=True)]
                texts = [t.decode() if o else None for t, o in zip(whole, open_.tolist(), strict=True)]
                per, kinds = np.bincount(of, minlength=n), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0).slice(a, n), pa.array(words.counts()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), *[list_array(x, per, k) for x, k in zip(lists, kinds, strict=True)]],
                    ["row", "doc_id", "n_words", "kept_sha256", "text", "place", "size", "unit", "check", "straight"],
                )
                row += n

    return joined.select("doc_id", "text", "plain", "branching").mapInArrow(mark, _MARKED)


def _with_source(units: DataFrame) -> DataFrame:
    """units with source, the smallest doc_id that has the unit, and whether there is another one."""
    found = units.groupBy("unit", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    return units.join(found.select("unit", "check", "source", (F.col("source") < F.col("last")).alias("again")), ["unit", "check"]).drop("check")


def _at_places(pending: DataFrame, places: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` yields for the texts of pending rows (row, Words of it) and the places there; places: row, place, size, unit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = (batch.column(c).to_numpy() for c in (0, 1))
            for a, b, data, offsets in string_chunks(batch.column(2)):
                words = Words(data, offsets, SPACED, EXACT)
                own = [batch.column(c).slice(a, b - a) for c in (3, 4, 5)]
                of = np.repeat(np.arange(b - a), own[0].value_lengths().to_numpy(zero_copy_only=False))
                place, size, unit = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in own)
                yield from make(words, row[a:b], doc_id[a:b], of, place, size, unit)

    lists = places.groupBy("row").agg(F.collect_list(F.struct("place", "size", "unit")).alias("at"))
    texts = pending.select("row", "doc_id", "text").join(lists, "row").select("row", "doc_id", "text", "at.place", "at.size", "at.unit")
    return texts.mapInArrow(cut, schema)


def _repeated(pending: DataFrame, window: int) -> DataFrame:
    """The units that are also in a row of another doc_id: row, doc_id, place, size, unit, source."""

    def windows(words: Words, row: np.ndarray, doc_id: np.ndarray, of: np.ndarray, place: np.ndarray, size: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = size - window + 1
        of = np.repeat(of, many)
        at = np.repeat(place, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        where = words.first[of] + at
        first, second = (signed(ngram_hashes(h, window)[where]) for h in (words.hash, _second(words)))
        yield pa.RecordBatch.from_arrays([pa.array(row[of]), pa.array(doc_id[of]), pa.array(at.astype(np.int32)), pa.array(first), pa.array(second)], ["row", "doc_id", "place", "unit", "check"])

    runs = pending.select("row", "doc_id", F.explode(F.arrays_zip("place", "size", "unit", "check", "straight")).alias("u")).select("row", "doc_id", "u.*")
    whole = materialize(_with_source(runs), "repeat-runs")
    release_shuffles(pending.sparkSession)
    sources = whole.where("doc_id = source and not straight")
    single = materialize(_at_places(pending, sources, windows, "row long, doc_id long, place int, unit long, check long"), "repeat-windows")
    release_shuffles(pending.sparkSession)
    columns = ("row", "doc_id", "place", "size", "unit", "source")
    found = materialize(whole.where("again").select(*columns).unionByName(_with_source(single).where("again").withColumn("size", F.lit(window)).select(*columns)), "repeat-shared")
    drop(whole, single)
    release_shuffles(pending.sparkSession)
    return found


def _compacted(pending: DataFrame, units: DataFrame, window: int) -> DataFrame:
    """unit, offset, source_row, source_start of every repeated unit: where the path that it is on begins in the source, and how many windows come before it there."""

    def ends(words: Words, row: np.ndarray, doc_id: np.ndarray, of: np.ndarray, place: np.ndarray, size: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, edge = ngram_hashes(words.hash, window - 1), ngram_hashes(words.hash, window)
        at, n = words.first[of] + place, size - window + 1
        made = [unit, row[of], place, n, *map(signed, (node[at], node[at + n], edge[at], edge[at + n - 1]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["unit", "row", "place", "n", "head", "tail", "first", "last"])

    first = units.where("doc_id = source").groupBy("unit").agg(F.min(F.struct("row", "place", "size")).alias("at")).select("unit", "at.*")
    each = materialize(_at_places(pending, first, ends, "unit long, row long, place long, n long, head long, tail long, first long, last long"), "repeat-units")
    # nodes of one edge in and one out; units that begin or end with the same window are one there
    leaving = each.groupBy(F.col("head").alias("node")).agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a = b")
    coming = each.groupBy(F.col("tail").alias("node")).agg(F.min("last").alias("a"), F.max("last").alias("b")).where("a = b")
    single = leaving.select("node").join(coming.select("node"), "node")
    before = each.select(F.col("unit").alias("prev"), F.col("row").alias("prev_row"), (F.col("place") + F.col("n")).alias("prev_end"), F.col("n").alias("dist"), F.col("tail").alias("node")).join(single, "node")
    follows = (F.col("row") == F.col("prev_row")) & (F.col("place") == F.col("prev_end"))
    both = each.withColumnRenamed("head", "node").join(before, "node").where(follows)
    links = materialize(both.groupBy("unit").agg(F.max(F.struct("dist", "prev")).alias("x")).select("unit", "x.prev", "x.dist"), "repeat-links")
    while True:
        ahead = links.select(F.col("unit").alias("prev"), F.col("prev").alias("further"), F.col("dist").alias("more"))
        longer = links.join(ahead, "prev", "left")
        if not longer.where("further is not null").head(1):
            break
        before, links = links, materialize(longer.select("unit", F.coalesce("further", "prev").alias("prev"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")), "repeat-links")
        drop(before)
    joined = each.join(links, "unit", "left").select("unit", F.coalesce("dist", F.lit(0)).alias("offset"), F.col("row").alias("source_row"), "place")
    return joined.select("unit", "offset", "source_row", (F.col("place") - F.col("offset")).alias("source_start"))


def _spans(units: DataFrame, paths_: DataFrame, window: int) -> DataFrame:
    """row, first, n, source_row, source_first: runs of repeated units along a path, in words, in rows that are not the source's."""
    on_path = units.where("doc_id > source").select("row", "place", "size", "unit").join(paths_, "unit").withColumn("start", F.col("place") - F.col("offset"))
    path = ("row", "source_row", "source_start", "start")
    along = Window.partitionBy(*path).orderBy("place", "size")
    reached = F.max(F.col("place") + F.col("size") - (window - 1)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = on_path.withColumn("gap", F.coalesce(F.col("place") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*path, "run").agg(F.min("place").alias("first"), F.max(F.col("place") + F.col("size")).alias("end"))
    return whole.select("row", "first", (F.col("end") - F.col("first")).cast("long").alias("n"), "source_row", (F.col("source_start") + F.col("first") - F.col("start")).alias("source_first"))


def _words_at(pending: DataFrame, wanted: DataFrame) -> DataFrame:
    """source_row, source_first, n, words: the words of those rows at those places, joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, spans in zip(*(batch.column(c) for c in range(3)), strict=True):
                ws, at = text.as_py().encode().split(), spans.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * len(at), pa.int64()), pa.array([x["source_first"] for x in at], pa.int64()), pa.array([x["n"] for x in at], pa.int64()), pa.array([b" ".join(ws[x["source_first"] : x["source_first"] + x["n"]]) for x in at], pa.binary())],
                    ["source_row", "source_first", "n", "words"],
                )

    lists = wanted.groupBy("source_row").agg(F.collect_list(F.struct("source_first", "n")).alias("spans"))
    texts = pending.select(F.col("row").alias("source_row"), "text").join(lists, "source_row")
    return texts.mapInArrow(cut, "source_row long, source_first long, n long, words binary")


def _resolve(joined: DataFrame) -> DataFrame:
    """Rows doc_id, text, spans (first, n, words to verify or null): final."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, shas = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                ws = raw.split()
                gone = np.zeros(len(ws), dtype=bool)
                for x in spans.as_py() or []:
                    if x["words"] is None or x["words"] == b" ".join(ws[x["first"] : x["first"] + x["n"]]):
                        gone[x["first"] : x["first"] + x["n"]] = True
                counts.append(len(ws))
                removed.append(int(gone.sum()))
                shas.append(_finish(raw, gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", "spans").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeated_spans(pending: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, first, n, source_row, source_first of the spans of rows with units (see :func:`_settle`) that an earlier document has."""
    units = _repeated(pending, window)
    spans = materialize(_spans(units, _compacted(pending, units, window), window), "repeat-spans")
    drop(units)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A word goes if a window over it also starts in a row with a smaller doc_id;
    windows are those of the input.  A null or empty text has no words.  Rows
    with a null doc_id lose nothing and cause no removal; rows with equal
    doc_id do not count as repeats of each other.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = paths(docs, window, kmer)
    shared = (
        found.groupBy("anchor")
        .agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("path").alias("p0"), F.max("path").alias("p1"))
        .where("source < last")
        .select("anchor", (F.col("p0") == F.col("p1")).alias("straight"))
    )
    back = found.select("anchor", "doc_id").join(shared, "anchor")
    lists = materialize(
        back.groupBy("doc_id").agg(F.collect_set(F.when(F.col("straight"), F.col("anchor"))).alias("plain"), F.collect_set(F.when(~F.col("straight"), F.col("anchor"))).alias("branching")),
        "repeat-anchors",
    )
    del found, shared, back
    release_shuffles(spark)
    marked = materialize(_settle(docs.join(lists, "doc_id", "left"), window, kmer), "repeat-marks")
    drop(lists)
    release_shuffles(spark)
    final = marked.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    pending = marked.where("kept_sha256 is null")
    spans = repeated_spans(pending, window)
    release_shuffles(spark)
    at_source = ["source_row", "source_first", "n"]
    words = _words_at(pending, spans.where(F.col("n") > 2 * window).select(*at_source).distinct())
    lists = spans.join(words, at_source, "left").groupBy("row").agg(F.collect_list(F.struct("first", "n", "words")).alias("spans"))
    rest = _resolve(pending.select("row", "doc_id", "text").join(lists, "row", "left"))
    return final.unionByName(rest)
