"""Benchmark decontamination with suffix arrays of the training texts (operator 1).

Training texts are cut into shards of whole texts.  A shard's words become
numbers (0 for words which no benchmark item has), and a suffix array is built
over the suffixes that begin with enough benchmark words in a row to hold a
window at all; no other suffix can match.  Every benchmark suffix, cut to the
length of a window and each distinct one once, is searched in the array by
bisection, all at once.  Occurrences on one diagonal of a text
and an item join into the longest verbatim match, with its place in both.

The benchmark goes to the workers in blocks of bounded size; texts pass through
CHAINED blocks one after another, inside one task, so no shuffle is needed however
large the benchmark is.  Beyond that the state is written to the shared folder,
and the driver lets go of those blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textkernel import ALNUM, LOWER, Words, list_array, string_chunks

WINDOW = 10
#: Most bytes of benchmark text in one block; its arrays, in one closure sent to the workers, take some 20 times as much.
BLOCK_BYTES = 2 << 20
#: Blocks that one pass over the texts goes through, and so the most that the driver holds.
CHAINED = 8


@dataclass(frozen=True)
class Block:
    """Benchmark items: word hashes one after another, and each distinct window with its items.

    known: whether an item has an id; those without count for hits alone.
    vocabulary: sorted distinct word hashes; seq: their numbers from 1, 0 between items.
    windows: by length, (matrix of distinct windows as rows, first place in seq of each).
    """

    item_ids: np.ndarray
    known: np.ndarray
    vocabulary: np.ndarray
    seq: np.ndarray
    windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    longest: int
    shortest: int


def build_block(ids: list[int | None], texts: list[str | None], window: int = WINDOW) -> Block | None:
    """None if no item has a word."""
    column = pa.array(texts, pa.string())
    parts, counts = [], []
    for _, _, data, offsets in string_chunks(column, 1 << 40):
        words = Words(data, offsets, ALNUM, LOWER)
        parts.append(words.hash)
        counts.append(words.counts())
    if not parts or not sum(len(p) for p in parts):
        return None
    h, count = np.concatenate(parts), np.concatenate(counts)
    vocabulary, number = np.unique(h, return_inverse=True)
    seq = np.insert(number + 1, np.cumsum(count), 0).astype(np.int64)
    start = np.cumsum(count + 1) - count - 1
    windows = []
    sizes = np.minimum(count, window)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at, item = [], []
        for k in np.flatnonzero(sizes == size).tolist():
            n = count[k] - size + 1
            at.append(start[k] + np.arange(n))
            item.append(np.full(n, k))
        at, item = np.concatenate(at), np.concatenate(item)
        rows, inverse = np.unique(seq[at[:, None] + np.arange(size)], axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        first = np.searchsorted(inverse.ravel()[order], np.arange(len(rows) + 1))
        windows.append((size, rows, first, at[order], item[order], start))
    return Block(np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is not None for i in ids]), vocabulary, seq, windows, int(count.max()), int(sizes[sizes > 0].min()))


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """The places ``at`` in order of the words of seq from there on.

    Suffixes that agree in their first ``depth`` words may come in any order; no
    search asks for more.  seq is padded by at least depth + 3 zeros.
    """
    step = max(1, 62 // bits)
    order = np.arange(len(at))
    group = np.zeros(len(at), dtype=np.int64)
    open_ = order
    done = 0
    out = at.copy()
    while len(open_) and done < depth:
        key = np.zeros(len(open_), dtype=np.int64)
        for k in range(step):
            key = (key << bits) | seq[out[open_] + done + k]
        rank = np.lexsort((key, group[open_]))
        key, slot = key[rank], group[open_][rank]
        out[open_] = out[open_][rank]
        new = np.append(True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        group[open_] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        done += step
    return out


def _bound(seq: np.ndarray, array: np.ndarray, rows: np.ndarray, after: bool) -> np.ndarray:
    """By bisection, for each row of words the first place in the array whose suffix is not less (after: is greater)."""
    low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), len(array), dtype=np.int64)
    reach = np.arange(rows.shape[1])
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) >> 1
        have, want = seq[array[mid][:, None] + reach], rows[live]
        differ = have != want
        at = differ.argmax(axis=1)
        pick = np.arange(len(live))
        less = have[pick, at] < want[pick, at]
        if after:
            less |= ~differ.any(axis=1)
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
    return low


def search_shard(data: np.ndarray, offsets: np.ndarray, block: Block):
    """(words, hit of each word, (text, item) pairs, matches) of a shard.

    matches: columns text, item, first word in the text, first word in the item,
    words; each is a longest verbatim match.
    """
    words = Words(data, offsets, ALNUM, LOWER)
    n = len(words.hash)
    hit = np.zeros(n, dtype=bool)
    none = np.zeros((0, 5), dtype=np.int64)
    slot = np.minimum(np.searchsorted(block.vocabulary, words.hash), len(block.vocabulary) - 1)
    number = np.where(block.vocabulary[slot] == words.hash, slot + 1, 0)
    bad = np.flatnonzero(number == 0)
    ends = words.first[1:][words.doc]
    stop = np.minimum(np.append(bad, n)[np.searchsorted(bad, np.arange(n))], ends)
    good = np.flatnonzero(stop - np.arange(n) >= block.shortest)
    if not len(good):
        return words, hit, none[:, :2], none
    seq = np.zeros(n + len(offsets) + block.longest + 70, dtype=np.int64)
    shift = np.arange(n) + words.doc
    seq[shift] = number
    array = suffix_array(seq, shift[good], block.longest, int(len(block.vocabulary)).bit_length())
    matches, pairs = [], []
    for size, rows, first, at, item, start in block.windows:
        low, high = _bound(seq, array, rows, False), _bound(seq, array, rows, True)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        many = (high - low)[found]
        place = array[np.arange(many.sum()) + np.repeat(low[found] - (np.cumsum(many) - many), many)]
        text = np.searchsorted(words.first + np.arange(len(words.first)), place, side="right") - 1
        word = place - text
        cover = np.zeros(n + 1, dtype=np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + size, -1)
        hit |= np.cumsum(cover[:-1]) > 0
        window = np.repeat(found, many)
        # each occurrence meets every item place of its window
        per = (first[window + 1] - first[window]).astype(np.int64)
        which = np.arange(per.sum()) + np.repeat(first[window] - (np.cumsum(per) - per), per)
        t, w, k = np.repeat(text, per), np.repeat(word, per), item[which]
        p = at[which] - start[k]
        pairs.append(np.column_stack([t, k]))
        order = np.lexsort((w, w - p, k, t))
        t, w, k, p = t[order], w[order], k[order], p[order]
        new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (w[1:] - p[1:] != w[:-1] - p[:-1]) | (w[1:] != w[:-1] + 1))
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(w))) + size - 1
        matches.append(np.column_stack([t[head], k[head], w[head] - words.first[t[head]], p[head], length]))
    if not pairs:
        return words, hit, none[:, :2], none
    return words, hit, np.unique(np.concatenate(pairs), axis=0), np.concatenate(matches)


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about block_bytes, one at a time; items without words are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = 1 + int(size) // block_bytes
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect() if n > 1 else items.orderBy("id", "text").collect()
        block = build_block([r.id for r in rows], [r.text for r in rows])
        if block is not None:
            yield block


MATCHES = "matches array<struct<item_id:long,text_start:int,item_start:int,n_words:int>>"
_STATE = f"doc_id long, text string, n_words long, starts array<int>, ends array<int>, items array<long>, {MATCHES}"


def _runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number a text) of the runs of hit words, as word places in their text."""
    if not len(hit):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(first) - 1, np.int64)
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[first] = True
    a = np.flatnonzero(hit & (np.append(True, ~hit[:-1]) | edge[:-1]))
    b = np.flatnonzero(hit & (np.append(~hit[1:], True) | edge[1:])) + 1
    text = np.searchsorted(first, a, side="right") - 1
    return (a - first[text]).astype(np.int32), (b - first[text]).astype(np.int32), np.bincount(text, minlength=len(first) - 1)


def _pass(rows: DataFrame, block: Block | None) -> DataFrame:
    """Adds a block's matches to the state of each row."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(1)):
                if block is None:
                    words = Words(data, offsets, ALNUM, None)
                    hit, pairs, found = np.zeros(len(words.starts), dtype=bool), np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64)
                else:
                    words, hit, pairs, found = search_shard(data, offsets, block)
                n = b - a
                for row, (s, e) in enumerate(zip(batch.column(3).slice(a, n).to_pylist(), batch.column(4).slice(a, n).to_pylist(), strict=True)):
                    for x, y in zip(s, e, strict=True):
                        hit[words.first[row] + x : words.first[row] + y] = True
                starts, ends, runs = _runs(hit, words.first)
                found = found[np.lexsort((found[:, 2], found[:, 3], found[:, 1], found[:, 0]))]
                ids, known = (block.item_ids, block.known) if block is not None else (np.zeros(1, np.int64), np.zeros(1, bool))
                pairs = pairs[known[pairs[:, 1]]]
                pairs = np.unique(np.column_stack([pairs[:, 0], ids[pairs[:, 1]]]), axis=0)
                new_items = list_array(pairs[:, 1], np.bincount(pairs[:, 0], minlength=n), pa.int64())
                place = np.append(0, np.cumsum(np.bincount(found[:, 0], minlength=n))).astype(np.int32)
                structs = pa.StructArray.from_arrays(
                    [pa.array(ids[found[:, 1]], mask=~known[found[:, 1]]), pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 3].astype(np.int32)), pa.array(found[:, 4].astype(np.int32))],
                    ["item_id", "text_start", "item_start", "n_words"],
                )
                new_matches = pa.ListArray.from_arrays(pa.array(place), structs)
                old_items, old_matches = batch.column(5).slice(a, n), batch.column(6).slice(a, n)
                if len(old_items.flatten()):
                    new_items = pa.array([sorted({*x, *y}) for x, y in zip(old_items.to_pylist(), new_items.to_pylist(), strict=True)], pa.list_(pa.int64()))
                    new_matches = pa.array([x + y for x, y in zip(old_matches.to_pylist(), new_matches.to_pylist(), strict=True)], new_matches.type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(words.counts()), list_array(starts, runs, pa.int32()), list_array(ends, runs, pa.int32()), new_items, new_matches],
                    ["doc_id", "text", "n_words", "starts", "ends", "items", "matches"],
                )

    return rows.mapInArrow(search, _STATE)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, starts, ends, matches of every row of docs.

    items: ids (ascending, each once) of items with a window in the text; starts
    and ends: runs of hit words; matches: longest verbatim matches of at least a
    window.  A null or empty text has no words.  Rows with equal ids are judged
    each for itself; an item without an id counts for hits and matches but is in no
    list of items; an empty benchmark or table gives no hits or no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("starts"),
        F.array().cast("array<int>").alias("ends"),
        F.array().cast("array<long>").alias("items"),
        F.array().cast(MATCHES.split(" ", 1)[1]).alias("matches"),
    )
    block = None
    for k, block in enumerate(benchmark_blocks(benchmark, block_bytes=block_bytes), 1):
        rows = _pass(rows, block)
        if k % CHAINED == 0:
            rows = materialize(rows, "benchmark-hits")
    if block is None:
        rows = _pass(rows, None)
    lengths = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", "n_words", lengths.alias("n_hit"), "items", "starts", "ends", "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any benchmark window, with all their columns; no shuffle.

    Null and empty texts stay, as do all rows if the benchmark is empty; repeated
    rows are judged each for itself; items without an id count like others; an empty
    table gives no rows.
    """
    at = docs.columns.index(text_col)
    out = docs
    for k, block in enumerate(benchmark_blocks(benchmark, block_bytes=block_bytes), 1):

        def keep(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for a, _, data, offsets in string_chunks(batch.column(at)):
                    pairs = search_shard(data, offsets, block)[2]
                    clean[a + pairs[:, 0]] = False
                if batch.num_rows:
                    yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
        if k % CHAINED == 0:
            out = materialize(out, "benchmark-free")
    return out
