"""Nearest neighbours by additive quantisation (operator 2).

A vector is approximated by a sum of full-dimensional codewords, one of each
codebook.  Codebooks come from residual k-means on a bounded sample; every
vector is then encoded by beam search, and its codes and the norm of its
approximation are stored.  A query makes one table of inner products with all
codewords; the score of a vector is a sum of looked-up numbers.  Vectors lie by
descending norm: a score is the query's norm times the stored one at most, so a
search ends where no vector can be among the best any more.  The best are ranked
again on the original vectors.

Queries meet all codes in packed shards of codes and packed blocks of queries; the
join's key is the pair of both numbers, so there are as many keys as pairs, and
a task holds one of each however many there are.  The best of a query are merged
FAN_IN shards at a time.  Equal vectors are searched once and stand for their
smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .textkernel import list_array

#: Most vectors that codebooks are fitted on.
SAMPLE = 16_384
SHARD_ROWS, QUERY_ROWS = 8_192, 1_024
#: Codes that a query scores before it looks whether the rest can be left out.
STEP = 2_048
#: Shards whose best are merged in one row.
FAN_IN = 16
#: Tasks that a search is dealt to at most.
MOST_TASKS = 8_192


@dataclass(frozen=True)
class Codebooks:
    """words: (books, codewords, dimension), float32."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the approximations) by beam search over the books."""
        codes, norms = [], []
        for at in range(0, len(x), 1024):
            c, rest = self._encode(x[at : at + 1024], beam)
            codes.append(c)
            norms.append(np.square(x[at : at + 1024] - rest).sum(axis=1))
        if not codes:
            return np.zeros((0, len(self.words)), np.uint8), np.zeros(0, np.float32)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        rest = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for book in self.words:
            width, k = rest.shape[1], len(book)
            # squared length of what would be left, for each beam and codeword
            left = np.square(rest).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, k) + np.square(book).sum(axis=1)
            left = left.reshape(n, -1)
            keep = min(beam, left.shape[1])
            best = np.argpartition(left, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(left, best, axis=1), axis=1, kind="stable"), axis=1)
            of, word = best // k, best % k
            codes = np.concatenate([codes[rows, of], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[rows, of] - book[word]
        return codes[:, 0], rest[:, 0]


def train(sample: np.ndarray, books: int = 32, words: int = 256, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Residual k-means, a book at a time."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    words = max(1, min(words, len(rest), 256))
    out = []
    for _ in range(books):
        centre = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = (np.square(centre).sum(axis=1) - 2 * rest @ centre.T).argmin(axis=1)
            count = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            some = np.flatnonzero(count)
            first = np.searchsorted(near[order], some)
            centre[some] = np.add.reduceat(rest[order], first, axis=0) / count[some, None]
        near = (np.square(centre).sum(axis=1) - 2 * rest @ centre.T).argmin(axis=1)
        rest -= centre[near]
        out.append(centre)
    return Codebooks(np.array(out, dtype=np.float32))


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pack(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """One row for each value of group, with the columns' contents as bytes, in descending order of norm if there is one, then of id."""
    order = [*([("norm", "descending")] if "norm" in columns else []), ("id", "ascending")]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        parts = []
        for c in columns:
            column = table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
            if pa.types.is_list(column.type):
                column = column.flatten()
            if pa.types.is_floating(column.type):
                column = column.cast(pa.float32())
            raw = b"".join(column.to_pylist()) if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False).tobytes()
            parts.append(pa.array([raw], pa.binary()))
        return pa.table([table[group].slice(0, 1).combine_chunks(), *parts], names=[group, *columns])

    return rows.select(group, *columns).groupBy(group).applyInArrow(pack, f"{group} int, " + ", ".join(f"{c} binary" for c in columns))


def _best_codes(table: np.ndarray, reach: float, place: np.ndarray, ids: np.ndarray, norms: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, negated scores) of the ``keep`` best of a shard, ties to the smaller id; reach is the query's norm."""
    best_id, best_score = np.zeros(0, np.int64), np.zeros(0, np.float32)
    for a in range(0, len(ids), STEP):
        if len(best_id) == keep and reach * float(norms[a]) * 1.0001 < -float(best_score[-1]):
            break
        own = place[:, a : a + STEP]
        score = table[own[0]]
        for at in own[1:]:
            score += table[at]
        score, those = np.append(best_score, -score), np.append(best_id, ids[a : a + STEP])
        few = np.flatnonzero(score <= np.partition(score, keep - 1)[keep - 1]) if len(score) > keep else np.arange(len(score))
        few = few[np.lexsort((those[few], score[few]))][:keep]
        best_id, best_score = those[few], score[few]
    return best_id, best_score


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, books: int = 32, rerank: int = 640, beam: int = 4, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    vectors: vec_id, embedding; is_query is a condition on vec_id.  A query's own
    row is no candidate; ties go to the smaller vec_id; score is the inner product
    of the original vectors in double precision.  Rows with a null vec_id and
    vectors that :func:`usable` refuses, or of another length than most, take no
    part; repeated rows count once.  Without usable rows the result is empty.  A
    table of doubles is searched by its single-precision values and ranked on the
    doubles.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("embedding")).where("vec_id is not null").where(usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    rows = rows.where(F.size("embedding") == sizes[0].d)
    # classes of equal vectors, with the k + 1 smallest ids and whether a query is among all
    least = rows.distinct().withColumn("at", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    ids = least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    flags = rows.groupBy("embedding").agg(F.max(is_query).alias("asks"))
    classes = materialize(ids.join(flags, "embedding").select(F.col("ids")[0].alias("id"), "embedding", "ids", "asks"), "ann-classes")
    totals = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("q")).first()
    if not totals.q:
        return empty
    part = min(1.0, 1.1 * sample / totals.n)
    chosen = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("id", "embedding").toArrow()
    order = np.argsort(chosen["id"].to_numpy())[:sample]
    data = _matrix(chosen["embedding"].combine_chunks())[order]
    if not len(data):
        data = _matrix(classes.limit(sample).select("embedding").toArrow()["embedding"].combine_chunks())
    model = train(data, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms = model.encode(_matrix(batch.column(1)).astype(np.float32), beam) if batch.num_rows else (np.zeros((0, books), np.uint8), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt(norms).astype(np.float32))], ["id", "codes", "norm"])

    index = materialize(classes.select("id", "embedding").mapInArrow(encode, "id long, codes binary, norm float"), "ann-codes")
    n_shards, n_blocks = -(-totals.n // SHARD_ROWS), -(-int(totals.q) // QUERY_ROWS)
    number = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    shards = _pack(index.withColumn("shard", number(n_shards, 1)), "shard", ["id", "codes", "norm"])
    blocks = _pack(classes.where("asks").select("id", "embedding", number(n_blocks, 2).alias("block")), "block", ["id", "embedding"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shards.select("shard", F.col("id").alias("ids"), "codes", F.col("norm").alias("norms"), every(n_blocks).alias("block"))
    right = blocks.select("block", F.col("id").alias("query_ids"), F.col("embedding").alias("queries"), every(n_shards).alias("shard"))
    pairs = left.repartition(min(n_shards * n_blocks, MOST_TASKS), "shard", "block").join(right, ["shard", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[row].as_py(), dtype=np.int64)
                codes = np.frombuffer(batch.column(1)[row].as_py(), dtype=np.uint8).reshape(len(ids), -1)
                qid = np.frombuffer(batch.column(2)[row].as_py(), dtype=np.int64)
                q = np.frombuffer(batch.column(3)[row].as_py(), dtype=np.float32).reshape(len(qid), -1)
                norms = np.frombuffer(batch.column(4)[row].as_py(), dtype=np.float32)
                m, w, d = model.words.shape
                place = codes.T.astype(np.intp) + (np.arange(m) * w)[:, None]
                tables = q @ model.words.reshape(m * w, d).T
                got_n, got_id, got_s = [], [], []
                for table, reach in zip(tables, np.sqrt(np.square(q).sum(axis=1)), strict=True):
                    best, score = _best_codes(table, float(reach), place, ids, norms, rerank)
                    got_n.append(len(best))
                    got_id.append(best)
                    got_s.append(score)
                structs = pa.StructArray.from_arrays([pa.array(np.concatenate(got_s).astype(np.float32)), pa.array(np.concatenate(got_id))], ["s", "id"])
                offsets = pa.array(np.append(0, np.cumsum(got_n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.full(len(qid), batch.column(5)[row].as_py(), np.int32)), pa.ListArray.from_arrays(offsets, structs)], ["q", "shard", "found"])

    best = pairs.select("ids", "codes", "query_ids", "queries", "norms", "shard").mapInArrow(search, "q long, shard int, found array<struct<s:float,id:long>>")
    left_over = n_shards
    while left_over > 1:  # each row holds the best of FAN_IN shards at most
        left_over = -(-left_over // FAN_IN)
        best = best.groupBy("q", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, rerank).alias("found"))
    candidates = best.select("q", F.explode("found.id").alias("id"))
    exact = (
        candidates.join(classes.select(F.col("id").alias("q"), F.col("embedding").alias("query")), "q")
        .join(classes.select("id", "embedding", "ids"), "id")
        .withColumn("score", F.aggregate(F.zip_with("query", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x))
        .select("q", "score", F.explode("ids").alias("vec_id"))
    )
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = exact.withColumn("at", F.row_number().over(by_class)).where(F.col("at") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("top"))
    asking = rows.where(is_query).distinct().join(classes.where("asks").select("embedding", F.col("id").alias("q")), "embedding").select(F.col("vec_id").alias("query_id"), "q")
    mine = asking.join(lists, "q").select("query_id", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return mine.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
