"""Quality by a regularised quadratic discriminant (operator 8).

Each text becomes a vector of transformed statistics.  Class means and
covariances come from sums over all labelled rows, added up where the rows are;
the driver gets a few hundred numbers.  A class covariance is shrunk towards the
pooled one and that towards its mean variance, and its inverse Cholesky factor
is kept, so a score is a difference of two squared norms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import EXACT, SPACED, Words, _word_bytes, list_array, string_chunks

LINES = _word_bytes([(0x0A, 0x0A)])
#: Labels that :func:`drop_low_quality` learns from, at most.
LEARNT = 1 << 18
#: Typical words added to each text's statistics.
STEADY_WORDS = 20.0


def _group(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[list(chars)] = True
    return lut


_BYTE_GROUPS = [
    _group(bytes(range(65, 91))),
    _group(bytes(range(48, 58))),
    _group(b".,;:?"),
    _group(b"!"),
    _group(b"#$%&*@^~+=<>{}[]\\/_`"),
    _group(b"|"),
    _group(b"\n"),
    _group(bytes(range(128, 256))),
]
FEATURES = [
    "log_words", "word_length", "word_length_spread", "longest_word",
    "upper", "digits", "stops", "shouts", "symbols", "bars", "breaks", "wide",
    "distinct_words", "commonest_word", "repeated_neighbours", "distinct_pairs", "repeated_lines", "capital_words", "odd_ends",
]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, count of the commonest) of each text."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(x)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], size)
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block; all zero for a text without words."""
    n = len(offsets) - 1
    words = Words(data, offsets, SPACED, EXACT)
    count = words.counts().astype(float)
    some = np.maximum(count, 1)
    size = (words.ends - words.starts).astype(float)
    doc = words.doc
    total = lambda x: np.bincount(doc, weights=x, minlength=n)
    mean = total(size) / some
    spread = np.sqrt(np.maximum(total(size * size) / some - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    length = np.maximum(np.diff(offsets), 1).astype(float)
    shares = []
    for group in _BYTE_GROUPS:
        run = np.append(0, np.cumsum(group[data]))
        shares.append(np.sqrt((run[offsets[1:]] - run[offsets[:-1]]) / length))
    h = words.hash
    distinct, most = _distinct(doc, h, n)
    near = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    same = np.bincount(doc[near], weights=(h[near] == h[near + 1]).astype(float), minlength=n)
    pairs, _ = _distinct(doc[near], h[near] * np.uint64(0x9E3779B97F4A7C15) + h[near + 1], n)
    lines = Words(data, offsets, LINES, EXACT)
    line_kinds, _ = _distinct(lines.doc, lines.hash, n)
    line_count = np.maximum(lines.counts(), 1)
    first, last = data[words.starts], data[words.ends - 1]
    capital = total(_BYTE_GROUPS[0][first].astype(float)) / some
    odd = total((_BYTE_GROUPS[3] | _BYTE_GROUPS[4])[last].astype(float)) / some
    out = np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(spread), np.log1p(longest),
        *shares,
        distinct / some, np.sqrt(most / some), np.sqrt(same / some), pairs / np.maximum(count - 1, 1),
        np.sqrt(1 - np.minimum(line_kinds / line_count, 1)), np.sqrt(capital), np.sqrt(odd),
    ])
    out[count == 0] = 0
    return out


def _of_column(column: pa.Array) -> np.ndarray:
    rows = [statistics(data, offsets) for _, _, data, offsets in string_chunks(column)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array x of FEATURES, of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _of_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(x.ravel(), np.full(len(x), len(FEATURES)), pa.float64())], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, "doc_id long, x array<double>")


def steadied(x: np.ndarray, centre: np.ndarray, words: float = STEADY_WORDS) -> np.ndarray:
    """Statistics drawn towards the centre as if ``words`` typical words were added: those of short texts are noise."""
    n = np.expm1(x[:, :1])
    out = centre + (x - centre) * (n / (n + words))
    out[:, 0] = x[:, 0]
    return out


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log terms of classes 0 and 1, over statistics steadied towards a centre."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray
    centre: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = x if self.centre is None else steadied(x, self.centre)
        log = [self.constant[c] - 0.5 * np.square((x - self.mean[c]) @ self.factor[c].T).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def _discriminant(count: np.ndarray, first: np.ndarray, second: np.ndarray, to_pooled: float, to_mean: float) -> Discriminant:
    """From each class's count, sum of x and sum of x xᵀ.

    Without any labelled row every score is 0.5; a class without one takes the
    other's mean and covariance, so that scores are its smoothed share.
    """
    d = first.shape[1]
    if count.sum() == 0:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2))
    mean = first / np.maximum(count, 1)[:, None]
    scatter = second - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / max(count.sum() - 2, 1)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, constants = [], []
    for c in (0, 1):
        if count[c] == 0:
            mean[c] = mean[1 - c]
        own = (scatter[c] if count[c] else scatter[1 - c]) / max((count[c] or count[1 - c]) - 1, 1)
        cov = ((1 - to_pooled) * own + to_pooled * pooled) / np.outer(unit, unit)
        cov = (1 - to_mean) * cov + to_mean * (np.trace(cov) / d + 1e-3) * np.eye(d)
        low = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.solve(low, np.diag(1 / unit)))
        constants.append(np.log((count[c] + 1) / (count.sum() + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factors), np.array(constants))


def fit(rows: DataFrame, to_pooled: float = 0.1, to_mean: float = 0.02) -> Discriminant:
    """rows: label (0 or 1; others and nulls are left out) and x.

    to_pooled shrinks a class covariance towards the pooled one, to_mean towards
    a multiple of the identity.  Two passes: the mean of all, then the moments of
    the statistics steadied towards it.
    """
    centre = _moments(rows, None)
    total = centre[:, 0, 0].sum()
    middle = centre[:, 0, 1:].sum(axis=0) / max(total, 1)
    m = _moments(rows, middle)
    return replace(_discriminant(m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 1:], to_pooled, to_mean), centre=middle)


def _moments(rows: DataFrame, centre: np.ndarray | None) -> np.ndarray:
    """For each class the sums of z zᵀ, where z is 1 and the statistics."""
    d = len(FEATURES) + 1

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(label), d - 1)
            z = np.column_stack([np.ones(len(label)), x if centre is None else steadied(x, centre)])
            for c in (0, 1):
                total[c] += z[label == c].T @ z[label == c]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), list_array(total.ravel(), np.array([d * d, d * d]), pa.float64())], ["label", "m"])

    chosen = rows.where("label in (0, 1)").select(F.col("label").cast("int"), "x")
    sums = chosen.mapInArrow(moments, "label int, m array<double>").select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    total = np.zeros((2, d * d))
    for row in sums.collect():  # 2 x 400 numbers
        total[row.label, row.k] = row.v
    return total.reshape(2, d, d)


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _training(x: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    return x.join(known.where(~held_out(F.col("doc_id"))), "doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame, to_pooled: float = 0.1, to_mean: float = 0.02) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Texts are read once: their statistics are written to the shared folder and
    serve for both learning and scoring.  Null and empty texts have the zero
    vector and are scored like any other; null ids are not held out and have no
    labels; repeated rows are scored alike; an empty table gives no rows.
    """
    from .store import materialize

    x = materialize(features(docs), "quality-features")
    model = fit(materialize(_training(x, labels), "quality-training"), to_pooled, to_mean)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(v))], ["doc_id", "score"])

    scored = x.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _learnt(docs: DataFrame, labels: DataFrame, text_col: str, most: int = LEARNT) -> DataFrame:
    """label, x of the rows of docs with labels to learn from, in one pass without a shuffle.

    labels: doc_id, label.  The labels go along with the tasks; beyond ``most`` of
    them, those of a share of the documents (by hash) do.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    found = known.select("doc_id", F.col("label").cast("int").alias("label")).toArrow()
    ids, place = np.unique(found["doc_id"].to_numpy(), return_inverse=True)
    times = np.zeros((2, len(ids)), np.int64)
    np.add.at(times, (found["label"].to_numpy(), place), 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            rows = np.flatnonzero((ids[at] == own) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
            if len(rows):
                x = _of_column(batch.column(1).take(pa.array(rows)))
                k, label = (np.concatenate(y) for y in zip(*[(np.repeat(np.arange(len(rows)), m[at[rows]]), np.full(m[at[rows]].sum(), c)) for c, m in enumerate(times)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), list_array(x[k].ravel(), np.full(len(k), x.shape[1]), pa.float64())], ["label", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "label int, x array<double>")


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs scored at least ``least``, with all their columns.

    The model is fitted as in :func:`quality_scores`, on the statistics of rows with
    labels to learn from alone; rows are then scored and filtered in one pass
    without a shuffle.  Null and empty texts are scored as the zero vector, rows with
    null ids like others; repeated rows stay or go together; without labels all have
    the score 0.5; an empty table gives no rows.  Other columns, whatever their
    names, go along.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    from .store import materialize

    model = fit(materialize(_learnt(docs, known, text_col), "quality-training"))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(_of_column(batch.column(at))) >= least))

    return docs.mapInArrow(keep, docs.schema)
