"""Language by error-correcting output codes (operator 4).

Each language has a codeword.  One binary classifier a bit, over hashed byte
trigrams, tells the languages whose codewords have that bit set from the
others; its weights are log ratios of smoothed trigram shares, counted over all
training texts.  A text gets the language whose codeword has the least summed
logistic loss against the classifiers' margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import string_chunks

BITS = 15
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_FOLD[[c for c in range(128) if not (65 <= c < 91 or 97 <= c < 123)]] = 32
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts in order, number of each text's).

    A text is padded by a blank on both sides; what is not a letter or a
    non-ASCII byte counts as a blank, and trigrams around two blanks are left out.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(len(data) + 2 * n, 32, dtype=np.uint8)
    start = offsets[:-1] + 2 * np.arange(n)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, size)
    out[place] = _FOLD[data]
    if len(out) < 3:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    wide = out.astype(np.uint32)
    code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    good = (out[1:-1] != 32) | ((out[:-2] != 32) & (out[2:] != 32))
    edge = start[1:]
    good[edge - 1] = False
    good[edge[edge >= 2] - 2] = False
    count = np.append(0, np.cumsum(good))
    stop = np.append(start[1:], len(out)) - 2
    hashed = ((code[good].astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)
    return hashed.astype(np.int64), count[np.maximum(stop, start)] - count[start]


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n classes.

    Up to 7 classes: every split of them.  More: distinct splits from a fixed
    generator, 10 times as many as bits are needed to tell the classes apart.
    """
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 7:
        bits = [[1 if not c else 1 - 2 * (k >> (c - 1) & 1) for k in range(1, 1 << (n - 1))] for c in range(n)]
        return np.array(bits, dtype=np.int8)
    rng, columns = np.random.default_rng(n), set()
    while len(columns) < 10 * int(np.ceil(np.log2(n))):
        column = rng.integers(0, 2, n) * 2 - 1
        if abs(column.sum()) < n:
            columns.add(tuple((column * column[0]).tolist()))
    return np.array(sorted(columns), dtype=np.int8).T


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords, and a column of trigram weights for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, gap of loss to the second) of each text."""
        n, bits = len(counts), self.weights.shape[1]
        sums = np.zeros((n, bits))
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            sums[some] = np.add.reduceat(self.weights[grams], first, axis=0, dtype=np.float64)
        margin = np.clip(sums / np.sqrt(np.maximum(counts, 1))[:, None], -30, 30)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(n), order[:, 0]]
        share = 1 / np.exp(-(loss - best[:, None])).sum(axis=1)
        gap = loss[np.arange(n), order[:, 1]] - best if loss.shape[1] > 1 else np.full(n, np.inf)
        return order[:, 0], share, gap


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over docs (columns text, lang); added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, offsets in string_chunks(batch.column(0)):
                grams, counts = trigrams(data, offsets)
                of = np.repeat(np.arange(a, b), counts)
                names = sorted(set(langs[a:b]))
                place = {x: i for i, x in enumerate(names)}
                key = np.array([place[x] for x in langs[a:b]], dtype=np.int64)[of - a]
                got = np.bincount((key << BITS) | grams, minlength=len(names) << BITS).reshape(len(names), -1)
                for x, row in zip(names, got, strict=True):
                    total[x] = total[x] + row if x in total else row
        for x, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows of docs (text, lang); null texts and langs are left out.

    The driver gets at most 2**15 counts a language.
    """
    known = docs.where("text is not null and lang is not null")
    table = gram_counts(known).toArrow()
    lang = np.array(table["lang"].to_pylist(), dtype=object)
    languages = sorted(set(lang.tolist()) | {r.lang for r in known.select("lang").distinct().collect()})
    counts = np.zeros((len(languages), 1 << BITS))
    place = {x: i for i, x in enumerate(languages)}
    if len(lang):
        np.add.at(counts, ([place[x] for x in lang.tolist()], table["gram"].to_numpy()), table["n"].to_numpy())
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    columns = [np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]
    weights = np.array(columns, dtype=np.float32).T if columns else np.zeros((1 << BITS, 0), np.float32)
    return LanguageModel(languages, code, np.ascontiguousarray(weights))


def predict(docs: DataFrame, model: LanguageModel, least_gap: float = 0.7) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of docs (doc_id, text).

    score is the share of exp(-loss) that the chosen language has among all; a
    gap of loss to the second of less than least_gap counts as ambiguous.  Null
    texts, texts without a letter, and all texts if no language was learnt are
    ``und``, with score 0, and not ambiguous.
    """

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, doubts = [], [], []
            for a, b, data, offsets in string_chunks(batch.column(1), 2 << 20):
                run = np.append(0, np.cumsum(_LETTERS[data]))
                lettered = run[offsets[1:]] > run[offsets[:-1]]
                for row in np.flatnonzero(~lettered):
                    lettered[row] = any(c.isalpha() for c in data[offsets[row] : offsets[row + 1]].tobytes().decode())
                if model.languages:
                    at, share, gap = model.decode(*trigrams(data, offsets))
                    names += [model.languages[i] if ok else UNDETERMINED for i, ok in zip(at.tolist(), lettered.tolist(), strict=True)]
                    scores.append(np.where(lettered, share, 0.0))
                    doubts.append((gap < least_gap) & lettered)
                else:
                    names += [UNDETERMINED] * (b - a)
                    scores.append(np.zeros(b - a))
                    doubts.append(np.zeros(b - a, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(np.concatenate([np.zeros(0, bool), *doubts]))],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(guess, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out, and predicts all: doc_id, held_out, lang_pred, score, ambiguous.

    Null ids are not held out; repeated rows are predicted alike; an empty table
    gives no rows; other columns are not read.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
