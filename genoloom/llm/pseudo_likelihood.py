"""Document scores by masked pseudo-likelihood (operator 5).

A small network predicts every token from the tokens on both sides of it, never
from the token itself: embeddings of the neighbours, a hidden layer, and a
two-step softmax over a product code of the token (first its class, then its
member of the class), which gives the probability of the token's slot; times the
word's share of all words counted in its slot, that is the probability of the
word.  A document's score is the sum of the log-probabilities of its words.

Words are counted over all documents, one row a distinct word (its 64-bit hash).
The most frequent of them, FREQUENT at most, go to all tasks; the others meet
their counts in a join.

The network is trained in numpy on all documents, in ROUNDS short rounds: each
learns the texts of one slice (by hash, so copies are together).  In a round each
task starts from the same parameters and trains on its own texts of the slice; the
parameters, and the sums of squared gradients that set the steps, are averaged,
weighted by tokens, with one aggregation.  A slice is new to the parameters that
it is begun with, so the log-likelihood of its tokens as they are first seen is a
held-out measure that needs no pass of its own.  The parameters depend on how
rows lie in partitions.  The network's size is fixed, the table of words grows
with the distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textkernel import LOWER, SPACED, Words, list_array, signed, string_chunks

CLASS_BITS = 6
SIDE = 1 << CLASS_BITS
VOCABULARY = SIDE * SIDE
BLANK = VOCABULARY  # stands for a place beyond either end of the text
REACH = 2
WIDTH, HIDDEN = 16, 32
BATCH = 2048
_SHAPES = {
    "embed": (VOCABULARY + 1, WIDTH),
    "w1": (2 * REACH * WIDTH, HIDDEN), "b1": (1, HIDDEN),
    "wa": (HIDDEN, SIDE), "ba": (1, SIDE),
    "ea": (SIDE, HIDDEN), "wb": (HIDDEN, SIDE), "bb": (SIDE, SIDE),
}
SIZE = sum(a * b for a, b in _SHAPES.values())
CHUNK = 1024
#: Slices that all texts are dealt to, and learnt one after another.
ROUNDS = 4
#: Words whose counts every task holds.
FREQUENT = 1 << 18
_UNIT = float(1 << 32)  # logarithms of counts are added up as whole numbers, so that their order is of no matter


class Model(NamedTuple):
    """Network parameters; words counted: by slot, the frequent ones (sorted hashes and log counts), and all (word, n); held-out log-likelihoods."""

    flat: np.ndarray
    slots: np.ndarray
    frequent: np.ndarray
    logs: np.ndarray
    least: int
    words: DataFrame
    held_out: list[float]


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 2 * CLASS_BITS)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers of all texts in order, number of each text's): lower-cased words, hashed."""
    words = Words(data, offsets, SPACED, LOWER)
    return slot_of(words.hash), words.counts()


def contexts(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The REACH tokens on either side of each token, within its text."""
    n = len(token)
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.full((n, 2 * REACH), BLANK, dtype=np.uint16)
    for k in range(1, REACH + 1):
        if n > k:
            same = doc[k:] == doc[:-k]
            out[k:, REACH - k][same] = token[:-k][same]
            out[:-k, REACH + k - 1][same] = token[k:][same]
    return out


def _sums_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 16-bit keys, sum of the rows of each)."""
    order = np.argsort(key, kind="stable")  # a radix sort, at this width
    ordered = key[order]
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    return ordered[last], np.add.reduceat(rows[order], np.append(0, last[:-1] + 1), axis=0)


class Network:
    """Parameters, forward pass and one step of AdaGrad."""

    def __init__(self, flat: np.ndarray, squares: np.ndarray | None = None):
        self.flat = flat.astype(np.float32).copy()
        self.squares = np.full(SIZE, 1e-3, np.float32) if squares is None else squares.astype(np.float32).copy()
        self.p: dict[str, np.ndarray] = {}
        self.seen: dict[str, np.ndarray] = {}
        at = 0
        for name, (a, b) in _SHAPES.items():
            self.p[name], self.seen[name] = (x[at : at + a * b].reshape(a, b) for x in (self.flat, self.squares))
            at += a * b

    @staticmethod
    def fresh(seed: int = 3, slots: np.ndarray | None = None) -> np.ndarray:
        """Random parameters; with counts by slot, those of a network that starts at the shares of the slots."""
        rng = np.random.default_rng(seed)
        p = {name: (rng.standard_normal((a, b)) * (0.0 if a == 1 or name == "bb" else 0.3 if name == "embed" else 1 / np.sqrt(a))).astype(np.float32) for name, (a, b) in _SHAPES.items()}
        if slots is not None:
            n = (slots + 1.0).reshape(SIDE, SIDE)
            p["ba"], p["bb"] = np.log(n.sum(axis=1, keepdims=True).T / n.sum()), np.log(n / n.sum(axis=1, keepdims=True))
            p["wa"], p["wb"] = p["wa"] * 0.1, p["wb"] * 0.1
        return np.concatenate([x.ravel().astype(np.float32) for x in p.values()])

    @staticmethod
    def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exponentials, their sums by row); logits are shifted only where they would overflow."""
        e = np.exp(logits)
        z = e.sum(axis=1)
        if not (z.min(initial=1) > 1e-30 and z.max(initial=1) < 1e30):
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            z = e.sum(axis=1)
        return e, z

    def _forward(self, context: np.ndarray, token: np.ndarray):
        p = self.p
        x = p["embed"][context].reshape(len(context), -1)
        h = x @ p["w1"]
        h += p["b1"]
        np.tanh(h, out=h)
        a, b = token >> CLASS_BITS, token & (SIDE - 1)
        la = h @ p["wa"]
        la += p["ba"]
        scale = 1 + p["ea"][a]
        g = h * scale
        lb = g @ p["wb"]
        lb += p["bb"][a]
        ea, za = self._softmax(la)
        eb, zb = self._softmax(lb)
        rows = np.arange(len(token))
        log = la[rows, a] + lb[rows, b] - np.log(za) - np.log(zb)
        return log, (x, h, a, b, ea, za, scale, g, eb, zb, rows)

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        parts = [self._forward(context[i : i + 4 * BATCH], token[i : i + 4 * BATCH])[0] for i in range(0, len(token), 4 * BATCH)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def _move(self, name: str, gradient: np.ndarray, rate: float) -> None:
        self.seen[name] += gradient * gradient
        self.p[name] -= rate * gradient / np.sqrt(self.seen[name])

    def step(self, context: np.ndarray, token: np.ndarray, rate: float) -> float:
        """Learns the tokens; the sum of their log-probabilities before."""
        by_class = np.argsort((token >> CLASS_BITS).astype(np.uint8), kind="stable")
        context, token = context[by_class], token[by_class]
        log, (x, h, a, b, da, za, scale, g, db, zb, rows) = self._forward(context, token)
        p, n = self.p, np.float32(len(token))
        da *= (1 / (n * za))[:, None]
        db *= (1 / (n * zb))[:, None]
        da[rows, a] -= 1 / n
        db[rows, b] -= 1 / n
        dg = db @ p["wb"].T
        dh = (da @ p["wa"].T + dg * scale) * (1 - h * h)
        ga, gb = np.zeros((SIDE, HIDDEN), np.float32), np.zeros((SIDE, SIDE), np.float32)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        ga[a[first]], gb[a[first]] = np.add.reduceat(dg * h, first, axis=0), np.add.reduceat(db, first, axis=0)
        used, ge = _sums_by(context.ravel(), (dh @ p["w1"].T).reshape(-1, WIDTH))
        seen = self.seen["embed"][used] + ge * ge
        self.seen["embed"][used] = seen
        p["embed"][used] -= rate * ge / np.sqrt(seen)
        for name, gradient in (("w1", x.T @ dh), ("b1", dh.sum(axis=0, keepdims=True)), ("wa", h.T @ da), ("ba", da.sum(axis=0, keepdims=True)), ("wb", g.T @ db), ("ea", ga), ("bb", gb)):
            self._move(name, gradient, rate)
        return float(log.sum(dtype=np.float64))


def _learn(docs: DataFrame, flat: np.ndarray, squares: np.ndarray | None, rate: float) -> tuple[np.ndarray, np.ndarray | None, float | None]:
    """(parameters, squared gradients) after one pass of every task over its texts, averaged by tokens; mean log-likelihood of a slot as first seen."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, log = Network(flat, squares), 0, 0.0
        for batch in batches:
            for _, _, data, offsets in string_chunks(batch.column(0)):
                token, counts = tokens(data, offsets)
                context = contexts(token, counts)
                order = np.random.default_rng(len(token)).permutation(len(token))
                for i in range(0, len(token), BATCH):
                    at = order[i : i + BATCH]
                    log += net.step(context[at], token[at], rate)
                seen += len(token)
        if seen:
            both = np.concatenate([net.flat, net.squares, [log / seen]]).astype(np.float64) * seen
            for k in range(0, len(both), CHUNK):
                part = both[k : k + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), seen, np.int64))], ["k", "v", "seen"])

    sums = docs.select("text").mapInArrow(learn, "k int, v double, seen long").groupBy("k").agg(F.sum("v").alias("v"), F.sum("seen").alias("seen")).toArrow()
    if not sums.num_rows:
        return flat, squares, None
    out = np.zeros(2 * SIZE + 1)
    out[sums["k"].to_numpy()] = sums["v"].to_numpy() / sums["seen"].to_numpy()
    return out[:SIZE].astype(np.float32), out[SIZE:-1].astype(np.float32), float(out[-1])


def slot_likelihood(docs: DataFrame, flat: np.ndarray) -> float | None:
    """Mean log-probability of the slots of all tokens; none without tokens."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for batch in batches:
            for _, _, data, offsets in string_chunks(batch.column(0)):
                token, counts = tokens(data, offsets)
                log = net.log_probabilities(contexts(token, counts), token).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([log.sum()]), pa.array([len(token)])], ["v", "n"])

    whole = docs.select("text").mapInArrow(measure, "v double, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    return whole.v / whole.n if whole.n else None


def fit(docs: DataFrame, slots: np.ndarray | None = None, epochs: int = 1, rate: float = 0.1, seed: int = 3, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """(parameters fitted on all texts of docs, mean log-likelihood of a slot in each round before it is learnt).

    With the words counted by slot the network starts at the slots' shares.  An
    epoch learns every text once, in ``rounds`` slices; the measures of the first
    epoch are of texts that the network has not seen.
    """
    flat, squares, measured = Network.fresh(seed, slots), None, []
    for k in range(epochs * rounds):
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k % rounds) if rounds > 1 else docs
        flat, squares, log = _learn(part, flat, squares, rate)
        measured += [log] if log is not None else []
    return flat, measured


def count_words(docs: DataFrame) -> DataFrame:
    """word (signed hash), n of every distinct word of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in string_chunks(batch.column(0)):
                word, n = np.unique(Words(data, offsets, SPACED, LOWER).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(n.astype(np.int64))], ["word", "n"])

    return materialize(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "likelihood-words")


def train(docs: DataFrame, epochs: int = 1, rate: float = 0.1, seed: int = 3, rounds: int = ROUNDS) -> Model:
    """The network fitted on all texts of docs (see :func:`fit`), and their words counted."""
    words = count_words(docs)
    slots = np.zeros(VOCABULARY, np.int64)
    found = words.groupBy(F.shiftrightunsigned("word", 64 - 2 * CLASS_BITS).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    slots[found["slot"].to_numpy()] = found["n"].to_numpy()
    flat, held_out = fit(docs, slots, epochs, rate, seed, rounds)
    power, held = 64, 0
    for r in sorted(words.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        power = r.power
    least = 1 << min(power, 62)
    top = words.where(F.col("n") >= least).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Model(flat, slots, hashes[order], np.log(top["n"].to_numpy()[order].astype(np.float64)), least, words, held_out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (their sum) and mean_log_likelihood of every row.

    A null, empty or blank text has no tokens: its sum is 0 and its mean null.  A
    word that was not counted has the share of one that occurs once.
    """
    flat, frequent, logs = model.flat, model.frequent, model.logs
    of_slot = np.log(np.maximum(model.slots, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, row = Network(flat), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(1)):
                words = Words(data, offsets, SPACED, LOWER)
                token, counts = slot_of(words.hash), words.counts()
                log = net.log_probabilities(contexts(token, counts), token).astype(np.float64) - of_slot[token]
                known = np.zeros(len(token), bool)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, words.hash), len(frequent) - 1)
                    known = frequent[place] == words.hash
                    log[known] += logs[place[known]]
                sums = np.diff(np.append(0, np.cumsum(log))[words.first])
                others = np.bincount(words.doc[~known], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(counts), pa.array(sums), list_array(signed(words.hash[~known]), others, pa.int64())],
                    ["row", "doc_id", "n_tokens", "part", "others"],
                )
                row += b - a

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialize(texts.mapInArrow(measure, "row long, doc_id long, n_tokens long, part double, others array<long>"), "likelihood-rows")
    rare = model.words.where((F.col("n") > 1) & (F.col("n") < model.least)).select("word", F.round(F.log("n") * _UNIT).cast("long").alias("log"))
    more = scored.select("row", F.explode("others").alias("word")).join(rare, "word").groupBy("row").agg((F.sum("log") / _UNIT).alias("more"))
    whole = F.col("part") + F.coalesce("more", F.lit(0.0))
    return scored.drop("others").join(more, "row", "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, epochs: int = 1, rate: float = 0.1) -> DataFrame:
    """Trains on all texts and scores every row; see :func:`score`.

    Null ids and repeated rows are scored like others; an empty table gives no
    rows; other columns are not read.
    """
    return score(docs, train(docs.select(F.col("text").cast("string").alias("text")), epochs, rate))
