"""Mixing documents to target weights by iterative proportional fitting (operator 9).

Token counts are added up by cell (source, language, topic).  The cells are
raked: each dimension in turn is scaled to its target shares, until all hold.
A document's probability is how much its cell is scaled, times a rate at which no
cell needs more than all of its documents, so that the sample has the raked
shares.  Columns and SQL functions only.

Cells are few next to documents; up to LOCAL_CELLS of them one task rakes them,
a few sweeps at a time, by window sums over a single partition.  Beyond that each
step is an aggregation and a join of the cell table.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

DIMENSIONS = ("source", "lang", "topic")
LOCAL_CELLS = 20_000
NO_VALUE = "(none)"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text: Column, topics: int = 8) -> Column:
    """A topic number from the whole text: its word of least hash, so that texts of like vocabulary tend to share it."""
    least = F.array_min(F.transform(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: F.xxhash64(w)))
    return F.coalesce(F.pmod(least, F.lit(topics)).cast("string"), F.lit(NO_VALUE))


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every row; null values are ``(none)``."""
    topic = topic_of(F.col("text")) if topic is None else topic
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("row_hash"),
        F.coalesce(F.col("source").cast("string"), F.lit(NO_VALUE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_VALUE)).alias("lang"),
        F.coalesce(topic.cast("string"), F.lit(NO_VALUE)).alias("topic"),
        word_count(F.col("text").cast("string")).alias("tokens"),
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, share: shares proportional to a power of those found."""
    found = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    powered = found.where("t > 0").withColumn("x", F.pow("t", F.lit(power)))
    whole = powered.agg(F.sum("x").alias("all")).first().all
    return powered.select("value", (F.col("x") / F.lit(float(whole or 1.0))).alias("share"))


def _given(cells: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    total = float(sum(shares.values()))
    return cells.sparkSession.createDataFrame([(k, float(v) / total) for k, v in shares.items()], "value string, share double")


def _scaled(w: Column, share: Column, now: Column, total: Column) -> Column:
    return F.when(now > 0, w * share * total / now).otherwise(F.lit(0.0))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = 3, tolerance: float = 1e-6, most_rounds: int = 24) -> DataFrame:
    """cells (source, lang, topic, tokens) with ratio: scaled weight over token share.

    targets: dimension to (value, share).  A value without a target gets weight 0,
    a target without tokens is left out and the others share its part.  Stops
    when every marginal is within ``tolerance`` of its target, or after
    ``most_rounds`` times ``sweeps`` sweeps if the targets contradict each other.
    """
    table = cells
    for d, shares in targets.items():
        table = table.join(shares.select(F.col("value").alias(d), F.col("share").alias(f"share_{d}")), d, "left").fillna({f"share_{d}": 0.0})
    table = materialize(table.withColumn("w", F.col("tokens").cast("double")), "mix-cells")
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("t")).first()
    if not size.t:
        return table.select(*DIMENSIONS, "tokens", F.lit(0.0).alias("ratio"))
    total = F.lit(size.t)
    for _ in range(most_rounds):
        if size.n <= LOCAL_CELLS:
            table = table.repartition(1)
            for _ in range(sweeps):
                for d in targets:
                    table = table.withColumn("w", _scaled(F.col("w"), F.col(f"share_{d}"), F.sum("w").over(Window.partitionBy(d)), total))
            table = materialize(table, "mix-cells")
        else:
            for d in list(targets) * sweeps:
                sums = table.groupBy(d).agg(F.sum("w").alias("now"))
                table = materialize(table.join(sums, d).withColumn("w", _scaled(F.col("w"), F.col(f"share_{d}"), F.col("now"), total)).drop("now"), "mix-cells")
        errors = [table.groupBy(d).agg(F.sum("w").alias("w"), F.first(f"share_{d}").alias("s")).select(F.max(F.abs(F.col("w") / total - F.col("s"))).alias("e")) for d in targets]
        worst = max(e.first().e for e in errors)
        if worst <= tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {most_rounds * sweeps} sweeps with a marginal {worst:.3g} off its target", stacklevel=2)
    kept = table.agg(F.sum("w").alias("w")).first().w or size.t
    ratio = F.when(F.col("tokens") > 0, (F.col("w") / F.lit(kept)) / (F.col("tokens") / total)).otherwise(F.lit(0.0))
    return table.select(*DIMENSIONS, "tokens", ratio.alias("ratio"))


def _chances(rows: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float) -> DataFrame:
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-sums")
    wanted = {d: tempered(cells, d, t) if isinstance(t, (int, float)) else _given(cells, t) for d, t in targets.items()}
    raked = materialize(rake(cells, wanted), "mix-raked")
    most = raked.agg(F.max("ratio").alias("most")).first().most
    rate = min(rate, 1 / most) if most else rate
    return raked.select(*DIMENSIONS, "ratio", F.least(F.lit(1.0), F.lit(rate) * F.col("ratio")).alias("probability"))


def _draw(row_hash: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the row and the seed alone."""
    return F.pmod(F.xxhash64(row_hash, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float = 1.0, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, ratio, probability, sampled of every row.

    targets: for each dimension either shares by value or a power to which the
    found shares are raised.  ratio: how much the document's cell is scaled;
    probability: it times ``rate``, or times the largest rate that leaves every
    probability at 1 or less, if that is smaller; sampled: drawn by a hash of id and
    text, so that repeated rows are drawn alike.  Documents without words have no
    weight: they have ratio and probability 1 as they cost nothing.  Null
    source, lang and topic are a value of their own; an empty table gives no rows.
    """
    rows = with_cells(docs, topic)
    chances = _chances(rows, targets, rate)
    out = rows.join(chances, list(DIMENSIONS))
    blank = F.col("tokens") == 0
    ratio, chance = F.when(blank, 1.0).otherwise(F.col("ratio")), F.when(blank, 1.0).otherwise(F.col("probability"))
    return out.select("doc_id", *DIMENSIONS, "tokens", ratio.alias("ratio"), chance.alias("probability"), (_draw(F.col("row_hash"), seed) < chance).alias("sampled"))


def sample_mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float = 1.0, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """The rows of docs that :func:`mix` samples, with all their columns, whatever their names.

    Null source, lang and topic are values of their own; texts without words, null
    or not, stay; repeated rows stay or go together; an empty table gives no rows.
    """
    topic = topic_of(F.col("text")) if topic is None else topic
    chances = _chances(with_cells(docs, topic), targets, rate)
    mark = "_mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    own = {d: f"{mark}_{d}" for d in DIMENSIONS}
    keyed = docs.withColumns({
        own["source"]: F.coalesce(F.col("source").cast("string"), F.lit(NO_VALUE)),
        own["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit(NO_VALUE)),
        own["topic"]: F.coalesce(topic.cast("string"), F.lit(NO_VALUE)),
    })
    chances = chances.select(*[F.col(d).alias(own[d]) for d in DIMENSIONS], F.col("probability").alias(f"{mark}_probability"))
    blank = word_count(F.col("text").cast("string")) == 0
    joined = keyed.join(chances, list(own.values()))
    return joined.where(blank | (_draw(F.xxhash64(F.col("doc_id"), F.col("text")), seed) < F.col(f"{mark}_probability"))).select(*docs.columns)
