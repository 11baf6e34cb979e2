"""Alignment of panels to the canonical one: joins, actions, counts.

The result is long, one row for each canonical variant and other panel, so that
every count is one aggregation and reports are plain projections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import resolve, under_policy
from ..model import (
    ALLELE_MISMATCH,
    AMBIGUOUS_STRAND,
    DROP,
    FILL_MISSING,
    HISTOGRAM_KEYS,
    ON_MISSING_DROP,
    ON_STRAND_DROP,
    PASSTHROUGH,
    REF_ALT_SWAP,
    STRAND_FLIP,
    STRAND_FLIP_AND_SWAP,
    InvariantBroken,
    Policy,
)


def duplicate_keys(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number n."""
    return variants.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(variants: DataFrame, keys: list[str], who: str) -> None:
    """Raises for the least key that occurs more than once."""
    worst = duplicate_keys(variants, keys).orderBy(*keys).head(1)
    if worst:
        key = ", ".join(f"{k}={worst[0][k]}" for k in keys)
        raise InvariantBroken(f"{who} has {worst[0].n} variants with {key}")


def align(canonical: DataFrame, others: list[DataFrame], policy: Policy) -> DataFrame:
    """canonical_row, variant_id, chrom, pos, ref, alt, cm, input_idx, action, reason, other_row.

    The canonical side is never reordered or multiplied: each other panel meets it
    in one left outer equi-join on the policy's key, of the columns needed alone.
    """
    keys = policy.keys
    parts = []
    for i, other in enumerate(others, 1):
        right = other.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("ref").alias("o_ref"), F.col("alt").alias("o_alt"), F.col("row_idx").alias("other_row"))
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"o_{k}") for k in keys])
        joined = canonical.join(right, on, "left")
        result = resolve(F.col("ref"), F.col("alt"), F.col("o_ref"), F.col("o_alt"), F.col("other_row").isNotNull(), policy.trust_strand)
        parts.append(joined.withColumn("r", under_policy(result, policy)).select(
            F.col("row_idx").alias("canonical_row"), F.col("id").alias("variant_id"), "chrom", "pos", "ref", "alt", "cm",
            F.lit(i).alias("input_idx"), F.col("r.action").alias("action"), F.col("r.reason").alias("reason"), "other_row",
        ))
    return reduce(DataFrame.unionByName, parts)


def extras(canonical: DataFrame, others: list[DataFrame], policy: Policy) -> DataFrame:
    """input_idx, extras: distinct keys of each other panel that the canonical one lacks."""
    parts = []
    for i, other in enumerate(others, 1):
        lacking = other.select(*policy.keys).distinct().join(canonical.select(*policy.keys), policy.keys, "left_anti")
        parts.append(lacking.agg(F.count("*").alias("extras")).select(F.lit(i).alias("input_idx"), "extras"))
    return reduce(DataFrame.unionByName, parts)


def _one(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def histogram_columns() -> list[Column]:
    """The nine counts, in order of HISTOGRAM_KEYS."""
    action, reason = F.col("action"), F.col("reason")
    dropped = action == DROP
    conditions = (
        action == PASSTHROUGH,
        action == REF_ALT_SWAP,
        action.isin(STRAND_FLIP, STRAND_FLIP_AND_SWAP),
        action == FILL_MISSING,
        dropped & (reason == AMBIGUOUS_STRAND),
        dropped & (reason == ALLELE_MISMATCH),
        dropped & (reason == ON_STRAND_DROP),
        F.lit(False),
        dropped & (reason == ON_MISSING_DROP),
    )
    return [_one(c).alias(k) for c, k in zip(conditions, HISTOGRAM_KEYS, strict=True)]


def histogram(alignment: DataFrame) -> DataFrame:
    """The nine counts over all panels, in one row."""
    return alignment.agg(*histogram_columns())


def histogram_by_chromosome(alignment: DataFrame) -> DataFrame:
    """chrom and the nine counts, for the chromosomes that occur."""
    return alignment.groupBy("chrom").agg(*histogram_columns())


def tally(alignment: DataFrame) -> DataFrame:
    """action, reason, n."""
    return alignment.groupBy("action", "reason").agg(F.count("*").alias("n"))


def kept(alignment: DataFrame) -> DataFrame:
    """canonical_row, variant_id, chrom, pos, ref, alt, cm of variants that no panel drops."""
    whole = ["canonical_row", "variant_id", "chrom", "pos", "ref", "alt", "cm"]
    return alignment.groupBy(*whole).agg(F.max((F.col("action") == DROP).cast("int")).alias("d")).where("d = 0").drop("d")


def intersection_size(alignment: DataFrame) -> DataFrame:
    """n: canonical variants that at least one other panel has."""
    present = (F.col("action") != FILL_MISSING).cast("int")
    return alignment.groupBy("canonical_row").agg(F.max(present).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("n"))


def report_rows(alignment: DataFrame) -> DataFrame:
    """variant_id, chr, pos, input_index, action, reason (empty if none) and canonical_row, for the report."""
    return alignment.select("variant_id", F.col("chrom").alias("chr"), "pos", F.col("input_idx").alias("input_index"), "action", F.coalesce("reason", F.lit("")).alias("reason"), "canonical_row")


def policy_triggers(alignment: DataFrame, extra_count: int, policy: Policy) -> dict[str, int]:
    """For each policy that is ``error``, how often it would have raised; others are 0."""
    row = alignment.agg(
        _one((F.col("action") == DROP) & (F.col("reason") == ALLELE_MISMATCH)).alias("mismatch"),
        _one(F.col("action") == FILL_MISSING).alias("missing"),
        _one(F.col("action").isin(STRAND_FLIP, STRAND_FLIP_AND_SWAP)).alias("strand"),
    ).first()
    return {
        "on_mismatch": int(row.mismatch) if policy.on_mismatch == "error" else 0,
        "on_missing": int(row.missing) if policy.on_missing == "error" else 0,
        "on_extra": extra_count if policy.on_extra == "error" else 0,
        "on_strand": int(row.strand) if policy.on_strand == "error" else 0,
    }
