"""Quality gates: scalar comparisons of small counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AMBIGUOUS_STRAND, COMPATIBLE, DROP, FILL_MISSING, Policy


def _row(frame: DataFrame, numerator: str, denominator: str, threshold: float, fires) -> DataFrame:
    return frame.select(F.col(numerator).cast("long").alias("numerator"), F.col(denominator).cast("long").alias("denominator"), F.lit(float(threshold)).alias("threshold"), F.coalesce(fires, F.lit(False)).alias("fires"))


def extras_gate(canonical: DataFrame, extras: DataFrame, policy: Policy) -> DataFrame:
    """Fires under ``on_extra=warn`` if the extras of all panels are more than the threshold's share of canonical variants."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = canonical.select(zero.alias("x"), one.alias("n")).unionByName(extras.select(F.col("extras").cast("long").alias("x"), zero.alias("n")))
    both = parts.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    fires = F.lit(policy.on_extra == "warn") & (F.col("n") > 0) & (F.col("x").cast("double") > F.lit(policy.extras_warn_threshold) * F.col("n").cast("double"))
    return _row(both, "x", "n", policy.extras_warn_threshold, fires)


def ambiguous_gate(alignment: DataFrame, policy: Policy) -> DataFrame:
    """Fires if ambiguous drops (over all panels) exceed a percentage of the variants that any panel shares."""
    ambiguous = ((F.col("action") == DROP) & (F.col("reason") == AMBIGUOUS_STRAND)).cast("int")
    each = alignment.groupBy("canonical_row").agg(F.sum(ambiguous).alias("x"), F.max((F.col("action") != FILL_MISSING).cast("int")).alias("n"))
    both = each.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    fires = (F.col("n") > 0) & (F.col("x").cast("double") / F.col("n").cast("double") * 100.0 > F.lit(policy.validate_strand_fail_pct))
    return _row(both, "x", "n", policy.validate_strand_fail_pct, fires)


def call_rate_gate(counters: DataFrame, targets: DataFrame, n_canonical: int, policy: Policy) -> DataFrame:
    """iid, numerator (called), denominator (canonical variants), threshold, fires for each sample of a target panel.

    counters: iid, called; targets: iid.
    """
    fires = F.lit(n_canonical > 0) & (F.col("called").cast("double") / F.lit(float(n_canonical or 1)) < F.lit(policy.target_min_call_rate))
    joined = counters.join(targets.select("iid"), "iid", "left_semi")
    return joined.select("iid", F.col("called").cast("long").alias("numerator"), F.lit(n_canonical).cast("long").alias("denominator"), F.lit(policy.target_min_call_rate).alias("threshold"), fires.alias("fires"))


def preflight_gate(labels: DataFrame, policy: str) -> DataFrame:
    """policy, would_trigger, action (none, warn or error) from the label of each pair."""
    bad = labels.agg(F.coalesce(F.max((F.col("label") != COMPATIBLE).cast("int")), F.lit(0)).alias("bad"))
    fires = F.col("bad") == 1
    action = {"off": "none", "warn": "warn", "strict": "error"}[policy]
    return bad.select(F.lit(policy).alias("policy"), fires.alias("would_trigger"), F.when(fires, action).otherwise("none").alias("action"))
