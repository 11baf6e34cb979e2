"""Compatibility of panels, before any genotype is read."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BUILD_MISMATCH, COMPATIBLE, DISJOINT_PANELS, EMPTY_INPUT, KEY_SPACE_MISMATCH, InvariantBroken, Policy

# Ids that stand for none.
PLACEHOLDER_IDS = (".", "", "0", "NA", "nan", "None")
LEAST_FRACTION, LEAST_LIFT = 0.5, 0.4
LEAST_PER_CHROM, LEAST_SHIFT, MOST_RELATIVE_MAD, LEAST_CONSISTENT = 5, 1000.0, 0.1, 0.5


def other_key(variant_key: str) -> str:
    return "id" if variant_key == "chr_pos" else "chr_pos"


def _keys(variants: DataFrame, variant_key: str, with_chrom: bool = False) -> DataFrame:
    """Distinct keys; ids without placeholders."""
    if variant_key == "chr_pos":
        return variants.select("chrom", "pos").distinct()
    named = variants.where(~F.coalesce(F.col("id"), F.lit("")).isin(*PLACEHOLDER_IDS))
    return named.select(*(["chrom"] if with_chrom else []), "id").distinct()


def _sides(canonical: DataFrame, other: DataFrame, variant_key: str, with_chrom: bool) -> DataFrame:
    """Each key once, with a flag for each side: both sides meet in one aggregation."""
    a = _keys(canonical, variant_key, with_chrom).select("*", F.lit(1).alias("c"), F.lit(0).alias("o"))
    b = _keys(other, variant_key, with_chrom).select("*", F.lit(0).alias("c"), F.lit(1).alias("o"))
    keys = [x for x in a.columns if x not in ("c", "o")]
    return a.unionByName(b).groupBy(*keys).agg(F.max("c").alias("c"), F.max("o").alias("o"))


def _sum(x, name: str):
    return F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)


def intersection(canonical: DataFrame, other: DataFrame, variant_key: str) -> DataFrame:
    """n_canonical, n_other, n_inter, frac (of the smaller side; 0 if that is empty) over distinct keys."""
    counts = _sides(canonical, other, variant_key, False).agg(_sum("c", "n_canonical"), _sum("o", "n_other"), _sum(F.col("c") * F.col("o"), "n_inter"))
    least = F.least("n_canonical", "n_other")
    return counts.withColumn("frac", F.when(least > 0, F.col("n_inter").cast("double") / least.cast("double")).otherwise(F.lit(0.0)))


def per_chromosome(canonical: DataFrame, other: DataFrame, variant_key: str) -> DataFrame:
    """chrom, canonical_size, other_size, intersection; an id on two chromosomes counts on each."""
    both = _sides(canonical, other, variant_key, True)
    return both.groupBy("chrom").agg(_sum("c", "canonical_size"), _sum("o", "other_size"), _sum(F.col("c") * F.col("o"), "intersection"))


def shift_signature(canonical: DataFrame, other: DataFrame, per_chrom: DataFrame) -> DataFrame:
    """chrom, median_shift, rel_mad, consistent for chromosomes with enough keys and no common one.

    The i-th smallest positions of both sides are paired.  Ranks come from a
    window by chromosome: panels have a few dozen of those, and at most some
    million variants on one, which sort with spilling.
    """
    chosen = per_chrom.where((F.col("canonical_size") >= LEAST_PER_CHROM) & (F.col("other_size") >= LEAST_PER_CHROM) & (F.col("intersection") == 0)).select("chrom")

    def ranked(variants: DataFrame, name: str) -> DataFrame:
        rows = variants.select("chrom", F.col("pos").alias(name)).join(chosen, "chrom", "left_semi")
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy("chrom").orderBy(name)))

    shifts = ranked(canonical, "a").join(ranked(other, "b"), ["chrom", "rn"]).select("chrom", (F.col("b") - F.col("a")).cast("double").alias("shift"))
    return _shift_rows(shifts, ["chrom"])


def _shift_rows(shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Median shift and relative median absolute deviation by the keys."""
    middle = shifts.groupBy(*keys).agg(F.median("shift").alias("median_shift"))
    spread = shifts.join(F.broadcast(middle), keys).groupBy(*keys).agg(F.first("median_shift").alias("median_shift"), F.median(F.abs(F.col("shift") - F.col("median_shift"))).alias("mad"))
    relative = F.col("mad") / F.greatest(F.abs("median_shift"), F.lit(1.0))
    return spread.select(*keys, "median_shift", relative.alias("rel_mad"), ((F.abs("median_shift") >= LEAST_SHIFT) & (relative <= MOST_RELATIVE_MAD)).alias("consistent"))


@dataclass(frozen=True)
class Comparison:
    """How the canonical panel and another one fit together."""

    input_index: int
    path: str
    active: dict[str, Any]
    alternate: dict[str, Any]
    alternate_key: str
    per_chrom: list[dict[str, int]]
    signature: dict[str, Any] | None
    label: str
    evidence: dict[str, Any]


def classify(active: dict[str, Any], alternate: dict[str, Any], per_chrom: list[dict[str, int]], signature: dict[str, Any] | None) -> tuple[str, dict[str, Any]]:
    """(label, evidence); the first rule that holds decides."""
    ours = [c for c in per_chrom if c["canonical_size"] > 0]
    theirs = [c for c in per_chrom if c["other_size"] > 0]
    shared = [c for c in ours if c["other_size"] > 0]
    apart = [c for c in shared if c["intersection"] == 0]
    evidence: dict[str, Any] = {
        "active_key_fraction": active["frac"],
        "alternate_key_fraction": alternate["frac"],
        "n_canonical_chroms": len(ours),
        "n_other_chroms": len(theirs),
        "n_shared_chroms": len(shared),
        "n_shared_chroms_zero_overlap": len(apart),
        "n_chroms_only_canonical": len(ours) - len(shared),
        "n_chroms_only_other": len(theirs) - len(shared),
        "canonical_active_size": sum(c["canonical_size"] for c in per_chrom),
    }
    if active["n_other"] == 0 or evidence["canonical_active_size"] == 0:
        return EMPTY_INPUT, evidence
    if active["frac"] >= LEAST_FRACTION:
        return COMPATIBLE, evidence
    if alternate["frac"] - active["frac"] >= LEAST_LIFT:
        return KEY_SPACE_MISMATCH, evidence
    if shared and len(apart) == len(shared) == len(ours) == len(theirs):
        if signature is None:
            evidence["build_shift_signature_available"] = False
            return BUILD_MISMATCH, evidence
        evidence["build_shift_n_chroms_evaluated"] = len(signature["chroms_evaluated"])
        evidence["build_shift_n_consistent"] = signature["n_consistent_shift_chroms"]
        evidence["build_shift_has_consistent_shift"] = signature["has_consistent_shift"]
        if signature["has_consistent_shift"]:
            return BUILD_MISMATCH, evidence
    return DISJOINT_PANELS, evidence


def _signature(rows: list) -> dict[str, Any] | None:
    if not rows:
        return None
    consistent = sum(bool(r.consistent) for r in rows)
    return {
        "chroms_evaluated": [int(r.chrom) for r in rows],
        "median_shift_per_chrom": {str(r.chrom): float(r.median_shift) for r in rows},
        "relative_mad_per_chrom": {str(r.chrom): float(r.rel_mad) for r in rows},
        "n_consistent_shift_chroms": consistent,
        "has_consistent_shift": consistent >= max(1, int(LEAST_CONSISTENT * len(rows) + 0.5)),
    }


@dataclass(frozen=True)
class Overlaps:
    """What all comparisons of the first panel with the others need, by key: sizes over all keys, and by chromosome; signatures."""

    totals: dict[str, list[dict[str, Any]]]
    per_chrom: dict[str, list[list[dict[str, int]]]]
    shifts: list[dict[int, Any]]  # by chromosome, of each other panel


#: Panels that one pass compares with the first, each a bit of a mask.
AT_ONCE = 48


def _check_positions(rows: DataFrame) -> None:
    """Positions must be from 0 to below 2**40."""
    bad = rows.where((F.col("pos") < 0) | (F.col("pos") >= 1 << 40)).agg(F.min(F.struct("input", "chrom", "pos")).alias("x")).first().x
    if bad:
        who = f"panel {bad.input}" if bad.input else "the first panel"
        raise InvariantBroken(f"{who} has position {bad.pos} on chromosome {bad.chrom}; it must be from 0 to below 2**40")


def _sizes(masks: DataFrame, n: int) -> list:
    """Sums over a table of masks: keys of each panel, and of the first and each other."""
    has = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    one = lambda x, name: F.count(F.when(x, F.lit(1))).alias(name)
    return [one(has(i), f"size_{i}") for i in range(n + 1)] + [one(has(0) & has(i), f"both_{i}") for i in range(1, n + 1)]


def overlaps(canonical: DataFrame, others: list[DataFrame]) -> Overlaps:
    """All panels in one table: each key becomes a mask of the panels that have it, and masks are counted by chromosome.

    Two jobs for positions, two for ids, one for all signatures, however many
    panels there are (up to AT_ONCE); rows that come to the driver are one for each
    chromosome, and one more.
    """
    if len(others) > AT_ONCE:
        a, b = overlaps(canonical, others[:AT_ONCE]), overlaps(canonical, others[AT_ONCE:])
        return Overlaps({k: a.totals[k] + b.totals[k] for k in a.totals}, {k: a.per_chrom[k] + b.per_chrom[k] for k in a.per_chrom}, a.shifts + b.shifts)
    n = len(others)
    rows = canonical.select(F.lit(0).alias("input"), "chrom", "pos", "id")
    for i, other in enumerate(others, 1):
        rows = rows.unionByName(other.select(F.lit(i).alias("input"), "chrom", "pos", "id"))
    rows = rows.persist()
    try:
        _check_positions(rows)
        bit = F.bit_or(F.expr("shiftleft(1L, input)")).alias("mask")
        named = rows.where(~F.coalesce(F.col("id"), F.lit("")).isin(*PLACEHOLDER_IDS))
        masks = {"chr_pos": rows.groupBy("chrom", "pos").agg(bit), "id": named.groupBy("chrom", "id").agg(bit)}
        counted = {k: m.groupBy("chrom").agg(*_sizes(m, n)).orderBy("chrom").collect() for k, m in masks.items()}
        over_all = {"chr_pos": {c: sum(r[c] for r in counted["chr_pos"]) for c in [f"size_{i}" for i in range(n + 1)] + [f"both_{i}" for i in range(1, n + 1)]}}
        over_all["id"] = masks["id"].groupBy("id").agg(F.bit_or("mask").alias("mask")).agg(*_sizes(masks["id"], n)).first().asDict()
        totals: dict[str, list[dict[str, Any]]] = {}
        per_chrom: dict[str, list[list[dict[str, int]]]] = {}
        for key, total in over_all.items():
            totals[key], per_chrom[key] = [], []
            for i in range(1, n + 1):
                ours, theirs, both = total["size_0"], total[f"size_{i}"], total[f"both_{i}"]
                totals[key].append({"n_canonical": ours, "n_other": theirs, "n_inter": both, "frac": both / min(ours, theirs) if min(ours, theirs) else 0.0})
                found = [{"chrom": r.chrom, "canonical_size": r["size_0"], "other_size": r[f"size_{i}"], "intersection": r[f"both_{i}"]} for r in counted[key]]
                per_chrom[key].append([r for r in found if r["canonical_size"] or r["other_size"]])
        apart = {(i, r["chrom"]) for own in per_chrom.values() for i, x in enumerate(own, 1) for r in x if _apart(r)}
        return Overlaps(totals, per_chrom, _shifts(rows, sorted(apart), n))
    finally:
        rows.unpersist()


def _apart(r: dict[str, int]) -> bool:
    """Whether both panels have enough keys on a chromosome, and none in common."""
    return min(r["canonical_size"], r["other_size"]) >= LEAST_PER_CHROM and not r["intersection"]


def _shifts(rows: DataFrame, apart: list[tuple[int, int]], n: int) -> list[dict[int, Any]]:
    """The shifts of the pairs (panel, chromosome), all in one job; ranks as in :func:`shift_signature`."""
    if not apart:
        return [{} for _ in range(n)]
    pairs = F.broadcast(rows.sparkSession.createDataFrame(apart, "input int, chrom int"))  # a row for each panel and chromosome at most
    by_place = Window.partitionBy("input", "chrom").orderBy("pos")
    theirs = rows.join(pairs, ["input", "chrom"], "left_semi").select("input", "chrom", F.col("pos").alias("b"), F.row_number().over(by_place).alias("rn"))
    first = rows.where("input = 0").join(pairs.select("chrom").distinct(), "chrom", "left_semi")
    ours = first.select("chrom", F.col("pos").alias("a"), F.row_number().over(Window.partitionBy("chrom").orderBy("pos")).alias("rn"))
    shifts = theirs.join(ours, ["chrom", "rn"]).select("input", "chrom", (F.col("b") - F.col("a")).cast("double").alias("shift"))
    found: list[dict[int, Any]] = [{} for _ in range(n)]
    for r in _shift_rows(shifts, ["input", "chrom"]).orderBy("input", "chrom").collect():
        found[r.input - 1][r.chrom] = r
    return found


def compared(found: Overlaps, variant_key: str, paths: list[str] | None = None) -> list[Comparison]:
    """The comparisons of the first panel with each other one under a key."""
    out, alternate_key = [], other_key(variant_key)
    for i, (active, alternate, rows) in enumerate(zip(found.totals[variant_key], found.totals[alternate_key], found.per_chrom[variant_key], strict=True), 1):
        signature = _signature([found.shifts[i - 1][r["chrom"]] for r in rows if _apart(r) and r["chrom"] in found.shifts[i - 1]])
        label, evidence = classify(active, alternate, rows, signature)
        out.append(Comparison(i, paths[i - 1] if paths else "", active, alternate, alternate_key, rows, signature, label, evidence))
    return out


def compare(canonical: DataFrame, other: DataFrame, variant_key: str, index: int = 1, path: str = "") -> Comparison:
    """One comparison; several of one panel share their passes in :func:`overlaps`."""
    return replace(compared(overlaps(canonical, [other]), variant_key, [path])[0], input_index=index)


def gate(comparisons: list[Comparison], policy: Policy) -> dict[str, Any]:
    """Whether a pair is not compatible, and what the policy makes of it."""
    bad = [c.label != COMPATIBLE for c in comparisons]
    action = {"off": "none", "warn": "warn", "strict": "error"}[policy.preflight_policy] if any(bad) else "none"
    return {"policy": policy.preflight_policy, "triggered": action != "none", "would_trigger": any(bad), "action": action, "labels": [c.label for c in comparisons]}


def report(paths: list[str], comparisons: list[Comparison], policy: Policy, command: str, version: str) -> dict[str, Any]:
    """The preflight document, schema 1."""
    return {
        "schema_version": 1,
        "tool": "genoloom",
        "tool_version": version,
        "command": command,
        "variant_key": policy.variant_key,
        "canonical": {"path": paths[0], "index": 0, "n_variants": comparisons[0].active["n_canonical"] if comparisons else None},
        "comparisons": [
            {
                "input_index": c.input_index,
                "path": c.path,
                "n_variants": c.active["n_other"],
                "intersection": c.active["n_inter"],
                "intersection_fraction_of_min": c.active["frac"],
                "per_chrom": c.per_chrom,
                "alternate_key": c.alternate_key,
                "alternate_key_canonical_size": c.alternate["n_canonical"],
                "alternate_key_other_size": c.alternate["n_other"],
                "alternate_key_intersection": c.alternate["n_inter"],
                "alternate_key_fraction_of_min": c.alternate["frac"],
                "build_shift_signature": c.signature,
                "classification": c.label,
                "classification_evidence": c.evidence,
            }
            for c in comparisons
        ],
        "gate": gate(comparisons, policy),
    }
