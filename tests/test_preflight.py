"""Compatibility labels."""

import pytest

from genoloom.model import InvariantBroken, Policy
from genoloom.operators import preflight as pf

from .test_alignment import variants


def _panel(spark, places, name="v"):
    rows = [(k, c, p, "A", "G") for k, (c, p) in enumerate(places)]
    return variants(spark, *rows).withColumnRenamed("id", "_").selectExpr("row_idx", "chrom", "pos", f"concat('{name}', chrom, ':', pos) AS id", "ref", "alt", "cm")


GRID = [(c, 1000 + 37 * k) for c in (1, 2) for k in range(20)]


@pytest.mark.parametrize(("other", "name", "key", "label"), [
    (GRID, "v", "chr_pos", "compatible"),
    ([(c, p + 1_000_000) for c, p in GRID], "w", "chr_pos", "build_mismatch"),
    (GRID, "rs", "chr_pos", "compatible"),
    (GRID, "rs", "id", "key_space_mismatch"),
    ([(1 if c == 1 else 3, p + 7) for c, p in GRID], "w", "chr_pos", "disjoint_panels"),
    ([(c, 3 * p * p + 1) for c, p in GRID], "w", "chr_pos", "disjoint_panels"),
    ([(c, p + 5) for c, p in GRID], "w", "chr_pos", "disjoint_panels"),
    ([], "w", "chr_pos", "empty_input"),
])
def test_labels(spark, other, name, key, label):
    assert pf.compare(_panel(spark, GRID), _panel(spark, other, name), key).label == label


def test_few_keys_have_no_signature(spark):
    few = GRID[:3] + GRID[20:23]
    found = pf.compare(_panel(spark, few), _panel(spark, [(c, p + 2_000_000) for c, p in few], "w"), "chr_pos")
    assert found.label == "build_mismatch" and found.signature is None and found.evidence["build_shift_signature_available"] is False


def test_placeholder_ids_do_not_count(spark):
    named = _panel(spark, GRID).selectExpr("row_idx", "chrom", "pos", "'.' AS id", "ref", "alt", "cm")
    assert pf.intersection(named, named, "id").first().n_inter == 0
    assert pf.compare(named, named, "chr_pos").label == "compatible"


def test_positions_are_checked(spark):
    with pytest.raises(InvariantBroken):
        pf.compare(_panel(spark, GRID), _panel(spark, [(1, 1 << 40)]), "chr_pos")


def test_gate_by_policy(spark):
    bad = [pf.compare(_panel(spark, GRID), _panel(spark, [], "w"), "chr_pos")]
    seen = {p: pf.gate(bad, Policy(preflight_policy=p)) for p in ("off", "warn", "strict")}
    assert [seen[p]["action"] for p in ("off", "warn", "strict")] == ["none", "warn", "error"]
    assert all(g["would_trigger"] for g in seen.values())
