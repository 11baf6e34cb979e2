"""The resolution table, policies, laws of alignment, gates."""

import itertools

import pytest
from pyspark.sql import functions as F

from genoloom.functions.alleles import chromosome, is_snp, pseudohaploid_status, resolve, swapped
from genoloom.model import InvariantBroken, Policy, UsageFailed
from genoloom.operators import alignment as al
from genoloom.operators import gates as ga

VARIANTS = "row_idx long, chrom int, pos long, id string, ref string, alt string, cm double"


def variants(spark, *rows):
    """Rows (row_idx, chrom, pos, ref, alt)."""
    return spark.createDataFrame([(r, c, p, f"v{r}", a, b, 0.0) for r, c, p, a, b in rows], VARIANTS)


def expected(cr, ca, r, a, trust):
    """The table, told the plain way."""
    flip = dict(zip("ACGT", "TGCA", strict=True))
    if any(x not in flip for x in (cr, ca, r, a)):
        return ("drop", "allele_mismatch")
    if flip[cr] == ca:
        if {r, a} != {cr, ca}:
            return ("drop", "allele_mismatch")
        return ("passthrough", None) if trust else ("drop", "ambiguous_strand")
    tries = [((r, a), "passthrough"), ((a, r), "ref_alt_swap"), ((flip[r], flip[a]), "strand_flip"), ((flip[a], flip[r]), "strand_flip_and_swap")]
    return next(((name, None) for pair, name in tries if pair == (cr, ca)), ("drop", "allele_mismatch"))


@pytest.mark.parametrize("trust", [False, True])
def test_resolution_of_every_combination(spark, trust):
    combos = list(itertools.product("ACGT", "ACGT", "ACGTN", "ACGTN"))
    df = spark.createDataFrame(combos, "cr string, ca string, r string, a string")
    got = df.select("*", resolve(F.col("cr"), F.col("ca"), F.col("r"), F.col("a"), F.lit(True), trust).alias("x")).collect()
    for row in got:
        assert (row.x.action, row.x.reason) == expected(row.cr, row.ca, row.r, row.a, trust), row


def test_absent_variant_overrides_everything(spark):
    got = spark.range(1).select(resolve(F.lit("A"), F.lit("T"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)).alias("x")).first().x
    assert (got.action, got.reason) == ("fill_missing", None)


@pytest.mark.parametrize(("label", "code"), [("1", 1), ("chr22", 22), ("CHRx", 23), ("Y", 24), (" mt ", 26), ("chrM", 26), ("25", 25), ("0", None), ("27", None), ("XY", None), ("scaffold1", None), ("", None)])
def test_chromosome_labels(spark, label, code):
    assert spark.range(1).select(chromosome(F.lit(label))).first()[0] == code


def test_lower_case_alleles_are_no_snps(spark):
    df = spark.createDataFrame([("A", "C"), ("a", "c"), ("AT", "A"), (None, "A"), ("N", "A")], "ref string, alt string")
    assert [r[0] for r in df.select(is_snp(F.col("ref"), F.col("alt"))).collect()] == [True, False, False, False, False]


def test_swap_keeps_missing(spark):
    assert spark.range(1).select(swapped(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(None)).cast("array<tinyint>"))).first()[0] == [2, 1, 0, None]


@pytest.mark.parametrize(("het", "called", "status"), [(0, 0, "U"), (0, 10, "1"), (1, 20, "0"), (1, 21, "U"), (5, 10, "0")])
def test_pseudohaploid_status(spark, het, called, status):
    assert spark.range(1).select(pseudohaploid_status(F.lit(het), F.lit(called))).first()[0] == status


def test_self_alignment_is_identity(spark):
    a = variants(spark, (0, 1, 10, "A", "C"), (2, 1, 20, "G", "A"), (3, 2, 10, "T", "C"))
    rows = al.align(a, [a], Policy()).collect()
    assert {r.action for r in rows} == {"passthrough"}
    assert all(r.canonical_row == r.other_row for r in rows)


def test_counts_by_chromosome_add_up(spark):
    a = variants(spark, (0, 1, 10, "A", "C"), (1, 1, 20, "A", "T"), (2, 2, 10, "T", "C"), (3, 3, 5, "A", "G"))
    b = variants(spark, (0, 1, 10, "C", "A"), (1, 1, 20, "A", "T"), (2, 2, 10, "A", "G"))
    alignment = al.align(a, [b], Policy())
    total = al.histogram(alignment).first().asDict()
    by = [r.asDict() for r in al.histogram_by_chromosome(alignment).collect()]
    assert total == {k: sum(r[k] for r in by) for k in total}
    assert (total["swap"], total["flip"], total["fill_missing"], total["dropped_ambiguous_strand"]) == (1, 1, 1, 1)


def test_policies_rewrite(spark):
    a = variants(spark, (0, 1, 10, "A", "C"), (1, 1, 20, "A", "G"))
    b = variants(spark, (0, 1, 10, "T", "G"))
    rows = {r.pos: (r.action, r.reason) for r in al.align(a, [b], Policy(on_missing="drop_variant", on_strand="drop")).collect()}
    assert rows == {10: ("drop", "on_strand_drop"), 20: ("drop", "on_missing_drop")}
    assert al.intersection_size(al.align(a, [b], Policy(on_missing="drop_variant"))).first().n == 2


def test_softened_errors_are_counted(spark):
    a = variants(spark, (0, 1, 10, "A", "C"), (1, 1, 20, "A", "G"), (2, 1, 30, "A", "G"))
    b = variants(spark, (0, 1, 10, "T", "G"), (1, 1, 20, "A", "C"))
    policy = Policy(on_strand="error", on_mismatch="error", on_missing="error", on_extra="error")
    assert al.policy_triggers(al.align(a, [b], policy), 4, policy) == {"on_mismatch": 1, "on_missing": 1, "on_extra": 4, "on_strand": 1}


def test_duplicate_keys_are_refused_on_either_side(spark):
    a = variants(spark, (0, 1, 10, "A", "C"), (1, 1, 10, "A", "G"))
    with pytest.raises(InvariantBroken, match="chrom=1, pos=10"):
        al.require_unique(a, ["chrom", "pos"], "panel 1")


def test_extras_gate_is_strict(spark):
    a = variants(spark, *[(i, 1, i, "A", "C") for i in range(10)])
    for extra, fires in ((1, False), (2, True)):
        extras = spark.createDataFrame([(1, extra)], "input_idx int, extras long")
        assert ga.extras_gate(a, extras, Policy()).first().fires is fires
    assert ga.extras_gate(a, extras, Policy(on_extra="error")).first().fires is False


def test_bad_policy():
    with pytest.raises(UsageFailed):
        Policy(on_missing="ignore")
