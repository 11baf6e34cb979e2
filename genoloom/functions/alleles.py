"""Column expressions over alleles, chromosomes and dosages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import (
    ALLELE_MISMATCH,
    AMBIGUOUS_STRAND,
    DROP,
    FILL_MISSING,
    ON_MISSING_DROP,
    ON_STRAND_DROP,
    PASSTHROUGH,
    REF_ALT_SWAP,
    STRAND_FLIP,
    STRAND_FLIP_AND_SWAP,
    Policy,
)

BASE = "^[ACGT]$"
# Numbers of the lettered chromosomes.
LETTERED = {"X": 23, "Y": 24, "MT": 26, "M": 26}


def complement(allele: Column) -> Column:
    """Watson-Crick complement."""
    return F.translate(allele, "ACGT", "TGCA")


def is_ambiguous(ref: Column, alt: Column) -> Column:
    """Whether a pair reads the same on either strand."""
    return complement(ref) == alt


def is_snp(ref: Column, alt: Column) -> Column:
    """Whether both alleles are one upper-case base; nulls are not."""
    return F.coalesce(ref, F.lit("")).rlike(BASE) & F.coalesce(alt, F.lit("")).rlike(BASE)


def chromosome(raw: Column) -> Column:
    """Chromosome number 1 to 26 of a label such as 7, chr7, X or chrMT; null if it is none."""
    label = F.upper(F.regexp_replace(F.trim(raw), "(?i)^chr", ""))
    number = label.try_cast("int")
    out = F.when(label.rlike("^[0-9]+$") & number.between(1, 26), number)
    for letter, code in LETTERED.items():
        out = out.when(label == letter, F.lit(code))
    return out


def centimorgans(raw: Column) -> Column:
    """A genetic position; 0 where the text is no number."""
    return F.coalesce(F.nanvl(raw.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def _result(action: str, reason: str | None = None) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"))


def resolve(c_ref: Column, c_alt: Column, o_ref: Column, o_alt: Column, present: Column, trust_strand: bool = False) -> Column:
    """Struct (action, reason) that makes the other panel's alleles agree with the canonical ones."""
    usable = is_snp(c_ref, c_alt) & is_snp(o_ref, o_alt)
    same = (o_ref == c_ref) & (o_alt == c_alt)
    turned = (o_alt == c_ref) & (o_ref == c_alt)
    ambiguous = is_ambiguous(c_ref, c_alt)
    return (
        F.when(~present, _result(FILL_MISSING))
        .when(~usable, _result(DROP, ALLELE_MISMATCH))
        .when(ambiguous & ~same & ~turned, _result(DROP, ALLELE_MISMATCH))
        .when(ambiguous, _result(PASSTHROUGH) if trust_strand else _result(DROP, AMBIGUOUS_STRAND))
        .when(same, _result(PASSTHROUGH))
        .when(turned, _result(REF_ALT_SWAP))
        .when((complement(o_ref) == c_ref) & (complement(o_alt) == c_alt), _result(STRAND_FLIP))
        .when((complement(o_alt) == c_ref) & (complement(o_ref) == c_alt), _result(STRAND_FLIP_AND_SWAP))
        .otherwise(_result(DROP, ALLELE_MISMATCH))
    )


def under_policy(result: Column, policy: Policy) -> Column:
    """The result after the policies that drop; those that raise leave it unchanged."""
    action = result["action"]
    out = F.when(F.lit(False), result)
    if policy.on_missing == "drop_variant":
        out = out.when(action == FILL_MISSING, _result(DROP, ON_MISSING_DROP))
    if policy.on_strand == "drop":
        out = out.when(action.isin(STRAND_FLIP, STRAND_FLIP_AND_SWAP), _result(DROP, ON_STRAND_DROP))
    return out.otherwise(result)


def is_swap(action: Column) -> Column:
    return action.isin(REF_ALT_SWAP, STRAND_FLIP_AND_SWAP)


def swapped(dosages: Column) -> Column:
    """Counts of the other allele; missing stays missing."""
    return F.transform(dosages, lambda x: (F.lit(2) - x).cast("tinyint"))


def missing(n: Column | int) -> Column:
    """n missing dosages."""
    return F.array_repeat(F.lit(None).cast("tinyint"), F.lit(n) if isinstance(n, int) else n)


def pseudohaploid_status(het: Column, called: Column) -> Column:
    """``1`` without a heterozygous call, ``0`` from 5 % of them, else ``U``."""
    return F.when(called == 0, "U").when(het == 0, "1").when(het.cast("double") / called.cast("double") >= F.lit(0.05), "0").otherwise("U")
