"""Which files a prefix names, and in which format."""

from __future__ import annotations

import os
from dataclasses import dataclass

from ..model import IOFailed, UsageFailed

# Suffixes that a prefix may carry by mistake; the double one first.
SUFFIXES = (".pvar.zst", ".pgen", ".pvar", ".psam", ".bed", ".bim", ".fam", ".geno", ".snp", ".ind")

PFILE, BFILE, EIGENSTRAT = "pfile", "bfile", "eigenstrat"


@dataclass(frozen=True)
class Files:
    """A panel's three files."""

    prefix: str
    format: str
    genotypes: str
    variants: str
    samples: str


def strip_known_suffix(prefix: str) -> str:
    for suffix in SUFFIXES:
        if prefix.endswith(suffix) and len(prefix) > len(suffix):
            return prefix[: -len(suffix)]
    return prefix


def variant_file(prefix: str) -> str | None:
    """The plain variant text, or else the compressed one."""
    return next((p for p in (f"{prefix}.pvar", f"{prefix}.pvar.zst") if os.path.exists(p)), None)


def detect(prefix: str) -> Files:
    """The first format whose genotype file is there; its companions must be there too."""
    prefix = strip_known_suffix(prefix)
    for fmt, geno, variants, samples in ((PFILE, ".pgen", ".pvar", ".psam"), (BFILE, ".bed", ".bim", ".fam"), (EIGENSTRAT, ".geno", ".snp", ".ind")):
        if not os.path.exists(prefix + geno):
            continue
        where = variant_file(prefix) if fmt == PFILE else prefix + variants
        if where is None or not os.path.exists(where):
            raise UsageFailed(f"{prefix}{geno} has no {variants} file beside it")
        if not os.path.exists(prefix + samples):
            raise UsageFailed(f"{prefix}{geno} has no {samples} file beside it")
        return Files(prefix, fmt, prefix + geno, where, prefix + samples)
    raise UsageFailed(f"no .pgen, .bed or .geno file at {prefix}")


def readable(path: str) -> str:
    if not os.path.exists(path):
        raise IOFailed(f"cannot read {path}")
    return path
