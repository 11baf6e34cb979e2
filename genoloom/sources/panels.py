"""Panels from file prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AUTOSOMES, InvariantBroken, Panel
from . import genotypes as gt
from . import text
from .detect import BFILE, EIGENSTRAT, PFILE, Files, detect
from .sidecar import read_sidecar


def _fault(files: Files, cells: DataFrame, n_binary: int, n_raw: int) -> str | None:
    """Why genotypes and variants of a binary panel cannot go together."""
    if files.format == PFILE:
        alleles = cells.agg(F.max(F.size(F.split("alt", ","))).alias("n")).first().n or 0
        if alleles > 1:
            return f"{files.variants} has variants with {alleles + 1} alleles; only two are allowed"
    if n_binary != n_raw:
        return f"{files.genotypes} has {n_binary} rows, {files.variants} has {n_raw}"
    return None


def read_panel(spark: SparkSession, prefix: str, chromosomes: tuple[int, ...] = AUTOSOMES, is_target: bool = False, strict: bool = True) -> Panel:
    """Lazy tables of the panel at prefix.

    BFILE and EIGENSTRAT panels are restricted to ``chromosomes``; their numbers
    of rows stay those of the files.  A PFILE panel with more than two alleles in a
    row, or genotypes of another number of rows, is an error; unless ``strict``, it
    is a panel without dosages that names its fault.
    """
    files = detect(prefix)
    if files.format == PFILE:
        cells, samples = text.variant_cells(spark, files.variants), text.samples(spark, files.samples)
    elif files.format == BFILE:
        cells, samples = text.bim_cells(spark, files.variants), text.fam_samples(spark, files.samples)
    else:
        cells, samples = text.snp_cells(spark, files.variants), text.ind_samples(spark, files.samples)
    variants = text.snp_table(cells, files.variants)
    if files.format != PFILE:
        variants = variants.where(F.col("chrom").isin(*chromosomes))
    n_raw, n_samples = cells.count(), samples.count()
    if files.format == EIGENSTRAT and not gt.is_packed_eigenstrat(files.genotypes):
        dosages, fault = gt.read_ascii(spark, files.genotypes, n_raw, n_samples), None
    else:
        where = gt.layout(files.genotypes, n_raw, n_samples)
        fault = _fault(files, cells, where.n_variants, n_raw)
        if fault and strict:
            raise InvariantBroken(fault)
        dosages = None if fault else gt.read_binary(spark, where)
    return Panel(variants, samples, dosages, fault=fault, path=prefix, format=files.format, is_target=is_target, n_raw=n_raw, overrides=read_sidecar(files.prefix))
