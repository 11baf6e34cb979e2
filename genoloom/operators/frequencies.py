"""Allele frequencies by population.

A dosage row is one array; each population is a fixed set of places in it.  So a
batch of rows is a matrix that yields the sums of all populations at once, without
a shuffle, and the plan does not grow with the samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..model import AUTOSOMES, InvariantBroken, Panel


@dataclass(frozen=True)
class PopulationPlaces:
    """Populations in output order with the places of their samples, and which places are pseudohaploid."""

    names: list[str]
    places: dict[str, list[int]]
    haploid: list[bool]


def population_places(samples: DataFrame, populations: Sequence[str] | None = None, haploid: DataFrame | None = None) -> PopulationPlaces:
    """From POP, and from haploid (iid, flag) if given.  One row a sample.

    Without a choice all populations, by code point; chosen ones in the given order.
    """
    rows = samples.select("sample_ord", "IID", "POP").orderBy("sample_ord").collect()
    flags = {r.iid: bool(r.flag) for r in haploid.collect()} if haploid is not None else {}
    every: dict[str, list[int]] = {}
    for r in rows:
        every.setdefault(r.POP, []).append(int(r.sample_ord))
    names = sorted(every) if populations is None else list(populations)
    if unknown := [n for n in names if n not in every]:
        raise InvariantBroken(f"unknown populations: {', '.join(unknown[:5])}")
    if not names:
        raise InvariantBroken("no sample matches the populations")
    return PopulationPlaces(names, {n: every[n] for n in names}, [flags.get(r.IID, False) for r in rows])


def haploid_flags(panel: Panel) -> DataFrame:
    """iid, flag: from the panel's overrides, else from a PSEUDOHAPLOID column equal to ``1``.

    Overrides that name no sample are an error.
    """
    spark = panel.samples.sparkSession
    own = F.col("PSEUDOHAPLOID") == "1" if "PSEUDOHAPLOID" in panel.samples.columns else F.lit(False)
    base = panel.samples.select(F.col("IID").alias("iid"), F.coalesce(own, F.lit(False)).alias("own"))
    if not panel.overrides:
        return base.select("iid", F.col("own").alias("flag"))
    given = spark.createDataFrame(list(panel.overrides.items()), "iid string, given int")
    orphans = given.join(base, "iid", "left_anti").orderBy("iid").head(5)
    if orphans:
        raise InvariantBroken(f"the sidecar names samples that are not there: {', '.join(r.iid for r in orphans)}")
    return base.join(given, "iid", "left").select("iid", F.coalesce(F.col("given") == 1, "own").alias("flag"))


def frequencies(variants: DataFrame, dosages: DataFrame | cells.Packed, populations: PopulationPlaces, adjust: bool = True, chromosomes: Sequence[int] = AUTOSOMES) -> DataFrame:
    """row_idx, chrom, pos, id, ref, alt, cm, pop, alt_count, called, freq; freq is null where nothing is called.

    A diploid call counts the allele's dosage in 2, a pseudohaploid one half of it in 1.
    """
    chosen = variants.where(F.col("chrom").isin(*chromosomes))
    columns, groups = ["row_idx", "chrom", "pos", "id", "ref", "alt", "cm"], [populations.places[n] for n in populations.names]
    ploidy = [1 if adjust and h else 2 for h in populations.haploid]
    if isinstance(dosages, cells.Packed):
        sums = cells.packed_group_sums(chosen.select(*columns).join(dosages.rows, "row_idx"), dosages, groups, ploidy)
    else:
        sums = cells.group_sums(chosen.join(dosages, "row_idx").select(*columns, "g"), "g", groups, ploidy)
    names = F.array(*[F.lit(n) for n in populations.names])
    rows = sums.select("row_idx", "chrom", "pos", "id", "ref", "alt", "cm", F.explode(F.arrays_zip(names.alias("pop"), "alt_count", "called")).alias("e"))
    alt, called = F.col("e.alt_count"), F.col("e.called")
    return rows.select("row_idx", "chrom", "pos", "id", "ref", "alt", "cm", F.col("e.pop").alias("pop"), alt.alias("alt_count"), called.alias("called"), F.try_divide(alt, called.cast("double")).alias("freq"))


def fully_called(freqs: DataFrame) -> DataFrame:
    """row_idx, chrom, pos, poly: variants with a call in every population, and whether any frequency is strictly between 0 and 1."""
    each = freqs.groupBy("row_idx", "chrom", "pos").agg(F.min("called").alias("least"), F.max(F.coalesce((F.col("freq") > 0) & (F.col("freq") < 1), F.lit(False))).alias("poly"))
    return each.where("least > 0").drop("least")


def pivoted(freqs: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """A row for each variant and a column for each population, in the given order."""
    return freqs.groupBy("row_idx", "chrom", "pos", "id", "ref", "alt", "cm").pivot("pop", list(names)).agg(F.first(value))


def samples_per_population(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.col("POP").alias("pop")).agg(F.count("*").alias("n"))
