"""Reads the files that the afs command writes."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import InvariantBroken
from .detect import readable


@dataclass(frozen=True)
class Afs:
    """snp: variant_id, chrom, pos, ref, alt, cm.  freq, counts: variant_id and a column for each population."""

    snp: DataFrame
    freq: DataFrame
    counts: DataFrame
    manifest: dict[str, Any]

    def long(self) -> DataFrame:
        """variant_id, pop, freq, called: a row for each variant and population; freq is null where nothing is called."""
        names = self.manifest["populations"]
        freq = self.freq.select("variant_id", *[F.col(f"`{n}`").alias(f"freq_{i}") for i, n in enumerate(names)])
        both = freq.join(self.counts, "variant_id")
        each = F.array(*[F.struct(F.lit(n).alias("pop"), F.nanvl(f"freq_{i}", F.lit(None)).alias("freq"), F.col(f"`{n}`").alias("called")) for i, n in enumerate(names)])
        return both.select("variant_id", F.explode(each).alias("e")).select("variant_id", "e.*")


def load_afs(spark: SparkSession, folder: str) -> Afs:
    """The tables of a folder and its manifest, which must name the same populations as the tables."""
    with open(readable(f"{folder}/afs_manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    populations = manifest["populations"]

    def table(kind: str, schema: list[tuple[str, str]]) -> DataFrame:
        path = readable(f"{folder}/{manifest['files'][kind]}")
        with open(path, encoding="utf-8") as f:
            header = f.readline().rstrip("\n").split("\t")
        if header != [n for n, _ in schema]:
            raise InvariantBroken(f"{path} has the columns {', '.join(header)}")
        return spark.read.csv(path, sep="\t", header=True, nanValue="nan", quote="", schema=", ".join(f"`{n}` {t}" for n, t in schema))

    return Afs(
        table("snp", [("variant_id", "string"), ("chrom", "int"), ("pos", "long"), ("ref", "string"), ("alt", "string"), ("cm", "double")]),
        table("freq", [("variant_id", "string"), *[(p, "double") for p in populations]]),
        table("counts", [("variant_id", "string"), *[(p, "long") for p in populations]]),
        manifest,
    )
