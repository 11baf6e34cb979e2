"""Summaries of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells

# Lower edges of the missingness bins; the last bin holds 1.
EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
# Names of the bins.
LABELS = ("0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%", "70-80%", "80-90%", "90-100%")


def populations(samples: DataFrame) -> DataFrame:
    """pop, n, rank: by descending number, ties by first appearance."""
    counted = samples.groupBy(F.col("POP").alias("pop")).agg(F.count("*").alias("n"), F.min("sample_ord").alias("first"))
    ordered = counted.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "pop", "n"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("rank", "x")).select(F.col("x.pop").alias("pop"), F.col("x.n").alias("n"), "rank")


def sexes(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.col("SEX").alias("sex")).agg(F.count("*").alias("n"))


def chromosomes(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.count("*").alias("n"))


def counts(raw: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """n_samples, n_variants_pre_filter, n_variants_post_filter in one row."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = (
        samples.select(one.alias("a"), zero.alias("b"), zero.alias("c"))
        .unionByName(raw.select(zero.alias("a"), one.alias("b"), zero.alias("c")))
        .unionByName(variants.select(zero.alias("a"), zero.alias("b"), one.alias("c")))
    )
    return parts.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in (("a", "n_samples"), ("b", "n_variants_pre_filter"), ("c", "n_variants_post_filter"))])


def missingness(dosages: DataFrame | cells.Packed) -> DataFrame:
    """out_ord, missing, n over all rows, of whatever chromosome."""
    if isinstance(dosages, cells.Packed):
        return cells.packed_sums(dosages.rows, dosages).select(F.col("place").alias("out_ord"), (F.col("n") - F.col("called")).alias("missing"), "n")
    return cells.place_sums(dosages).select("out_ord", (F.col("n") - F.col("called")).alias("missing"), "n")


def missingness_histogram(per_sample: DataFrame) -> DataFrame:
    """bin, label, n: samples by share of missing calls in ten bins, empty ones too."""
    rate = F.col("missing").cast("double") / F.col("n").cast("double")
    which = F.lit(0)
    for i, edge in enumerate(EDGES[1:], 1):
        which = F.when(rate >= F.lit(edge), F.lit(i)).otherwise(which)
    found = per_sample.select(which.alias("bin")).groupBy("bin").agg(F.count("*").alias("k"))
    bins = per_sample.sparkSession.createDataFrame(list(enumerate(LABELS)), "bin int, label string")
    return bins.join(found, "bin", "left").select("bin", "label", F.coalesce("k", F.lit(0)).cast("long").alias("n"))
