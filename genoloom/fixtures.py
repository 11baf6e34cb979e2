"""Genotype panels derived from star-schema tables by integer arithmetic.

Both Spark and SQL engines evaluate these definitions alike, so every operator
can be compared with independent SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cells import MISSING, Packed, Reader, unpacked
from .model import Panel
from .session import ensure_workers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.col("row_idx")


def variants_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part, indels too."""
    k = _k()
    four = F.element_at(F.array(*[F.lit(x) for x in ("AC", "AG", "CT", "GT")]), (F.expr("row_idx div 3") % 4 + 1).cast("int"))
    pair = F.when(k % 50 == 7, "AT").when(k % 50 == 23, "CG").when(k % 50 == 41, "TA").when(F.expr("row_idx div 12") % 2 == 1, F.reverse(four)).otherwise(four)
    indel = k % 40 == 19
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("row_idx")).select(
        "row_idx",
        (k % 24 + 1).cast("int").alias("chrom"),
        (k * 137 + 1000).alias("pos"),
        F.when(k % 97 == 0, ".").otherwise(F.concat(F.lit("rs"), k.cast("string"))).alias("id"),
        F.when(indel, "AT").otherwise(F.substring(pair, 1, 1)).alias("ref"),
        F.when(indel, "A").otherwise(F.substring(pair, 2, 1)).alias("alt"),
        (k.cast("double") / 1000.0).alias("cm"),
    )


def _snps(raw: DataFrame) -> DataFrame:
    return raw.where((F.length("ref") == 1) & (F.length("alt") == 1))


def variants_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snps(variants_raw(spark, sf_dir)).where(_k() % 20 != 3)


def variants_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("row_idx div 7") % 12
    flip = lambda x: F.translate(x, "ACGT", "TGCA")
    ref, alt = F.col("ref"), F.col("alt")
    rows = _snps(variants_raw(spark, sf_dir)).where(_k() % 10 != 9)
    new_ref = F.when(t.isin(6, 7), alt).when(t == 8, flip(ref)).when(t == 9, flip(alt)).otherwise(ref)
    new_alt = F.when(t.isin(6, 7), ref).when(t == 8, flip(alt)).when(t == 9, flip(ref)).when(t == 11, F.translate(alt, "ACGT", "CATG")).otherwise(alt)
    return rows.withColumns({"ref": new_ref, "alt": new_alt})


def variants_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of another build."""
    return variants_a(spark, sf_dir).withColumns({"pos": F.col("pos") + 1_500_000, "id": F.concat(F.lit("bs"), _k().cast("string"))})


def variants_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of another source."""
    return variants_a(spark, sf_dir).withColumn("id", F.concat(F.lit("x"), _k().cast("string")))


def variants_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other places altogether."""
    return variants_a(spark, sf_dir).where(_k() % 24 < 10).withColumns({"pos": F.col("pos") * 3 + 17, "id": F.concat(F.lit("e"), _k().cast("string"))})


def all_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, input_idx, sample_ord, iid, sex, pop, ph of every supplier; sample_ord counts within the input."""
    s = F.col("s")
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("long").alias("s"), F.col("n_regionkey").cast("int").alias("region"))
    place = F.when(s % 4 < 2, F.expr("s div 4") * 2 + s % 4).otherwise(F.expr("s div 4"))
    return rows.select(
        "s",
        F.when(s % 4 < 2, 0).when(s % 4 == 2, 1).otherwise(2).alias("input_idx"),
        place.cast("long").alias("sample_ord"),
        F.concat(F.lit("S"), F.when(s % 8 == 2, s - 2).otherwise(s).cast("string")).alias("iid"),
        (s % 2 + 1).cast("string").alias("sex"),
        F.concat(F.lit("POP"), F.col("region").cast("string")).alias("pop"),
        (s % 3 == 0).alias("ph"),
    )


def samples(spark: SparkSession, sf_dir: str, input_idx: int) -> DataFrame:
    """The sample table of one input: SEX, POP and PSEUDOHAPLOID for all, REGION for input 1 alone."""
    mine = all_samples(spark, sf_dir).where(F.col("input_idx") == input_idx)
    extra = [F.concat(F.lit("R"), F.substring("pop", 4, 9)).alias("REGION")] if input_idx == 1 else []
    return mine.select("sample_ord", F.col("iid").alias("IID"), F.col("sex").alias("SEX"), F.col("pop").alias("POP"), F.when(F.col("ph"), "1").otherwise("0").alias("PSEUDOHAPLOID"), *extra)


def _lines(spark: SparkSession, sf_dir: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(s, ph) of the samples of each input in their order."""
    rows = all_samples(spark, sf_dir).select("input_idx", "sample_ord", "s", "ph").orderBy("input_idx", "sample_ord", "s", "ph").toArrow()
    of, s, ph = (rows[c].to_numpy(zero_copy_only=False) for c in ("input_idx", "s", "ph"))
    return [(s[of == i], ph[of == i].astype(bool)) for i in range(3)]


#: The formula of inputs 0 and 1 repeats itself after so many variants.
PERIOD = 16 * 13


def _formula(k: np.ndarray, s: np.ndarray, ph: np.ndarray) -> np.ndarray:
    """Cells of variants k by samples s; remainders have the sign of what is divided."""
    k, s = k[:, None], s[None, :]
    h = np.fmod(k * 31 + s * 17 + np.fmod(k * s, 13), 16)
    value = np.where(ph[None, :] & (np.fmod(h, 3) == 1), np.fmod(k, 2) * 2, np.fmod(h, 3))
    return np.where(h == 15, MISSING, value).astype(np.int8)


def _formula_reader(s: np.ndarray, ph: np.ndarray, places: np.ndarray) -> Reader:
    there = places >= 0
    own_s, own_ph = s[places[there]], ph[places[there]]
    repeats = not (own_s < 0).any()

    def cells(k: np.ndarray) -> np.ndarray:
        out = np.full((len(k), len(places)), MISSING, np.int8)
        out[:, there] = _formula(k, own_s, own_ph)
        return out

    table = cells(np.arange(PERIOD)) if repeats else None

    def read(columns: list[pa.Array]) -> np.ndarray:
        k = columns[0].fill_null(0).to_numpy(zero_copy_only=False)
        out = table[k % PERIOD] if repeats and not (k < 0).any() else cells(k)
        if columns[0].null_count:
            out[columns[0].is_null().to_numpy(zero_copy_only=False)] = MISSING
        return out

    return read


def _sparse_reader(s: np.ndarray, places: np.ndarray) -> Reader:
    """From the lists of samples and of their dosages."""
    known, column = np.unique(s, return_inverse=True)
    wanted = np.where(places >= 0, column[places] if len(column) else -1, -1)
    as_they_are = np.array_equal(wanted, np.arange(len(known)))

    def read(columns: list[pa.Array]) -> np.ndarray:
        n = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, of = np.repeat(np.arange(len(n)), n), columns[0].flatten().to_numpy(zero_copy_only=False)
        value = columns[1].flatten().fill_null(MISSING).to_numpy(zero_copy_only=False)
        out = np.full((len(n), len(known) + (not as_they_are)), MISSING, np.int8)  # the last column, if there is one more, is missing
        at = np.minimum(np.searchsorted(known, of), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[at] == of) if len(known) else np.zeros(0, np.int64)
        out[row[hit], at[hit]] = value[hit]
        return out if as_they_are else out[:, wanted]

    return read


def packed(spark: SparkSession, sf_dir: str, input_idx: int, lines: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Packed:
    """Dosages in small rows.  Inputs 0 and 1 follow a formula; input 2 the order lines, missing where there are none."""
    s, ph = (lines or _lines(spark, sf_dir))[input_idx]
    raw = variants_raw(spark, sf_dir).select("row_idx")
    if input_idx < 2:
        return Packed(raw.withColumn("k", _k()), ["k"], len(s), lambda places: _formula_reader(s, ph, places))
    mine = all_samples(spark, sf_dir).where(F.col("input_idx") == input_idx).select("s").distinct()
    lines_ = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("row_idx"), F.col("l_suppkey").cast("long").alias("s"), F.col("l_quantity").cast("int").alias("q"))
    each = lines_.join(F.broadcast(mine), "s", "left_semi").groupBy("row_idx", "s").agg((F.max("q") % 3).cast("tinyint").alias("v"))
    found = each.groupBy("row_idx").agg(F.collect_list(F.struct("s", "v")).alias("by")).select("row_idx", F.col("by.s").alias("of"), F.col("by.v").alias("v"))
    return Packed(raw.join(found, "row_idx", "left"), ["of", "v"], len(s), lambda places: _sparse_reader(s, places))


def dosages(spark: SparkSession, sf_dir: str, input_idx: int, form: Packed | None = None) -> DataFrame:
    """row_idx, g: :func:`packed`, unpacked."""
    form = form or packed(spark, sf_dir, input_idx)
    every = list(range(form.width))
    return unpacked(form.rows, [(form, form.payload, every, every, None)], form.width)


def panels(spark: SparkSession, sf_dir: str, with_dosages: bool = True) -> list[Panel]:
    """Inputs 0 (canonical), 1 and 2 (the target, with the canonical variants)."""
    variants = [variants_a(spark, sf_dir), variants_b(spark, sf_dir), variants_a(spark, sf_dir)]
    out = [Panel(v, samples(spark, sf_dir, i), path=f"input{i}", is_target=i == 2) for i, v in enumerate(variants)]
    if not with_dosages:
        return out
    lines = _lines(spark, sf_dir)
    forms = [packed(spark, sf_dir, i, lines) for i in range(3)]
    return [p.with_(dosages=dosages(spark, sf_dir, i, form), packed=form) for i, (p, form) in enumerate(zip(out, forms, strict=True))]
