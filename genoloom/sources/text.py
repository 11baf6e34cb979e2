"""Scans of variant and sample texts, of any size, with the row numbers of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alleles import centimorgans, chromosome, is_snp
from ..model import InvariantBroken, IOFailed, UsageFailed


def uri(path: str) -> str:
    """Paths without a scheme are files of this machine."""
    import os

    return path if "://" in path else "file://" + os.path.abspath(path)


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """row_idx, value of the lines that ``keep`` holds for, numbered from 0 in file order.

    Splits may be dealt out in any order, so lines are counted by the split they
    are in, splits are added up by their place in the file, and a line's number is
    its split's start plus its place there.  Only the counts are shuffled.
    """
    lines = spark.read.text(uri(path)).select("value", F.col("_metadata.file_block_start").alias("block"))
    if keep is not None:
        lines = lines.where(keep)
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = lines.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, "block").select((F.col("start") + F.col("at") - F.col("first")).cast("long").alias("row_idx"), "value")


def _header(spark: SparkSession, path: str, start: str) -> list[str]:
    """The cells of the first line that starts so."""
    found = spark.read.text(uri(path)).where(F.col("value").startswith(start)).limit(1).collect()
    if not found:
        raise IOFailed(f"{path} has no line that starts with {start}")
    return found[0].value.rstrip("\r").split("\t")


def _checked_chromosomes(rows: DataFrame, raw: str, path: str) -> DataFrame:
    """Raises for the first label that is no chromosome; a pass of its own over two columns."""
    bad = rows.where(F.col("chrom").isNull()).orderBy("row_idx").select(raw).head(1)
    if bad:
        raise InvariantBroken(f"{path}: {bad[0][0]!r} is no chromosome")
    return rows


def snp_table(cells: DataFrame, path: str) -> DataFrame:
    """Biallelic SNPs of raw text columns row_idx, chrom_raw, pos, id, ref, alt, cm, numbered as in the file.

    Lower-case alleles are no SNPs.  Labels of other variants may be anything.
    """
    snps = cells.where(is_snp(F.col("ref"), F.col("alt"))).withColumn("chrom", chromosome(F.col("chrom_raw")))
    snps = _checked_chromosomes(snps, "chrom_raw", path)
    return snps.select("row_idx", "chrom", F.col("pos").try_cast("long").alias("pos"), "id", "ref", "alt", centimorgans(F.col("cm")).alias("cm"))


def variant_cells(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a .pvar or .pvar.zst file as text columns."""
    header = [c.lstrip("#") for c in _header(spark, path, "#CHROM")]
    for name in ("CHROM", "POS", "ID", "REF", "ALT"):
        if name not in header:
            raise IOFailed(f"{path} has no column {name}")
    lines = numbered_lines(spark, path, ~F.col("value").startswith("#") & (F.col("value") != ""))
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    cell = lambda name: F.get(parts, header.index(name)) if name in header else F.lit(None).cast("string")
    return lines.select("row_idx", cell("CHROM").alias("chrom_raw"), cell("POS").alias("pos"), cell("ID").alias("id"), cell("REF").alias("ref"), cell("ALT").alias("alt"), cell("CM").alias("cm"))


def bim_cells(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a .bim file: chromosome, id, cM, position, A1 (counted, ALT), A2 (REF)."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("chrom_raw", "id", "cm", "pos", "alt", "ref")
    return numbered_lines(spark, path, F.trim("value") != "").select("row_idx", *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def snp_cells(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an EIGENSTRAT .snp file: id, chromosome, cM, position, ref, alt."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("id", "chrom_raw", "cm", "pos", "ref", "alt")
    return numbered_lines(spark, path, F.trim("value") != "").select("row_idx", *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_ord and all columns of a .psam file, as text.

    Cells are between tabs if the header has one, otherwise between any white space.
    """
    found = spark.read.text(uri(path)).where(F.col("value").startswith("#") & ~F.col("value").startswith("##")).limit(1).collect()
    if not found:
        raise IOFailed(f"{path} has no header line that starts with #")
    head = found[0].value.rstrip("\r")[1:]
    by = "\t" if "\t" in head else r"\s+"
    header = head.split("\t") if by == "\t" else head.split()
    if header.count("POP") > 1:
        raise InvariantBroken(f"{path} has more than one POP column")
    if "IID" not in header:
        raise IOFailed(f"{path} has no column IID")
    lines = numbered_lines(spark, path, ~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.regexp_replace("value", "\r$", "") if by == "\t" else F.trim("value"), by)
    return lines.select(F.col("row_idx").alias("sample_ord"), *[F.get(parts, i).alias(c) for i, c in enumerate(header)])


def sex_code(raw: Column) -> Column:
    return F.when(F.upper(raw) == "M", "1").when(F.upper(raw) == "F", "2").otherwise("0")


def fam_samples(spark: SparkSession, path: str) -> DataFrame:
    """A .fam file: FID, IID, SEX and the phenotype as PHENO1."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, path, F.trim("value") != "")
    return lines.select(F.col("row_idx").alias("sample_ord"), F.get(parts, 0).alias("FID"), F.get(parts, 1).alias("IID"), F.get(parts, 4).alias("SEX"), F.get(parts, 5).alias("PHENO1"))


def ind_samples(spark: SparkSession, path: str) -> DataFrame:
    """An EIGENSTRAT .ind file: IID, sex, population."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, path, F.trim("value") != "")
    return lines.select(F.col("row_idx").alias("sample_ord"), F.get(parts, 0).alias("IID"), sex_code(F.get(parts, 1)).alias("SEX"), F.get(parts, 2).alias("POP"))


def relabel_pairs(spark: SparkSession, path: str, input_col: str | None = None, output_col: str | None = None) -> DataFrame:
    """line_no, input, output: two columns without a header, or two named ones."""
    if (input_col is None) != (output_col is None):
        raise UsageFailed("name both relabel columns or none")
    lines = numbered_lines(spark, path, F.col("value") != "")
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    if input_col is None:
        wide = lines.where(F.size(parts) != 2).head(1)
        if wide:
            raise UsageFailed(f"{path}: expected two columns in {wide[0].value!r}; name the columns of a wider file")
        return lines.select(F.col("row_idx").alias("line_no"), F.get(parts, 0).alias("input"), F.get(parts, 1).alias("output"))
    first = lines.where("row_idx = 0").head(1)
    header = first[0].value.rstrip("\r").split("\t") if first else []
    for name in (input_col, output_col):
        if name not in header:
            raise UsageFailed(f"{path} has no column {name!r}; it has {header}")
    return lines.where("row_idx > 0").select(F.col("row_idx").alias("line_no"), F.get(parts, header.index(input_col)).alias("input"), F.get(parts, header.index(output_col)).alias("output"))
