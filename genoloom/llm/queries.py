"""The contract queries of the ten operators, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_workers
from .additive import nearest
from .debruijn import remove_repeats
from .jaccard import similar_groups
from .language import language_id
from .mixing import mix
from .oracles import SQL
from .pseudo_likelihood import pseudo_likelihood
from .quality import quality_scores
from .store import new_path
from .suffixes import contamination
from .token_counts import token_counts
from .token_files import read_token_files, token_digest, write_token_files


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id(table(spark, sf_dir, "documents"))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the spans of 13 words or more that an earlier one has."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return similar_groups(table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document under the network trained on all."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


#: Powers of the found token shares: a source with a third of all tokens is toned down the most.
MIX = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to raked source, language and topic shares."""
    return mix(table(spark, sf_dir, "documents"), MIX)


def op3_token_files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Encodes every document into token files, and reads those back."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    path = new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path())
    return token_digest(read_token_files(spark, path))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and whether there are more than 512."""
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


#: Queries by name.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_decontamination, op2_additive_ann, op3_token_files, op4_language_id, op5_pseudo_likelihood, op6_token_counts, op7_repeated_spans, op8_quality, op9_mixing, op10_ngram_jaccard)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
