"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .infilling import oracle_sql as infilling_sql
from .jaccard import oracle_sql as jaccard_sql
from .license import oracle_sql as license_sql
from .quality import oracle_sql as quality_sql
from .ranking import oracle_sql as ranking_sql
from .shared import documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the evidence of their markup and address, and documents, whose source is their host. The text
    likelihoods are fitted on documents, so their lang is a label and no evidence of theirs."""
    from .language import fit, identify, page_evidence, page_text

    docs = documents(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    nothing = F.lit(None)
    evidence = page_evidence(F.col("url"), F.col("html"))
    rows = docs.select(
        "doc_id", nothing.cast("long").alias("page_id"), "text", F.col("source").alias("host"), nothing.cast("string").alias("suffix"), nothing.cast("string").alias("declared")
    ).union(pages.select(nothing.cast("long"), "page_id", page_text(F.col("html")), evidence["host"], evidence["suffix"], evidence["declared"]))
    return identify(rows, fit(docs), ["doc_id", "page_id"], F.col("host"), F.col("suffix"), F.col("declared"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle_words=4, num=85, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import token_counts

    return token_counts(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded

    return encoded(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replaced, session_key

    return replaced(documents(spark, sf_dir), session_key(spark)).select("doc_id", "text", "n_entities")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import scored

    return scored(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(documents(spark, sf_dir))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infilling import digested, transformed

    return digested(transformed(documents(spark, sf_dir)))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import ranked

    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytenet import classified

    return classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_lm_scores": op9_lm_scores,
    "op10_license_scan": op10_license_scan,
    "op11_infilling": op11_infilling,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality_net": op13_quality_net,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": jaccard_sql(4, 85, 100),
    "op6_quality": quality_sql(),
    "op10_license_scan": license_sql(),
    "op11_infilling": infilling_sql(),
    "op12_ranked_search": ranking_sql(),
}
