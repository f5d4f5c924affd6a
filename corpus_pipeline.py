"""The corpus pipeline: language ID, quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes what a stage
returns as Parquet and rereads it for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colquarry.llm.jaccard import near_duplicates
from colquarry.llm.language import fit, identify
from colquarry.llm.packing import pack
from colquarry.llm.pii import replaced, session_key
from colquarry.llm.quality import judge
from colquarry.llm.shared import Tables, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of 128 bits over all columns, nulls told from values: rows alike in all of them are judged alike."""
    parts = (F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in COLUMNS)
    return docs.select(*COLUMNS).withColumn("_key", F.left(F.sha2(F.concat(*parts), 256), F.lit(32)))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select("_key").distinct(), "_key", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't known: without letters, or none with half of the posterior.

    The source is the host. The column lang has the labels that the text model is fitted on, so it is no evidence; there
    is no address suffix. Null and empty texts go, very long ones are judged whole, repeated rows alike; an empty
    table gives an empty result."""
    keyed = _keyed(docs)
    nothing = F.lit(None).cast("string")
    found = identify(keyed, fit(docs), ["_key"], F.col("source"), nothing, nothing)
    return _without(keyed, found.where("not kept"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a certified cutoff of their language. Null and empty texts fail,
    very long ones are judged whole, repeated rows alike; an empty table gives an empty result."""
    keyed = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(keyed, judge(keyed, labels, carry=["_key"]).where("not kept"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group that links at 0.8 on five-word shingles.

    Rows are told apart by all columns, so another row with the same doc_id is judged apart. Rows without a doc_id
    come after those with one, rows with one doc_id in the order of their keys. Of rows alike in all columns a single
    one is kept. Null and empty texts link with nothing, so each such row stays; very long texts are compared whole.
    An empty table gives an empty result."""
    keyed = _keyed(docs)
    # ids in the order to keep: with a doc_id, by it, by the key
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rank = F.concat(F.coalesce(F.concat(F.lit("0"), number), F.lit("1")), "_key")
    found = near_duplicates(keyed.select(rank.alias("doc_id"), "text"), shingle_words=5, num=80, den=100)
    kept = found.where("doc_id = component_id").select(F.right("doc_id", F.lit(32)).alias("_key")).distinct()
    return keyed.dropDuplicates(["_key"]).join(kept, "_key", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the new text. Null and empty texts stay as they are, very
    long ones are searched whole, repeated rows are treated alike; an empty table gives an empty result."""
    return replaced(docs.select(*COLUMNS), session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens: a row for each piece. Null and empty texts are an end each,
    very long ones are cut, repeated rows are packed each; an empty table gives an empty result."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Language likelihoods, surrogates and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    tables, docs = Tables(spark), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = tables.store(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.drop_others(docs)
    return docs
