"""Exports: one JSON document, CSV of columns and row groups, NDJSON, filtered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _one(df: DataFrame, name: str, list_: bool) -> DataFrame:
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.agg((F.collect_list(row) if list_ else F.first(row)).alias(name))


def json_document(dataset: DataFrame, required: dict[str, DataFrame], optional: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row with the column ``json``: the dataset's row and a list per table; optional tables only if they have
    rows. The tables hold a row per column, row group or finding, which one document must hold anyway."""
    out = _one(dataset, "dataset", False)
    for name, df in {**required, **{k: v for k, v in (optional or {}).items() if not v.isEmpty()}}.items():
        out = out.crossJoin(_one(df, name, True))  # a row each, of any size
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("json"))


def csv_columns(stats: DataFrame, scores: DataFrame) -> DataFrame:
    """The nine fields of the column export, as text; a missing score is 100, a missing number of values "-"."""
    four = lambda c: F.format_string("%.4f", c)
    return stats.join(scores.select("column_name", "score", "breakdown"), "column_name", "left").select(
        "column_name", F.lit("-").alias("type"), four(F.col("null_percentage") / 100.0).alias("null_rate"), F.coalesce(F.col("total_distinct_count_estimate").cast("string"), F.lit("-")).alias("cardinality"),
        F.col("total_data_page_size").alias("data_size_bytes"), F.col("total_compressed_size").alias("compressed_size_bytes"), four(F.col("compression_ratio")).alias("compression_ratio"),
        F.coalesce("score", F.lit(100)).alias("quality_score"), F.coalesce("breakdown", F.lit("")).alias("breakdown"),
    ).orderBy("column_name")


def csv_row_groups(row_groups: DataFrame) -> DataFrame:
    return row_groups.select("index", F.col("num_rows").alias("row_count"), "total_byte_size", "compressed_size", F.format_string("%.4f", "compression_ratio").alias("compression_ratio")).orderBy("index")


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_rows(df: DataFrame, condition: Column, path: str, limit: int | None = None) -> int:
    """Matching rows as CSV with a header; nothing is written where none match. Returns the number of rows."""
    rows = df.where(condition)
    rows = rows if limit is None else rows.limit(limit)
    if rows.isEmpty():
        return 0
    out = rows.select(*(F.col(f"`{f.name}`") if f.dataType.typeName() not in ("array", "map", "struct") else F.to_json(f"`{f.name}`").alias(f.name) for f in rows.schema))
    written = Observation()
    out.observe(written, F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return written.get["n"]
