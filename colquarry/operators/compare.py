"""Differences of schemas, statistics and datasets, and regressions against a stored baseline."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, status, left_type, right_type) by name, from rows (column_name, physical_type)."""
    side = lambda df, c: df.select(F.col("column_name").alias("name"), F.col("physical_type").alias(c)).distinct()
    l, r = F.col("left_type"), F.col("right_type")
    status = F.when(l.isNull(), "Added").when(r.isNull(), "Removed").when(l != r, "TypeChanged").otherwise("Matching")
    both = side(left, "left_type").join(side(right, "right_type"), "name", "full_outer")
    return both.select("name", status.alias("status"), "left_type", "right_type").orderBy("name")


def stats_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both: changes of null share, number of values and size; a change of the null share counts if over
    a tenth of the left one and over one point."""
    names = ("null_percentage", "total_distinct_count_estimate", "total_data_page_size")
    side = lambda df, p: df.select(F.col("column_name").alias("name"), *(F.col(c).alias(p + c) for c in names))
    d = lambda c: F.col(f"r_{c}") - F.col(f"l_{c}")
    change = d("null_percentage")
    return side(left, "l_").join(side(right, "r_"), "name").select(
        "name", change.alias("null_rate_delta"), (F.abs(change) > F.greatest(F.col("l_null_percentage") * 0.1, F.lit(1.0))).alias("null_rate_significant"),
        d("total_distinct_count_estimate").alias("cardinality_delta"), d("total_data_page_size").alias("size_delta_bytes"),
    )


def dataset_diff(left_files: DataFrame, right_files: DataFrame, left_columns: int, right_columns: int) -> DataFrame:
    """One row: rows, files, bytes and columns of both datasets with their changes, from rows (row_count, file_size)."""
    side = lambda df, p: df.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias(f"{p}_rows"), F.count("*").alias(f"{p}_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias(f"{p}_bytes"))
    both = side(left_files, "left").join(F.broadcast(side(right_files, "right")))  # a row each
    delta = F.col("right_rows") - F.col("left_rows")
    return both.select(
        "left_rows", "right_rows", delta.alias("row_delta"), F.when(F.col("left_rows") > 0, delta / F.col("left_rows") * 100.0).otherwise(0.0).alias("row_delta_pct"), "left_files", "right_files",
        "left_bytes", "right_bytes", (F.col("right_bytes") - F.col("left_bytes")).alias("size_delta_bytes"), F.lit(left_columns).alias("left_columns"), F.lit(right_columns).alias("right_columns"),
    )


def schema_consistency(leaves: DataFrame) -> DataFrame:
    """(path, column_name, kind, expected, found): how each file's leaves differ from those of the first by path:
    added, removed, physical type, logical type, repetition. A schema is a map in a row; the first one is broadcast."""
    first = F.lit(leaves.agg(F.min("path")).first()[0])
    facts = ("physical_type", "logical_type", "repetition")
    schemas = leaves.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("leaf_path", F.struct(*facts)))).alias("own"))
    base = schemas.where(F.col("path") == first).select(F.col("own").alias("base"))
    both = schemas.where(F.col("path") != first).crossJoin(F.broadcast(base))  # one row, as wide as a schema
    names = F.array_union(F.map_keys("base"), F.map_keys("own"))
    each = both.select("path", F.explode(names).alias("column_name"), "base", "own").select("path", "column_name", F.element_at("base", F.col("column_name")).alias("b"), F.element_at("own", F.col("column_name")).alias("o"))
    kind = lambda test, name, expected, found: F.when(test, F.struct(F.lit(name).alias("kind"), expected.alias("expected"), found.alias("found")))
    b, o, nothing = F.col("b"), F.col("o"), F.lit(None).cast("string")
    kinds = [kind(b.isNull(), "column_added", nothing, o["physical_type"]), kind(o.isNull(), "column_removed", b["physical_type"], nothing)]
    kinds += [kind(b.isNotNull() & o.isNotNull() & ~b[c].eqNullSafe(o[c]), f"{c}_changed", b[c], o[c]) for c in facts]
    return each.select("path", "column_name", F.inline(F.filter(F.array(*kinds), lambda k: k.isNotNull())))


def schema_messages(leaves: DataFrame) -> DataFrame:
    """(path, message) for each missing or extra column and each other physical type, against the first file."""
    name, kind = F.col("column_name"), F.col("kind")
    text = (
        F.when(kind == "column_removed", F.format_string("missing column '%s'", name)).when(kind == "column_added", F.format_string("extra column '%s'", name))
        .when(kind == "physical_type_changed", F.format_string("column '%s' type %s vs %s", name, "expected", "found"))
    )
    return schema_consistency(leaves).select("path", F.concat("path", F.lit(": "), text).alias("message")).where("message is not null")


def regressions(base_schema: DataFrame, schema: DataFrame, base_scores: DataFrame, scores: DataFrame, base_stats: DataFrame, stats: DataFrame) -> DataFrame:
    """(column, kind, detail): columns added, removed or of another type, scores down by over 5, null shares up by
    over 5 points."""
    diff = schema_diff(base_schema, schema)
    l, r, name = F.col("left_type"), F.col("right_type"), F.col("name")
    kind = F.when(F.col("status") == "Added", "schema_added").when(F.col("status") == "Removed", "schema_removed").when(F.col("status") == "TypeChanged", "type_changed")
    text = (
        F.when(kind == "schema_added", F.format_string("new column %s (%s)", name, r)).when(kind == "schema_removed", F.format_string("column %s removed", name))
        .otherwise(F.format_string("type %s → %s", l, r))
    )
    out = diff.where("status != 'Matching'").select(name.alias("column"), kind.alias("kind"), text.alias("detail"))
    pair = lambda b, n, c: b.select("column_name", F.col(c).alias("b")).join(n.select("column_name", F.col(c).alias("n")), "column_name")
    b, n = F.col("b"), F.col("n")
    drop = pair(base_scores, scores, "score").where(b > n + 5).select(F.col("column_name"), F.lit("quality_drop"), F.format_string("score %d → %d (Δ%d)", b, n, n - b))
    more = pair(base_stats, stats, "null_percentage").where(n - b > 5).select(F.col("column_name"), F.lit("null_increase"), F.format_string("null rate %.1f%% → %.1f%% (+%.1f%%)", b, n, n - b))
    return out.union(drop).union(more)


def _baseline_path(spark: SparkSession, store: str, path: str) -> str:
    key = spark.range(1).select(F.hex(F.xxhash64(F.lit(path)))).first()[0]
    return f"{store.rstrip('/')}/{key}"


def save_baseline(store: str, path: str, schema: DataFrame, scores: DataFrame, stats: DataFrame) -> str:
    """Keep a dataset's schema, scores and statistics under a hash of its path; replaces what was kept."""
    where = _baseline_path(schema.sparkSession, store, path)
    at = F.lit(int(time.time())).alias("captured_at")
    for name, df in (("schema", schema), ("scores", scores), ("stats", stats)):
        df.select("*", F.lit(path).alias("dataset"), at).write.mode("overwrite").parquet(f"{where}/{name}")
    return where


def load_baseline(spark: SparkSession, store: str, path: str) -> dict[str, DataFrame] | None:
    where = _baseline_path(spark, store, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/stats")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return {name: spark.read.parquet(f"{where}/{name}") for name in ("schema", "scores", "stats")}
