"""What footers tell: column, row-group, encoding, compression, partition, order and time statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.paths import scratch_folder
from .profile import approx_distinct, numeric_columns


def column_stats(chunks: DataFrame, total_rows: Column | int) -> DataFrame:
    """A row per leaf: nulls and their share of ``total_rows``, distinct values (only if every chunk has them), sizes,
    their ratio, and the least and greatest value, compared as numbers and times where they are such."""
    rows = total_rows if isinstance(total_rows, Column) else F.lit(total_rows)
    distinct = F.when(F.count("distinct_count") == F.count("*"), F.sum("distinct_count"))
    kinds = [c for c in ("exact", "number", "micros") if f"min_{c}" in chunks.columns]
    order = lambda end: F.struct(*(F.col(f"{end}_{c}") for c in kinds), F.col(end))
    known = lambda end: F.when(F.col(end).isNotNull(), order(end))
    out = chunks.groupBy("column_name").agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("total_null_count"), distinct.alias("total_distinct_count_estimate"), F.sum("uncompressed_size").alias("total_data_page_size"),
        F.sum("compressed_size").alias("total_compressed_size"), F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number"),
        F.min(known("min"))["min"].alias("min"), F.max(known("max"))["max"].alias("max"),
    )
    return out.withColumns({
        "null_percentage": S.percentage(F.col("total_null_count"), rows),
        "compression_ratio": S.ratio(F.col("total_data_page_size"), F.col("total_compressed_size"), 1.0),
    })


def is_outlier(size: Column, mean: Column, spread: Column) -> Column:
    return F.coalesce((spread > 0) & (F.abs(size - mean) > 2 * spread), F.lit(False))


def uniformity(row_groups: DataFrame) -> DataFrame:
    """One row: the spread of rows and bytes, and the row groups beyond two deviations of the mean bytes."""
    agg = []
    for name, c in (("rows", "num_rows"), ("bytes", "total_byte_size")):
        x = F.col(c)
        agg += [F.avg(x).alias(f"{name}_mean"), F.median(x).alias(f"{name}_median"), F.stddev_pop(x).alias(f"{name}_stddev"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
    whole = row_groups.agg(F.count("*").alias("row_group_count"), *agg)
    far = row_groups.join(F.broadcast(whole.select("bytes_mean", "bytes_stddev"))).where(is_outlier(F.col("total_byte_size"), F.col("bytes_mean"), F.col("bytes_stddev")))  # one row
    return whole.join(F.broadcast(far.agg(F.array_sort(F.collect_list("index")).alias("outliers"))))


def encodings(chunks: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("encodings"))))
    out = chunks.groupBy("column_name").agg(names.alias("encodings"))
    return out.withColumn("is_plain_only", F.col("encodings") == F.array(F.lit("PLAIN")))


def compression(chunks: DataFrame) -> DataFrame:
    out = chunks.groupBy("column_name").agg(
        F.min_by("codec", F.struct("path", "row_group")).alias("codec"), F.sum("uncompressed_size").alias("uncompressed_size"), F.sum("compressed_size").alias("compressed_size")
    )
    return out.withColumns({"compression_ratio": S.ratio(F.col("uncompressed_size"), F.col("compressed_size"), 1.0), "is_uncompressed": F.col("codec") == "UNCOMPRESSED"})


def page_index(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.coalesce(F.bool_or("has_column_index"), F.lit(False)).alias("has_column_index"), F.coalesce(F.bool_or("has_offset_index"), F.lit(False)).alias("has_offset_index"),
        S.percentage(F.count_if("has_column_index"), F.count("*")).alias("coverage_pct"),
    )


def bloom_filters(found: DataFrame) -> DataFrame:
    return found.groupBy("leaf_path").agg(F.bool_or("has_bloom_filter").alias("has_bloom_filter"))


def nested(leaves: DataFrame) -> DataFrame:
    """Leaves below the root: depth, levels, what holds them, and whether that is a map, else a list, else structs."""
    depth = F.size(F.split("leaf_path", r"\.")) - 1
    has = lambda kind: F.array_contains("holders", kind)
    return leaves.where(depth > 0).select(
        "path", "leaf_path", "column_name", depth.alias("nesting_depth"), "physical_type", "repetition", "max_def_level", "max_rep_level", "holders",
        (~has("map") & has("list")).alias("is_list"), has("map").alias("is_map"), (~has("map") & ~has("list")).alias("is_struct"),
    )


def partitions(files: DataFrame) -> DataFrame:
    """From rows (key, value, rows, bytes): per key its values, their rows and bytes, and the skewed ones, with over
    three times the upper median of rows (1 at least)."""
    by = files.groupBy("key", "value").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    per = Window.partitionBy("key")
    place = F.row_number().over(per.orderBy("rows", "value"))
    at = by.withColumns({"place": place, "n": F.count("*").over(per)})
    median = F.greatest(F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("rows"))).over(per), F.lit(1))
    flagged = at.withColumn("skewed", F.col("rows") > 3 * median)
    pair = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", c))))
    return flagged.groupBy("key").agg(
        F.array_sort(F.collect_list("value")).alias("distinct_values"), pair("rows").alias("partition_row_counts"), pair("bytes").alias("partition_byte_sizes"),
        F.array_sort(F.collect_list(F.when(F.col("skewed"), F.col("value")))).alias("skewed_partitions"),
    )


def time_series(groups: DataFrame) -> DataFrame:
    """From rows (column_name, index, min_ms, max_ms) of row groups: range, gaps between neighbours, whether they
    never overlap, and a hint where the largest gap is over ten times the mean."""
    order = Window.partitionBy("column_name").orderBy("index")
    gap = F.col("min_ms") - F.lag("max_ms").over(order)
    known = groups.where("min_ms is not null and max_ms is not null").withColumn("gap", gap)
    out = known.groupBy("column_name").agg(
        F.min("min_ms").alias("min_timestamp"), F.max("max_ms").alias("max_timestamp"), F.avg("gap").alias("mean_gap_ms"), F.max("gap").alias("max_gap_ms"),
        F.coalesce(F.bool_and(F.col("gap") >= 0), F.lit(True)).alias("is_monotonic"),
    )
    jump = (F.col("mean_gap_ms") > 0) & (F.col("max_gap_ms") > 10 * F.col("mean_gap_ms"))
    hint = F.when(jump, F.format_string("gap detected: max_gap %dms >> mean_gap %.0fms", "max_gap_ms", "mean_gap_ms"))
    out = out.withColumns({"total_duration_ms": F.col("max_timestamp") - F.col("min_timestamp"), "missing_interval_hint": hint, "has_data": F.lit(True)})
    every = groups.select("column_name").distinct()
    return every.join(out, "column_name", "left").withColumns({"has_data": F.coalesce("has_data", F.lit(False)), "is_monotonic": F.coalesce("is_monotonic", F.lit(True))})


def sort_order(groups: DataFrame, strict: bool = True) -> DataFrame:
    """From rows (column_name, index, low, high) of anything that can be ordered: whether each group begins at or after the
    end of the one before (ascending), or ends at or before its beginning (descending), and the share of ascending
    neighbours (1 without any). Not ``strict``, it is enough for descending that each group begins at or before the end of
    the one before, which groups that all overlap do as well."""
    order = Window.partitionBy("column_name").orderBy("index")
    pairs = groups.where("low is not null and high is not null").select("column_name", "low", "high", F.lag("low").over(order).alias("low_before"), F.lag("high").over(order).alias("before"))
    up, has = F.col("low") >= F.col("before"), F.col("before").isNotNull()
    down = F.col("high") <= F.col("low_before") if strict else F.col("low") <= F.col("before")
    out = pairs.groupBy("column_name").agg(
        F.coalesce(F.bool_and(F.when(has, up)), F.lit(True)).alias("ascending"), F.coalesce(F.bool_and(F.when(has, down)), F.lit(False)).alias("descending"),
        F.count_if(has & up).alias("_up"), F.count_if(has).alias("_pairs"),
    )
    order = F.when(F.col("ascending"), "ascending").when(F.col("descending"), "descending").otherwise("unsorted")
    return out.select("column_name", order.alias("sort_order"), S.ratio(F.col("_up"), F.col("_pairs"), 1.0).alias("confidence"))


_PAIR = {"a": pa.int32(), "b": pa.int32(), **dict.fromkeys(("n", "sa", "sb", "saa", "sbb", "sab", "endless"), pa.float64())}


def _gram(shifts: list[float]):
    """Rows of a task's sums for each pair of columns, over the rows where both are known."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        k = len(shifts)
        n, s, q, p, endless = (np.zeros((k, k)) for _ in range(5))
        for batch in batches:
            x = np.column_stack([c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns])
            known, infinite = (~np.isnan(x)).astype(float), np.isinf(x).astype(float)
            x = np.where((known == 1) & (infinite == 0), x - np.array(shifts), 0.0)
            n += known.T @ known
            s += x.T @ known
            q += (x * x).T @ known
            p += x.T @ x
            if infinite.any():
                endless += infinite.T @ known + known.T @ infinite
        a, b = np.triu_indices(k, 1)
        columns = [a.astype(np.int32), b.astype(np.int32), n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], p[a, b], endless[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _PAIR.values())], names=list(_PAIR))

    return run


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, pearson) of every pair of the numeric columns (or those given), over the rows where both are known
    numbers; 0 where one doesn't vary or isn't finite.

    One scan at any number of columns: tasks multiply the matrix of a batch with itself and with the mask of known values, about
    a common middle (the median of the first rows) so that nothing large cancels, and pairs are added up over tasks."""
    columns = numeric_columns(df) if columns is None else columns
    names = F.array(*(F.lit(c).cast("string") for c in columns)).cast("array<string>")
    name = lambda k: F.get(names, F.col(k))
    same = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("a"), F.col("id").cast("int").alias("b"), F.lit(1.0).alias("pearson"))
    if len(columns) < 2:
        return same.select(name("a").alias("a"), name("b").alias("b"), "pearson")
    x = df.select(*(F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_{k}") for k, c in enumerate(columns)))
    middles = [r["m"] for r in x.limit(1000).select(F.posexplode(F.array(*x.columns)).alias("k", "x")).groupBy("k").agg(F.percentile_approx(F.when(F.abs("x") < float("inf"), F.col("x")), 0.5).alias("m")).orderBy("k").collect()]
    shifts = [m or 0.0 for m in middles] if middles else [0.0] * len(columns)
    sums = x.mapInArrow(_gram(shifts), "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double, endless double")
    k = len(columns)
    every = df.sparkSession.range(k * k).select(F.expr(f"int(id div {k})").alias("a"), F.expr(f"int(id % {k})").alias("b"), *(F.lit(0.0).alias(c) for c in list(_PAIR)[2:])).where("a < b")
    total = sums.unionByName(every).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab", "endless")))
    spread = lambda c: F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n")
    varies = (F.col("n") > 0) & (F.col("endless") == 0) & (spread("a") > 1e-13 * F.col("saa")) & (spread("b") > 1e-13 * F.col("sbb"))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.sqrt(spread("a")) * F.sqrt(spread("b")))
    found = total.select("a", "b", F.when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0).alias("pearson"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "pearson")).unionByName(same)
    return both.select(name("a").alias("a"), name("b").alias("b"), "pearson")


def duplicates(df: DataFrame, exact: bool = True) -> DataFrame:
    """total_rows, duplicate_rows and their share: rows beyond the first of equal ones (nulls are equal).

    Exact: counts of row hashes, combined before the shuffle, name the rows that may be duplicates; only these are compared, so
    what is shuffled is a hash for each row and the rows that share one. The hashes that occur twice are stored, so Spark knows their
    size: few of them are broadcast to the rows, many are joined. Else by a sketch of row hashes, without a shuffle."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not exact:
        out = df.agg(F.count("*").alias("total_rows"), F.greatest(F.count("*") - approx_distinct(*columns), F.lit(0)).alias("duplicate_rows"))
    else:
        spark = df.sparkSession
        names = [f"_{k}" for k in range(len(columns))]
        rows = df.select(*(c.alias(n) for c, n in zip(columns, names)), F.xxhash64(*columns).alias("_h"))
        counts = rows.groupBy("_h").agg(F.count("*").alias("_n"))
        folder = scratch_folder(spark, "hashes")
        counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")).write.parquet(f"{folder}/total")
        counts.where("_n > 1").select("_h").write.parquet(f"{folder}/twice")
        twice = spark.read.parquet(f"{folder}/twice")
        same = rows.join(twice, "_h", "left_semi").groupBy("_h", *names).agg(F.count("*").alias("_n"))
        total = spark.read.parquet(f"{folder}/total")
        out = total.crossJoin(same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")))  # a row each
    out = out.withColumn("duplicate_pct", S.percentage(F.col("duplicate_rows"), F.col("total_rows")))
    return out.withColumns({"severity": S.duplicate_severity(F.col("duplicate_pct")), "is_exact": F.lit(exact)})


def sample_groups(row_groups: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """The row groups that a sample of ``percent`` takes: the first by the hash of the index and the seed, one at
    least. With seed 0 they are the first row groups."""
    if not 0 < percent <= 100:
        raise ValueError("a sample is over 0 and up to 100 percent")
    mixed = (F.col("index").cast("long").bitwiseXOR(F.lit(seed)).cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(20,0)")) % F.lit("18446744073709551616").cast("decimal(38,0)")
    n = row_groups.count()
    take = min(max(-(-int(percent * n * 1_000_000) // 100_000_000), 1), n)
    return row_groups.withColumn("_key", mixed).orderBy("_key", "index").limit(take).drop("_key")


def sample_margin(groups: int) -> float:
    """The 95 % margin in points for so many sampled row groups."""
    return 1.96 * (0.25 / max(1, groups)) ** 0.5 * 100
