"""The commands as functions: filter, summary, check, compare, duplicates, schema, export, inspect."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .functions import scalars as S
from .operators import compare as C
from .operators import profile as P
from .operators import quality as Q
from .operators import stats as A
from .operators.partial import limited_profile, waves
from .plans import predicate as W
from .sources import sinks
from .sources.footer import Footers, read_footers
from .sources.paths import Config, preview, read
from .sources.splits import read_row_groups


class NotFound(FileNotFoundError):
    """No Parquet file is there, or none can be read."""


@dataclass
class FilterResult:
    matched: int
    scanned_row_groups: int
    skipped_row_groups: int
    total_row_groups: int
    sample: DataFrame


def filter_count(spark: SparkSession, path: str, text: str) -> FilterResult:
    """Rows that match, how many row groups their statistics rule out, and up to ten of the rows as text."""
    df = read(spark, path)
    condition = W.compile_filter(text, df)
    rows = df.where(condition)
    groups = skipped_row_groups(read_footers(spark, path), text).first()
    return FilterResult(rows.count(), groups["total"] - groups["skipped"], groups["skipped"], groups["total"], preview(rows, 10))


def row_group_skips(footers: Footers, text: str) -> DataFrame:
    """path, row_group and whether its statistics rule out any match."""
    value = F.struct("min_exact", "max_exact", F.col("min_number").alias("min"), F.col("max_number").alias("max"), "null_count")
    stats = footers.chunks.groupBy("path", "row_group").agg(F.map_from_entries(F.collect_list(F.struct("leaf_path", value))).alias("stats"))
    return stats.select("path", "row_group", W.skip_column(W.parse(text)).alias("skipped"))


def skipped_row_groups(footers: Footers, text: str) -> DataFrame:
    """One row: total and skipped row groups by the footer's statistics."""
    return row_group_skips(footers, text).agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"))


def filter_rows(df: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """The rows that match; with a ``limit`` the first of them in the order of files and rows, where ``df`` comes
    straight from files (each task keeps its first ones only), else any of them."""
    rows = df.where(W.compile_filter(text, df))
    if limit is None:
        return rows
    try:
        placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return rows.limit(limit)
    return placed.orderBy("_file", "_row").limit(limit).drop("_file", "_row")


class Dataset:
    """A dataset's footers and all that follows from them; the tables are made when first asked for.

    The footers are read once and kept by the executors (in memory, else on disk; what is lost is read again) until
    ``close``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.footers = read_footers(spark, path)
        self.footers.raw = self.footers.raw.persist(StorageLevel.MEMORY_AND_DISK)
        totals = self.footers.files.agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.sum("row_count").alias("rows"), F.sum("file_size").alias("bytes")).first()
        if totals["n"] == totals["bad"]:
            self.close()
            raise NotFound(path)
        self.files, self.rows, self.bytes = totals["n"] - totals["bad"], totals["rows"] or 0, totals["bytes"] or 0

    def close(self) -> None:
        self.footers.raw.unpersist()

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def rows_frame(self) -> DataFrame:
        return read(self.spark, self.path)

    @cached_property
    def column_stats(self) -> DataFrame:
        return A.column_stats(self.footers.chunks, self.rows)

    @cached_property
    def encodings(self) -> DataFrame:
        return A.encodings(self.footers.chunks)

    @cached_property
    def scores(self) -> DataFrame:
        return Q.scores(self.column_stats, self.rows, self.encodings)

    @cached_property
    def schema(self) -> DataFrame:
        leaves = self.footers.leaves
        return leaves.where(F.col("path") == F.lit(leaves.agg(F.min("path")).first()[0])).drop("path")

    @cached_property
    def inconsistencies(self) -> DataFrame:
        return C.schema_consistency(self.footers.leaves)

    def quality(self, columns: list[str] | None = None) -> DataFrame:
        pick = lambda df: df if columns is None else df.where(F.col("column_name").isin(columns))
        stats = pick(self.column_stats)
        facts = stats.agg(F.count("*").alias("n"), F.sum("total_null_count").alias("nulls")).first()
        return Q.summary(pick(self.scores), stats, self.rows * facts["n"], facts["nulls"] or 0, self.inconsistencies.isEmpty())

    def column_detail(self, column: str) -> DataFrame:
        """A column's statistics, score, encodings and compression, with its profile."""
        one = lambda df: df.where(F.col("column_name") == column)
        out = one(self.column_stats).join(one(self.scores), "column_name").join(one(self.encodings), "column_name").join(one(A.compression(self.footers.chunks)).select("column_name", "codec", "is_uncompressed"), "column_name")
        if column not in self.rows_frame().columns:
            return out
        return out.join(self.profile([column]).drop("null_count"), "column_name")

    def summary(self, columns: list[str] | None = None) -> DataFrame:
        n = self.schema.count()
        return self.spark.createDataFrame([(self.path, self.files, self.rows, self.bytes, n)], "path string, file_count long, total_rows long, total_bytes long, columns long").join(F.broadcast(self.quality(columns)))

    def suggestions(self) -> DataFrame:
        return Q.repair_suggestions(self.footers.row_groups, self.column_stats, self.encodings)

    def null_patterns(self) -> DataFrame:
        return Q.null_patterns(self.column_stats)

    def engines(self) -> DataFrame:
        return self.footers.files.where("created_by is not null").select("created_by").distinct().select("created_by", S.engine(F.col("created_by")).alias("e")).select("created_by", "e.*")

    def timestamps(self) -> list[str]:
        return [f.name for f in self.rows_frame().schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]

    def time_series(self) -> DataFrame:
        """Over row groups in order of path and index, by the footers' bounds."""
        chunks = self.footers.chunks.where(F.col("leaf_path").isin(self.timestamps() or [""]))
        ms = lambda c: F.call_function("div", F.col(c), F.lit(1000))
        return A.time_series(chunks.select(F.col("leaf_path").alias("column_name"), F.struct("path", "row_group").alias("index"), ms("min_micros").alias("min_ms"), ms("max_micros").alias("max_ms")))

    def sort_order(self, strict: bool = True) -> DataFrame:
        """Of every leaf with bounds, of any type that has an order, over row groups in order of path and index; see
        ``stats.sort_order``."""
        return A.sort_order(self.footers.chunks.select("column_name", F.struct("path", "row_group").alias("index"), F.col("min_key").alias("low"), F.col("max_key").alias("high")), strict)

    def partitions(self) -> DataFrame:
        """Rows and bytes by the values of each k=v folder, and the skewed ones; without such folders no row."""
        sizes = self.footers.files.where("error is null").select("path", F.col("row_count").alias("rows"), F.col("file_size").alias("bytes"))
        return A.partitions(self.footers.paths.select("path", F.explode("partitions").alias("key", "value")).join(sizes, "path"))

    def row_groups(self, order: str = "index", descending: bool = False) -> DataFrame:
        """Row groups by index, num_rows, total_byte_size, compressed_size or compression_ratio, with those far from
        the mean size flagged."""
        groups = self.footers.row_groups
        spread = groups.agg(F.avg("total_byte_size").alias("_mean"), F.stddev_pop("total_byte_size").alias("_spread"))
        flagged = groups.crossJoin(F.broadcast(spread)).withColumn("is_outlier", A.is_outlier(F.col("total_byte_size"), F.col("_mean"), F.col("_spread"))).drop("_mean", "_spread")  # one row
        return flagged.orderBy(F.desc(order) if descending else F.asc(order), "path", "index")

    def profile(self, columns: list[str] | None = None, bins: int = 30) -> DataFrame:
        return P.profile(self.rows_frame(), columns, bins)

    @cached_property
    def placed_groups(self) -> DataFrame:
        """The row groups (path, row_group, first_row, num_rows, total_byte_size) with their index among all: files in order
        of path, row groups in order of index. A file's place is counted over a row for each file."""
        groups = self.footers.row_groups.select("path", F.col("index").alias("row_group"), "num_rows", "total_byte_size")
        before = groups.groupBy("path").agg(F.count("*").alias("n"))
        order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        offsets = before.select("path", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("path").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1)
        placed = groups.withColumn("first_row", F.coalesce(F.sum("num_rows").over(inside), F.lit(0))).join(offsets, "path")
        return placed.withColumn("index", F.col("offset") + F.col("row_group")).drop("offset")

    def sampled_groups(self, percent: float, seed: int = 0) -> DataFrame:
        """The ``placed_groups`` that a sample takes, by their index."""
        return A.sample_groups(self.placed_groups, percent, seed)

    def first_rows(self, text: str, limit: int) -> tuple[DataFrame, int]:
        """The first ``limit`` rows that match, in the order of files and rows, and how many row groups were looked at for them.

        Row groups that statistics don't rule out are counted in order and in growing waves until there are enough matches; the rows
        come from those only, so what lies behind the last match but a wave isn't read."""
        rows = self.rows_frame()
        schema = T.StructType([f for f in rows.schema if f.name in self._stored_columns])
        condition = W.to_column(W.parse(text), schema)
        left = self.placed_groups.join(row_group_skips(self.footers, text), ["path", "row_group"], "left").where("skipped is null or not skipped")
        left = left.withColumn("at", F.row_number().over(Window.orderBy("index")) - 1).drop("skipped").persist(StorageLevel.MEMORY_AND_DISK)  # a row for each row group
        found = end = 0
        try:
            for begin, end in waves(left.count() if limit > 0 else 0, self.spark.sparkContext.defaultParallelism):
                wave = left.where((F.col("at") >= begin) & (F.col("at") < end))
                found += read_row_groups(self.spark, wave, schema, W.roots(text, schema)).where(condition).limit(limit - found).count()
                if found >= limit:
                    break
        finally:
            left.unpersist()
        read = read_row_groups(self.spark, left.where(F.col("at") < end), schema, placed=True)
        return read.where(condition).orderBy("_group", "_row").limit(limit).drop("_group", "_row"), end

    @cached_property
    def _stored_columns(self) -> set[str]:
        """The columns that files have, without those of folders."""
        return {r[0] for r in self.footers.leaves.select(F.split("leaf_path", r"\.")[0]).distinct().collect()}

    def limited_profile(self, seconds: float | None = None, row_groups: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """The profile of the row groups that a limit allows, flagged ``truncated`` if these aren't all; see ``partial``."""
        return limited_profile(self.spark, self.placed_groups, self.rows_frame().schema, columns, seconds, row_groups)

    def sampled_stats(self, percent: float, seed: int = 0, extrapolate: bool = True) -> DataFrame:
        """Column statistics of sampled row groups, scaled to all unless told not to, with the margin in points."""
        chosen = self.sampled_groups(percent, seed)
        facts = chosen.agg(F.count("*").alias("n"), F.sum("num_rows").alias("rows")).first()
        total = self.footers.row_groups.count()
        out = A.column_stats(self.footers.chunks.join(chosen.select("path", "row_group"), ["path", "row_group"]), facts["rows"] or 0)
        scale = total / facts["n"] if extrapolate and facts["n"] else 1.0
        sizes = {c: F.round(F.col(c) * scale).cast("long") for c in ("total_null_count", "total_data_page_size", "total_compressed_size")}
        return out.withColumns(sizes | {"margin_pct": F.lit(A.sample_margin(facts["n"])), "sampled_row_groups": F.lit(facts["n"]), "total_row_groups": F.lit(total)})

    def sampled_profile(self, percent: float, seed: int = 0, columns: list[str] | None = None, bins: int = 20, extrapolate: bool = True) -> DataFrame:
        """The profile of the rows of sampled row groups; rows and nulls scaled to all unless told not to."""
        chosen = self.sampled_groups(percent, seed)
        facts = chosen.agg(F.count("*").alias("n"), F.sum("num_rows").alias("rows")).first()
        scale = self.rows / facts["rows"] if extrapolate and facts["rows"] else 1.0
        found = P.profile(read_row_groups(self.spark, chosen, self.rows_frame().schema, columns), columns, bins)
        scaled = {c: F.round(F.col(c) * scale).cast("long") for c in ("row_count", "null_count")}
        return found.withColumns(scaled | {"margin_pct": F.lit(A.sample_margin(facts["n"])), "sampled_row_groups": F.lit(facts["n"])})

    def regressions(self, store: str) -> DataFrame | None:
        kept = C.load_baseline(self.spark, store, self.path)
        return kept and C.regressions(kept["schema"], self.schema, kept["scores"], self.scores, kept["stats"], self.column_stats)

    def save_baseline(self, store: str) -> str:
        return C.save_baseline(store, self.path, self.schema, self.scores, self.column_stats)


def _held(df: DataFrame) -> DataFrame:
    """A result with a few rows for each column of a dataset, as a table that needs its footers no more."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def summary(spark: SparkSession, path: str, columns: list[str] | None = None, save: str | None = None) -> DataFrame:
    """Files, rows, bytes and quality, of some columns if they are named; with ``save`` also as a JSON file
    {dataset, quality} at that path."""
    with Dataset(spark, path) as data:
        out = data.summary(columns)
        row = out.first()
        if save:
            part = lambda names, name: F.struct(*names).alias(name)
            whole = F.struct(part(out.columns[:5], "dataset"), part(out.columns[5:], "quality"))
            sinks.write_json(out.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json")), save)
        return spark.createDataFrame([row], out.schema)


def schema(spark: SparkSession, path: str, form: str = "table") -> DataFrame | str:
    """The leaves of the first file: as a table, as ``text`` (a line for each) or as ``json``."""
    with Dataset(spark, path) as data:
        found = _held(data.schema.orderBy("position"))
    if form == "table":
        return found
    rows = [r.asDict() for r in found.collect()]  # a schema
    if form == "json":
        return json.dumps(rows, indent=2, ensure_ascii=False)
    if form != "text":
        raise ValueError(f"no form {form!r}")
    lines = [f"{r['leaf_path']}: {r['physical_type']}{f' ({r['logical_type']})' if r['logical_type'] else ''} {r['repetition']}" for r in rows]
    return "\n".join(lines)


def duplicates(spark: SparkSession, path: str, exact: bool = True, threshold: float | None = None) -> tuple[DataFrame, bool]:
    """The report, and whether the share stays within the threshold."""
    report = A.duplicates(read(spark, path), exact)
    return report, threshold is None or report.first()["duplicate_pct"] <= threshold


def check(spark: SparkSession, path: str, store: str) -> tuple[DataFrame | None, bool]:
    """Regressions against the stored baseline (None without one), and whether there are none."""
    with Dataset(spark, path) as data:
        found = data.regressions(store)
        found = None if found is None else _held(found)
    return found, found is None or found.isEmpty()


def validate(spark: SparkSession, path: str, store: str | None = None) -> tuple[dict[str, DataFrame | None], int]:
    """Quality, suggestions and regressions with an exit code: 0 fine, 1 findings or a score under 80, 2 unreadable."""
    try:
        data = Dataset(spark, path)
    except NotFound:
        return {}, 2
    with data:
        made = {"quality": data.quality(), "suggestions": data.suggestions(), "regressions": data.regressions(store) if store else None}
        found = {k: None if v is None else _held(v) for k, v in made.items()}
    bad = found["quality"].first()["overall_score"] < 80 or not found["suggestions"].isEmpty() or (found["regressions"] is not None and not found["regressions"].isEmpty())
    return found, int(bad)


def compare(spark: SparkSession, left: str, right: str) -> dict[str, DataFrame]:
    with Dataset(spark, left) as a, Dataset(spark, right) as b:
        made = {
            "dataset": C.dataset_diff(a.footers.files, b.footers.files, a.schema.count(), b.schema.count()),
            "schema": C.schema_diff(a.schema, b.schema), "stats": C.stats_diff(a.column_stats, b.column_stats),
        }
        return {k: _held(v) for k, v in made.items()}


def export(spark: SparkSession, path: str, out: str, form: str = "json", columns: list[str] | None = None, limit: int | None = None, store: str | None = None) -> None:
    """Write json, csv (columns and row groups) or ndjson below ``out``; ``columns`` and ``limit`` choose columns."""
    with Dataset(spark, path) as data:
        _export(spark, data, out, form, columns, limit, store)


def _export(spark: SparkSession, data: Dataset, out: str, form: str, columns: list[str] | None, limit: int | None, store: str | None) -> None:
    pick = lambda df: df if columns is None else df.where(F.col("column_name").isin(columns))
    stats = pick(data.column_stats).orderBy("column_name")
    stats = stats if limit is None else stats.limit(limit)
    scores = pick(data.scores)
    if form == "csv":
        sinks.write_csv(sinks.csv_columns(stats, scores), f"{out}/columns")
        sinks.write_csv(sinks.csv_row_groups(data.footers.row_groups), f"{out}/row_groups")
    elif form == "ndjson":
        sinks.write_ndjson(stats, f"{out}/columns")
    elif form == "json":
        found = data.regressions(store) if store else None
        empty = spark.createDataFrame([], "column string, kind string, detail string")
        required = {"column_stats": stats, "row_groups": data.footers.row_groups, "quality_scores": scores, "null_patterns": data.null_patterns(), "baseline_regressions": found if found is not None else empty}
        optional = {"engine_info": data.engines(), "timeseries_profiles": data.time_series(), "nested_profiles": A.nested(data.footers.leaves), "repair_suggestions": data.suggestions()}
        sinks.write_json(sinks.json_document(data.summary(), required, optional), f"{out}/document")
    else:
        raise ValueError(f"no form {form!r}")


def inspect(spark: SparkSession, path: str, sample_percent: float | None = None, store: str | None = None, profile: bool = False) -> dict[str, DataFrame]:
    """What the views of an inspection show, by name. With ``sample_percent`` also the statistics of sampled row
    groups; with ``store`` the regressions against the baseline; with ``profile`` the profile of all rows, or of the
    sampled ones. The footers are kept until the session ends."""
    data, config = Dataset(spark, path), Config.load()
    chunks = data.footers.chunks
    rows = data.footers.row_groups.select("path", F.col("index").alias("row_group"), "num_rows")
    heat = chunks.join(rows, ["path", "row_group"]).select("path", "row_group", "leaf_path", S.percentage(F.col("null_count"), F.col("num_rows")).alias("null_pct"))
    views = {
        "files": data.footers.files, "engines": data.engines(),
        "schema": data.schema.withColumns({"class": S.type_class(F.col("physical_type"), F.col("logical_type")), "icon": S.type_icon(F.col("physical_type"))}),
        "columns": data.column_stats.join(data.scores, "column_name").withColumn("class", S.quality_class(F.col("score"))), "row_groups": data.row_groups(),
        "uniformity": A.uniformity(data.footers.row_groups), "null_heatmap": heat.withColumn("bucket", S.null_bucket(F.col("null_pct"))), "preview": preview(data.rows_frame(), config.max_rows_preview),
        "sizes": data.column_stats.select("column_name", "total_compressed_size", S.byte_text(F.col("total_compressed_size")).alias("size")).orderBy(F.desc("total_compressed_size")),
        "compression": A.compression(chunks), "encodings": data.encodings, "page_index": A.page_index(chunks), "bloom_filters": A.bloom_filters(data.footers.bloom_filters()),
        "nested": A.nested(data.footers.leaves), "null_patterns": data.null_patterns(), "suggestions": data.suggestions(), "row_group_advice": Q.row_group_advice(data.footers.row_groups),
        "encoding_advice": Q.encoding_advice(data.schema, data.encodings, data.column_stats), "compression_advice": Q.compression_advice(A.compression(chunks)),
        "time_series": data.time_series(), "sort_order": data.sort_order(), "partitions": data.partitions(), "quality": data.quality(), "inconsistencies": data.inconsistencies,
        "messages": C.schema_messages(data.footers.leaves),
    }
    if sample_percent:
        views["sampled_stats"] = data.sampled_stats(sample_percent)
    if store and (found := data.regressions(store)) is not None:
        views["regressions"] = found
    if profile:
        views["profile"] = data.sampled_profile(sample_percent, bins=config.histogram_bins) if sample_percent else data.profile(bins=config.histogram_bins)
    return views


def find_columns(
    stats: DataFrame, text: str = "", null_hotspots: bool = False, order: str = "column_name", descending: bool = False, scores: DataFrame | None = None, bookmarks: list[str] | None = None
) -> DataFrame:
    """Columns whose name holds a text in any case, with over 5 % nulls if asked for, only the bookmarked ones if some
    are named, in an order: column_name, any statistic, or with the ``scores`` any of theirs (score)."""
    out = stats if scores is None else stats.join(scores, "column_name")
    out = out.where(F.contains(F.lower("column_name"), F.lit(text.lower())))
    out = out.where("null_percentage > 5") if null_hotspots else out
    out = out if bookmarks is None else out.where(F.col("column_name").isin(bookmarks))
    return out.orderBy(F.desc(order) if descending else F.asc(order), "column_name")
