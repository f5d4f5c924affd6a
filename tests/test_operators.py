import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colquarry import api
from colquarry.functions import scalars as S
from colquarry.operators import compare as C
from colquarry.operators import profile as P
from colquarry.operators import quality as Q
from colquarry.operators import stats as A
from colquarry.sources import sinks
from colquarry.sources.footer import read_footers
from colquarry.sources.paths import Config, parse_store_uri, resolve


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """Three rows, one of them without a name."""
    path = tmp_path_factory.mktemp("small") / "a.parquet"
    schema = pa.schema([pa.field("id", pa.int32(), nullable=False), pa.field("name", pa.string())])
    pq.write_table(pa.table({"id": [1, 2, 3], "name": ["alice", "bob", None]}, schema=schema), path)
    return str(path)


@pytest.fixture(scope="session")
def groups(tmp_path_factory):
    """Ten row groups of a hundred sorted ids."""
    path = tmp_path_factory.mktemp("groups") / "g.parquet"
    n = range(1000)
    table = pa.table({"id": list(n), "v": [i * 0.5 for i in n], "s": [None if i % 4 == 0 else f"x{i % 7}" for i in n], "ts": pa.array([i * 1_000_000 + (10**10 if i >= 500 else 0) for i in n], pa.timestamp("us"))})
    pq.write_table(table, path, row_group_size=100)
    return str(path)


def test_footer_of_a_small_file(spark, small):
    f = read_footers(spark, small)
    assert f.files.first().row_count == 3
    assert [x.column_name for x in f.leaves.orderBy("position").collect()] == ["id", "name"]
    stats = {x.column_name: x for x in A.column_stats(f.chunks, 3).collect()}
    assert stats["name"].total_null_count == 1 and abs(stats["name"].null_percentage - 33.33) < 1 and stats["id"].min == "1"
    assert all(x.score <= 100 for x in Q.scores(A.column_stats(f.chunks, 3), 3, A.encodings(f.chunks)).collect())


@pytest.mark.parametrize("nulls,distinct,rows,score", [(0, None, 100, 100), (5, None, 100, 100), (50, None, 100, 40), (100, None, 100, 40), (0, 0, 100, 80), (0, 1, 100, 80), (0, 100, 100, 95), (0, 50, 100, 100)])
def test_scores(spark, nulls, distinct, rows, score):
    df = spark.createDataFrame([("c", float(nulls), distinct)], "column_name string, null_percentage double, total_distinct_count_estimate long")
    x = Q.scores(df, rows).first()
    assert x.score == score and x.null_penalty == max(0, (nulls - 5) * 2) and x.cardinality_flag == (distinct == rows)


def test_summary_without_columns(spark):
    scores = spark.createDataFrame([], "column_name string, score int")
    assert Q.summary(scores, spark.createDataFrame([], "column_name string, total_data_page_size long"), 0, 0).first().overall_score == 100


@pytest.mark.parametrize("count,size,stats,encodings,want", [
    (0, 1, [("c", 90.0, 1)], [], []), (101, 1 << 20, [], [], ["high"]), (50, 128 << 20, [], [], []), (1, 1, [("c", 75.0, 1)], [], ["low"]),
    (1, 1, [("c", 0.0, 2 << 20)], [("c", ["RLE_DICTIONARY"])], ["medium"]), (1, 1, [("c", 0.0, 2 << 20)], [("c", ["PLAIN"])], []),
])
def test_repair(spark, count, size, stats, encodings, want):
    g = spark.range(count).select(F.col("id").cast("int").alias("index"), F.lit(size).cast("long").alias("total_byte_size"))
    out = Q.repair_suggestions(g, spark.createDataFrame(stats, "column_name string, null_percentage double, total_data_page_size long"), spark.createDataFrame(encodings, "column_name string, encodings array<string>"))
    assert [x.severity for x in out.collect()] == want


def test_engines(spark):
    names = {
        "Apache Spark 3.4.0": "Apache Spark", "spark sql": "Apache Spark", "pyarrow 14.0.1": "PyArrow / Apache Arrow", "arrow 12.0": "PyArrow / Apache Arrow", "DuckDB 0.10.0": "DuckDB", "impala version 4.0": "Apache Impala",
        "Apache Hive 3.1.3": "Apache Hive", "Trino 420": "Trino / Presto", "presto-main:0.284": "Trino / Presto", "Apache Flink 1.18.0": "Apache Flink", "pandas 2.1.0": "Pandas (via fastparquet or PyArrow)", "parquet-go v1.0": "parquet-go",
        "parquet_go 1.0": "parquet-go", "parquet4s 2.0.0": "parquet4s (Scala)", "some-unknown-writer 99": "Unknown",
    }
    df = spark.createDataFrame([(k,) for k in names], "w string").select("w", S.engine(F.col("w")).alias("e"))
    for x in df.collect():
        assert x.e.engine_name == names[x.w] and (x.e.hints == []) == (names[x.w] == "Unknown")
    versions = {x.w: x.e.version_hint for x in df.collect()}
    assert versions["impala version 4.0"] == "4.0" and versions["parquet-go v1.0"] == "1.0" and versions["arrow 12.0"] is None


def test_pruning_and_filter(spark, groups):
    r = api.filter_count(spark, groups, "id BETWEEN 250 AND 349 AND v >= 0")
    assert (r.matched, r.skipped_row_groups, r.scanned_row_groups, r.total_row_groups, r.sample.count()) == (100, 8, 2, 10, 10)
    assert api.filter_count(spark, groups, "id IS NULL").skipped_row_groups == 10


def test_dataset_commands(spark, groups, small, tmp_path):
    data = api.Dataset(spark, groups)
    ts = data.time_series().first()
    assert ts.is_monotonic and ts.total_duration_ms == 999_000 + 10**7 and ts.max_gap_ms == 10**7 + 1000
    order = A.sort_order(data.footers.chunks.where("column_name = 'id'").select("column_name", F.col("row_group").alias("index"), F.col("min_number").alias("low"), F.col("max_number").alias("high"))).first()
    assert (order.sort_order, order.confidence) == ("ascending", 1.0)
    sample = {x.column_name: x for x in data.sampled_stats(20).collect()}
    assert sample["s"].total_null_count == 250 and sample["s"].sampled_row_groups == 2 and abs(sample["s"].margin_pct - 69.3) < 0.1
    assert [x["index"] for x in A.sample_groups(data.footers.row_groups, 20, 5).collect()] == [5, 4]
    with pytest.raises(ValueError):
        A.sample_groups(data.footers.row_groups, 0)
    store = f"{tmp_path}/base"
    assert api.check(spark, groups, store) == (None, True)
    data.save_baseline(store)
    assert api.check(spark, groups, store)[1]
    found, code = api.validate(spark, groups, store)
    assert code == 0 and found["quality"].first().overall_score >= 80
    assert api.validate(spark, f"{tmp_path}/none")[1] == 2
    for form in ("json", "csv", "ndjson"):
        api.export(spark, groups, f"{tmp_path}/{form}", form, store=store)
    import json

    document = json.loads(spark.read.text(f"{tmp_path}/json/document").first()[0])
    assert {"dataset", "column_stats", "row_groups", "quality_scores", "null_patterns", "baseline_regressions", "engine_info", "timeseries_profiles"} <= set(document) and "nested_profiles" not in document
    assert len(document["row_groups"]) == 10
    head = spark.read.option("header", True).csv(f"{tmp_path}/csv/columns")
    assert head.columns == ["column_name", "type", "null_rate", "cardinality", "data_size_bytes", "compressed_size_bytes", "compression_ratio", "quality_score", "breakdown"]
    assert {x.column_name: x.null_rate for x in head.collect()}["s"] == "0.2500"
    views = api.inspect(spark, groups)
    assert all(v.columns for v in views.values()) and views["null_heatmap"].where("leaf_path = 's'").first().bucket == "<75%"
    diff = api.compare(spark, small, groups)
    assert {x["name"]: x.status for x in diff["schema"].collect()} == {"id": "TypeChanged", "name": "Removed", "s": "Added", "ts": "Added", "v": "Added"}
    assert diff["dataset"].first().row_delta == 997
    assert sinks.write_rows(data.rows_frame(), F.col("id") < 5, f"{tmp_path}/rows", 3) == 3 and sinks.write_rows(data.rows_frame(), F.col("id") < 0, f"{tmp_path}/no") == 0
    assert api.duplicates(spark, small)[1] and api.summary(spark, small).first().total_rows == 3


def test_consistency_partitions_and_broken_files(spark, tmp_path):
    d = tmp_path / "ds"
    for year, rows in (("2023", 10), ("2024", 10), ("2025", 90)):
        (d / f"year={year}").mkdir(parents=True)
        pq.write_table(pa.table({"a": range(rows)} if year != "2024" else {"a": [float(i) for i in range(rows)], "extra": range(rows)}), d / f"year={year}" / "p.parquet")
    (d / "year=2025" / "bad.parquet").write_bytes(b"nothing")
    f = read_footers(spark, str(d))
    assert f.files.where("error is not null").count() == 1
    kinds = {(x.column_name, x.kind) for x in C.schema_consistency(f.leaves).collect()}
    assert kinds == {("a", "physical_type_changed"), ("extra", "column_added")}
    files = f.files.where("error is null").join(resolve(spark, str(d)).select("path", F.explode("partitions").alias("key", "value")), "path")
    part = A.partitions(files.select("key", "value", F.col("row_count").alias("rows"), F.col("file_size").alias("bytes"))).first()
    assert part.distinct_values == ["2023", "2024", "2025"] and part.partition_row_counts == {"2023": 10, "2024": 10, "2025": 90} and part.skewed_partitions == ["2025"]


def test_bounds_are_typed(spark, tmp_path):
    from decimal import Decimal

    import datetime as dt

    n = range(1, 21)
    table = pa.table({
        "id": list(n), "amount": pa.array([Decimal(i) / 4 for i in n], pa.decimal128(9, 2)), "x": [i * 1.5 for i in n], "day": [dt.date(2020, 1, 1) + dt.timedelta(i) for i in n],
        "at": pa.array([dt.datetime(1969, 12, 31, 23) + dt.timedelta(hours=i) for i in n]), "s": [f"v{i}" for i in n],
    })
    pq.write_table(table, tmp_path / "t.parquet", row_group_size=5)
    f = read_footers(spark, str(tmp_path / "t.parquet"))
    got = {x.column_name: (x.min, x.max) for x in A.column_stats(f.chunks, 20).collect()}
    assert got == {"id": ("1", "20"), "amount": ("0.25", "5.00"), "x": ("1.5", "30.0"), "day": ("2020-01-02", "2020-01-21"), "at": ("1970-01-01 00:00:00", "1970-01-01 19:00:00"), "s": ("v1", "v9")}
    order = {x.column_name: x.sort_order for x in api.Dataset(spark, str(tmp_path / "t.parquet")).sort_order().collect()}
    assert order["id"] == order["amount"] == order["at"] == "ascending"


def test_pruning_is_exact(spark, tmp_path):
    big = 1 << 53
    pq.write_table(pa.table({"k": [big]}), tmp_path / "k.parquet")
    for text, matched, skipped in ((f"k < {big + 1}", 1, 0), (f"k >= {big + 1}", 0, 1), (f"k = {big}", 1, 0), (f"k > {big}", 0, 1), ("k > 0.5", 1, 0)):
        r = api.filter_count(spark, str(tmp_path / "k.parquet"), text)
        assert (r.matched, r.skipped_row_groups) == (matched, skipped), text


def test_leaves_come_from_the_tree(spark, tmp_path):
    item = pa.struct([pa.field("x", pa.int32(), nullable=False), pa.field("y", pa.string())])
    schema = pa.schema([
        pa.field("id", pa.int64(), nullable=False), pa.field("a", pa.struct([pa.field("x", pa.int32(), nullable=False), pa.field("list", pa.int32())])), pa.field("b", pa.struct([pa.field("x", pa.int32())])),
        pa.field("l", pa.list_(pa.float32())), pa.field("items", pa.list_(item)), pa.field("m", pa.map_(pa.string(), pa.list_(pa.int32()))),
    ])
    rows = [{"id": 1, "a": {"x": 5, "list": 1}, "b": {"x": 7}, "l": [1.0], "items": [{"x": 1, "y": "q"}], "m": [("k", [1])]}]
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), tmp_path / "n.parquet")
    f = read_footers(spark, str(tmp_path / "n.parquet"))
    leaves = {x.leaf_path: (x.repetition, x.holders) for x in f.leaves.collect()}
    assert leaves == {
        "id": ("REQUIRED", []), "a.x": ("REQUIRED", ["struct"]), "a.list": ("OPTIONAL", ["struct"]), "b.x": ("OPTIONAL", ["struct"]), "l.list.element": ("OPTIONAL", ["list"]),
        "items.list.element.x": ("REQUIRED", ["list", "struct"]), "items.list.element.y": ("OPTIONAL", ["list", "struct"]), "m.key_value.key": ("REQUIRED", ["map"]), "m.key_value.value.list.element": ("OPTIONAL", ["map", "list"]),
    }
    kinds = {x.leaf_path: (x.is_list, x.is_map, x.is_struct) for x in A.nested(f.leaves).collect()}
    assert kinds["a.list"] == (False, False, True) and kinds["l.list.element"] == (True, False, False) and kinds["m.key_value.value.list.element"] == (False, True, False)
    stats = {x.column_name: x.min for x in A.column_stats(f.chunks, 1).collect()}
    assert (stats["a.x"], stats["b.x"]) == ("5", "7")


def test_bloom_filters_and_other_file_systems(spark, tmp_path):
    out = f"{tmp_path}/bloom"
    spark.range(2000).select("id", (F.col("id") * 7).alias("other")).coalesce(1).write.option("parquet.bloom.filter.enabled#id", "true").option("parquet.enable.dictionary", "false").parquet(out)
    got = {x.leaf_path: x.has_bloom_filter for x in A.bloom_filters(read_footers(spark, out).bloom_filters()).collect()}
    assert got == {"id": True, "other": False}
    # a path that only Hadoop's file systems can open
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    (tmp_path / "bloom" / "broken.parquet").write_bytes(b"PAR1 nothing here")
    far = read_footers(spark, "viewfs://far/in/bloom")
    assert far.files.where("error is null").first().row_count == 2000 and far.files.where("error is not null").count() == 1
    assert {x.leaf_path: x.has_bloom_filter for x in A.bloom_filters(far.bloom_filters()).collect()} == got


def test_directories(spark, tmp_path):
    for where in ("p/year=2024/month=01", "p/year=2025/month=02", "q/deep/er", "q/year=1/x"):
        (tmp_path / where).mkdir(parents=True)
        pq.write_table(pa.table({"a": [1, 2]}), tmp_path / where / "f.parquet")
    (tmp_path / "p" / "notes.txt").write_text("no table")
    (tmp_path / "q" / "notes.txt").write_text("no table")
    from colquarry.sources.paths import read

    p = read(spark, str(tmp_path / "p"))
    assert dict(p.dtypes) == {"a": "bigint", "year": "string", "month": "string"} and sorted({(x.year, x.month) for x in p.collect()}) == [("2024", "01"), ("2025", "02")]
    q = read(spark, str(tmp_path / "q"))
    assert q.count() == 4 and sorted({x.year or "" for x in q.collect()}) == ["", "1"]
    part = {x.key: x.distinct_values for x in api.Dataset(spark, str(tmp_path / "p")).partitions().collect()}
    assert part == {"year": ["2024", "2025"], "month": ["01", "02"]}


def test_sampled_rows_and_detail(spark, groups):
    with api.Dataset(spark, groups) as data:
        chosen = data.sampled_groups(20)
        assert sorted((x.row_group, x.first_row) for x in chosen.collect()) == [(0, 0), (1, 100)]
        p = {x.column_name: x for x in data.sampled_profile(20).collect()}
        assert p["id"].row_count == 1000 and p["id"].numeric.max == 199 and len(p["id"].histogram) == 20 and p["s"].null_count == 250
        detail = data.column_detail("s").first()
        assert detail.codec == "SNAPPY" and detail.string.max_length == 2 and detail.score < 100
        rows = data.row_groups("num_rows", descending=True).collect()
        assert len(rows) == 10 and not any(x.is_outlier for x in rows)
    assert "s: BYTE_ARRAY" in api.schema(spark, groups, "text") and api.filter_rows(data.rows_frame(), "id >= 150", 3).orderBy("id").first().id == 150
    views = api.inspect(spark, groups, sample_percent=20, profile=True)
    assert {"sampled_stats", "profile", "partitions", "messages", "sort_order"} <= set(views) and views["schema"].where("column_name = 'id'").first().icon == "#"
    scored = api.find_columns(views["columns"].drop("score"), scores=data.scores.select("column_name", "score"), order="score", bookmarks=["id", "s"])
    assert [x.column_name for x in scored.collect()] == ["s", "id"]


def test_profile_of_all_kinds(spark):
    import datetime as dt

    rows = [(i, float(i % 5) if i % 7 else math.inf, f"k{i % 3}", i % 2 == 0, dt.date(2020, 1, 1 + i % 4), dt.datetime(2020, 1, 1, i % 6), [i], {"a": i}, None) for i in range(70)]
    df = spark.createDataFrame(rows, "n int, x double, s string, b boolean, d date, t timestamp, l array<int>, m map<string,int>, none int").repartition(3)
    got = {x.column_name: x for x in P.profile(df).collect()}
    assert got["n"].distinct_count == 70 and got["n"].numeric.p50 in (34, 35) and sum(b["count"] for b in got["n"].histogram) == 70
    assert got["x"].numeric.max == math.inf and sum(b["count"] for b in got["x"].histogram) == 60 and got["x"].histogram[0].low == 0 and got["x"].histogram[-1].high == 4
    assert got["x"].top_values[0].value == "0.0" and {v.value for v in got["x"].top_values} == {"0.0", "1.0", "2.0", "3.0", "4.0", "Infinity"}
    assert [(v.value, v["count"]) for v in got["s"].top_values] == [("k0", 24), ("k1", 23), ("k2", 23)] and got["s"].string.max_length == 2
    assert got["b"].boolean.true_count == 35 and got["b"].top_values[0].value == "false" and got["d"].top_values[0].value == "2020-01-01" and got["d"].temporal.range_days == 3
    assert got["t"].top_values[0].value == "2020-01-01 00:00:00" and got["m"].distinct_count is None and got["l"].distinct_count == 70
    assert got["none"].null_count == 70 and got["none"].histogram is None and got["none"].top_values is None
    assert {x.column_name: x.row_count for x in P.profile(df.limit(0)).collect()}["n"] == 0


def test_a_profile_reads_each_column_once_a_pass(spark, groups):
    df = api.Dataset(spark, groups).rows_frame()
    plan = P._first_pass(df, P.kinds(df))._jdf.queryExecution().executedPlan().toString()
    read = [c.split(":")[0] for part in __import__("re").findall(r"ReadSchema: struct<(.*?)>", plan) for c in part.split(",")]
    assert sorted(read) == sorted(df.columns)


def test_two_time_limits_at_once(spark):
    import threading

    from colquarry.streaming.watch import with_timeout

    found = []
    slow = threading.Thread(target=lambda: found.append(with_timeout(spark, 120, lambda: spark.range(0, 1 << 22, 1, 8).select(F.sum("id")).first()[0])))
    slow.start()
    from colquarry.streaming.watch import TimedOut

    with pytest.raises(TimedOut):
        with_timeout(spark, 0.5, lambda: spark.range(0, 1 << 34, 1, 400).select(F.sum(F.hash("id"))).collect())
    slow.join()
    assert found == [(1 << 22) * ((1 << 22) - 1) // 2]


def test_paths():
    assert parse_store_uri("s3://b/k/x.parquet") == ("s3", "b", "k/x.parquet") and parse_store_uri("gs://b") == ("gs", "b", "") and parse_store_uri("/a/b") is None


def test_config(tmp_path):
    path = f"{tmp_path}/c/config.json"
    assert Config.load(path) == Config()
    Config(histogram_bins=7).save(path)
    assert Config.load(path).histogram_bins == 7


def test_config_from_the_environment(tmp_path, monkeypatch):
    monkeypatch.setenv("COLQUARRY_CONFIG", f"{tmp_path}/own.json")
    Config(max_rows_preview=3).save()
    assert Config.load().max_rows_preview == 3
    monkeypatch.delenv("COLQUARRY_CONFIG")
    monkeypatch.setenv("XDG_CONFIG_HOME", f"{tmp_path}/xdg")
    assert Config.load() == Config()


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, 3.0, "", True), (2.0, 3.0, " ", None), (None, 3.0, "١٢", False), (math.nan, 3.0, "12\n", None)], "x double, same double, s string, b boolean")
    n = {r.column_name: r for r in P.numeric_profile(df).collect()}
    assert n["x"]["count"] == 2 and n["x"].mean == 1.5 and n["x"].max == 2.0 and n["same"].skewness == 0 and n["same"].kurtosis == 0
    s = P.string_profile(df).first()
    assert (s.empty_count, s.whitespace_count, s.numeric_pct, s.max_length) == (1, 1, 25.0, 4)
    assert P.boolean_profile(df).first().true_pct == 50.0
    assert [tuple(r) for r in P.histogram(df, "same").collect()] == [(0, 3.0, 3.0, 4)]
    assert P.histogram(df.limit(0), "x").count() == 0 and P.numeric_profile(df.limit(0)).first().mean == 0
    assert A.correlation(df.select("x", "same"), ["x", "same"]).where("a = 'x' and b = 'same'").first().pearson == 0
    assert P.top_values(df, ["s", "b"]).where("column_name = 'b' and rank = 1").first().value == "false"


def test_duplicates(spark):
    df = spark.createDataFrame([("ab", "c", 1), ("a", "bc", 1), ("a", "bc", 2), (None, None, None), (None, None, None)], "a string, b string, n int")
    assert A.duplicates(df).first().duplicate_rows == 1
    assert A.duplicates(df, exact=False).first().total_rows == 5


def test_texts(spark):
    row = spark.range(1).select(
        S.byte_text(F.lit(1536)).alias("b"), S.duration_text(F.lit(90_000)).alias("d"), S.epoch_text(F.lit(951_782_399)).alias("e"), S.shortened(F.lit("abcdef"), 4).alias("t"), S.epoch_ms(F.lit(-1500).cast("long").cast("timestamp"), __import__("pyspark").sql.types.TimestampType()).alias("ms"),
    ).first()
    assert row.e == "2000-02-28 23:59:59 UTC"
    assert (row.b, row.d, row.t, row.ms) == ("1.50 KB", "1.5m", "abc…", -1_500_000)


def test_watch(spark, tmp_path):
    from colquarry.streaming.watch import TimedOut, history, poll, watch, with_timeout

    d, seen = f"{tmp_path}/in", []
    spark.range(5).write.parquet(d)
    for _ in range(2):
        watch(spark, d, lambda df, n: seen.append(df.count()), f"{tmp_path}/cp", f"{tmp_path}/log").awaitTermination(120)
        spark.range(3).write.mode("append").parquet(d)
    assert seen == [5, 8] and history(spark.read.parquet(f"{tmp_path}/log")).first().new_rows == 3
    states = iter([1, 1, 2])
    assert list(poll(lambda: next(states), 0, 3)) == [1, 2]
    with pytest.raises(TimedOut):
        with_timeout(spark, 1, lambda: spark.range(0, 1 << 34, 1, 400).select(F.sum(F.hash("id"))).collect())
    assert with_timeout(spark, 60, lambda: spark.range(3).count()) == 3
