"""Listings, footers and row groups, read by tasks from local files and from a small store of the S3 kind."""

import datetime as dt
import decimal
import http.server
import itertools
import math
import os
import threading
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colquarry import api
from colquarry.sources import stores
from colquarry.sources.footer import order_key, read_footers
from colquarry.sources.paths import LISTING, listed, read, resolve
from colquarry.sources.splits import read_row_groups


def tree(base):
    table = pa.table({"a": [1, 2]})
    for where in ("y=1/m=02", "y=1/m=/=3/z", "y=2/y=3", "plain"):
        (base / where).mkdir(parents=True, exist_ok=True)
        pq.write_table(table, base / where / "f.parquet")
    pq.write_table(table, base / "x+ä .data")
    pq.write_table(table, base / "top.parquet")
    (base / "notes.txt").write_text("no table")


def test_listing(spark, tmp_path):
    tree(tmp_path)
    base = f"file:{tmp_path}"
    names = lambda path: {p.removeprefix(base): parts for p, _, parts in listed(spark, path)}
    below = {"/y=1/m=02/f.parquet": {"y": "1", "m": "02"}, "/y=1/m=/=3/z/f.parquet": {"y": "1"}, "/y=2/y=3/f.parquet": {"y": "3"}, "/plain/f.parquet": {}, "/top.parquet": {}}
    assert names(str(tmp_path)) == below and names(f"{tmp_path}/") == below
    assert names(f"{tmp_path}/x+ä .data") == {"/x+ä .data": {}}
    assert names(f"{tmp_path}/y=1") == {"/y=1/m=02/f.parquet": {"m": "02"}, "/y=1/m=/=3/z/f.parquet": {}}
    assert names(f"{tmp_path}/y=*") == {"/y=1/m=02/f.parquet": {"m": "02"}, "/y=1/m=/=3/z/f.parquet": {}, "/y=2/y=3/f.parquet": {"y": "3"}}
    assert names(f"{tmp_path}/*") == {k: v for k, v in {**names(f"{tmp_path}/y=*"), "/plain/f.parquet": {}, "/top.parquet": {}, "/x+ä .data": {}, "/notes.txt": {}}.items()}
    assert names(f"{tmp_path}/{{top,none}}.parquet") == {"/top.parquet": {}} and names(f"{tmp_path}/[t-u]o?.parquet") == {"/top.parquet": {}}
    assert names(f"{tmp_path}/none") == {} and names(f"{tmp_path}/no*.parquet") == {}
    assert {r["size"] for r in resolve(spark, f"{tmp_path}/top.parquet").collect()} == {os.path.getsize(tmp_path / "top.parquet")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert resolve(spark, str(tmp_path)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert resolve(spark, str(tmp_path)).schema.simpleString() == spark.createDataFrame([], LISTING).schema.simpleString()


def many_groups(path, groups=100, rows=1000):
    n = groups * rows
    table = pa.table({
        "id": pa.array(range(n), pa.int64()), "wide": [f"{k:064d}" for k in range(n)], "t": pa.array([dt.datetime(2020, 1, 1) + dt.timedelta(seconds=k) for k in range(n)], pa.timestamp("ms", "UTC")),
        "d": pa.array([decimal.Decimal(k) / 100 for k in range(n)], pa.decimal128(12, 2)), "l": [[k, None] for k in range(n)], "s": [{"u": k, "v": str(k)} for k in range(n)],
        "m": pa.array([[("k", k)] for k in range(n)], pa.map_(pa.string(), pa.int32())), "u": pa.array(range(n), pa.uint32()),
    })
    pq.write_table(table, path, row_group_size=rows, compression="none", use_dictionary=False)


def counted(log, path, given):
    """Opens a file and notes each range that is read of it."""

    class Noted:
        def __init__(self):
            self.file, self.closed = open(path.removeprefix("file:"), "rb"), False

        def read(self, n=-1):
            with open(log, "a") as out:
                out.write(f"{n}\n")
            return self.file.read(n)

        def __getattr__(self, name):
            return getattr(self.file, name)

    return pa.PythonFile(Noted(), mode="r")


def test_bytes_read_follow_the_row_groups(spark, tmp_path):
    many_groups(tmp_path / "f.parquet")
    size = os.path.getsize(tmp_path / "f.parquet")
    data = api.Dataset(spark, str(tmp_path))
    rows = data.rows_frame()
    chosen = data.sampled_groups(5, seed=3)
    assert chosen.count() == 5
    places = {(r["first_row"], r["num_rows"]) for r in chosen.collect()}
    want = sorted(x for first, n in places for x in range(first, first + n))
    found = read_row_groups(spark, chosen, rows.schema, opener=partial(counted, f"{tmp_path}/log"))
    assert found.schema == rows.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.where(F.col("id").isin(want)).collect()))
    read_bytes = sum(int(x) for x in open(f"{tmp_path}/log"))
    footer = size - max(o + s for r in data.footers.row_groups.collect() for o, s in zip(r["offsets"], r["sizes"]))
    tasks = min(5, spark.sparkContext.defaultParallelism)
    assert read_bytes < 0.07 * size + (tasks + 1) * (footer + (1 << 16))
    slim = read_row_groups(spark, chosen, rows.schema, ["id", "none"], opener=partial(counted, f"{tmp_path}/log2"))
    assert slim.columns == ["id"] and sorted(r["id"] for r in slim.collect()) == want
    assert sum(int(x) for x in open(f"{tmp_path}/log2")) < 0.02 * size + (tasks + 1) * (footer + (1 << 16))
    assert read_row_groups(spark, chosen.limit(0)).count() == 0 and read_row_groups(spark, chosen).count() == 5000
    data.close()


def test_files_of_other_schemas(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([1, 2], pa.int32()), "b": ["x", "y"]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"b": ["z"], "c": [1.5]}), tmp_path / "2.parquet")
    pq.write_table(pa.table({"c": [2.5, 3.5]}), tmp_path / "3.parquet")
    with api.Dataset(spark, str(tmp_path)) as data:
        schema = spark.read.schema("a long, b string").parquet(str(tmp_path)).schema
        got = read_row_groups(spark, data.sampled_groups(100), schema)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x"), (2, "y"), (None, "z"), (None, None), (None, None)], key=str)


class Bucket(http.server.BaseHTTPRequestHandler):
    """Answers HEAD and ranged GET of objects, as a store does; ``asked`` notes who read how much of what."""

    root, asked = "", []

    def _path(self):
        return os.path.join(self.root, self.path.partition("?")[0].lstrip("/").partition("/")[2])

    def do_HEAD(self):
        if not os.path.isfile(self._path()):
            self.send_response(404)
            self.end_headers()
            return
        self.send_response(200)
        self.send_header("Content-Length", str(os.path.getsize(self._path())))
        self.send_header("ETag", '"1"')
        self.send_header("Last-Modified", "Wed, 01 Jan 2020 00:00:00 GMT")
        self.end_headers()

    def do_GET(self):
        data = open(self._path(), "rb").read()
        first, _, last = self.headers["Range"].removeprefix("bytes=").partition("-")
        part = data[int(first) : int(last) + 1]
        self.asked.append((self.path, len(part)))
        self.send_response(206)
        self.send_header("Content-Length", str(len(part)))
        self.send_header("Content-Range", f"bytes {first}-{int(first) + len(part) - 1}/{len(data)}")
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *_):
        pass


@pytest.fixture
def bucket(spark, tmp_path):
    Bucket.root, Bucket.asked = str(tmp_path), []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Bucket)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    own = {"fs.s3a.endpoint": f"http://127.0.0.1:{server.server_port}", "fs.s3a.endpoint.region": "us-east-1", "fs.s3a.access.key": "k", "fs.s3a.secret.key": "s"}
    for k, v in own.items():
        conf.set(k, v)
    yield tmp_path
    for k in own:
        conf.unset(k)
    server.shutdown()


def test_a_store_that_only_tasks_open(spark, bucket):
    many_groups(bucket / "f.parquet", 40, 500)
    many_groups(bucket / "g.parquet", 3, 500)
    size = os.path.getsize(bucket / "f.parquet")
    paths = spark.createDataFrame([(f"s3a://b/{n}", os.path.getsize(bucket / n) if n != "none.parquet" else 100) for n in ("f.parquet", "g.parquet", "none.parquet")], "path string, size long")
    got = read_footers(spark, paths)
    got.raw = got.raw.persist()
    assert {r["path"][-9:]: (r["row_count"], r["row_group_count"], bool(r["error"])) for r in got.files.collect()} == {
        "f.parquet": (20_000, 40, False), "g.parquet": (1500, 3, False), "e.parquet": (None, None, True)
    }
    assert sum(n for path, n in Bucket.asked if path.endswith("f.parquet")) < size / 5
    Bucket.asked.clear()
    groups = got.row_groups.where("index in (1, 30)").select("path", F.col("index").alias("row_group"), (F.col("index") * 500).alias("first_row"), "num_rows", "total_byte_size")
    schema = spark.read.parquet(str(bucket / "f.parquet")).schema
    rows = read_row_groups(spark, groups, schema).agg(F.count("*"), F.sum("id"), F.countDistinct("wide")).first()
    want = [*range(500, 1000), *range(15_000, 15_500)]
    assert tuple(rows) == (1500, sum(want) + sum(range(500, 1000)), 1000)
    assert 0 < sum(n for path, n in Bucket.asked if path.endswith("f.parquet")) < size / 3
    assert not stores.in_tasks("viewfs://x/y") and stores.in_tasks("gs://b/k") and stores.in_tasks("/a")


def test_order_keys():
    key = lambda physical, *values, scale=0, **logical: [order_key(physical, logical, scale, v) for v in values]
    rising = [
        key("INT64", -(2**63), -1, 0, 1, 2**53, 2**53 + 1, 2**63 - 1), key("INT32", 0, 5, -2, -1, Type="Int", isSigned=False),
        key("DOUBLE", -math.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 2.0, math.inf), key("BYTE_ARRAY", b"", b"\0", b"a", b"a\0", b"b", "ä".encode(), b"\xff", Type="String"),
        key("FIXED_LEN_BYTE_ARRAY", *(v.to_bytes(16, "big", signed=True) for v in (-(10**37), -1, 0, 7, 10**37)), scale=3, Type="Decimal"), key("BOOLEAN", False, True),
    ]
    for keys in rising:
        assert all(a < b for a, b in itertools.pairwise(keys))
    assert key("DOUBLE", -0.0) == key("FLOAT", 0.0) and key("DOUBLE", math.nan) == key("INT96", b"0" * 12) == key("INT64", None) == [None]
    assert key("INT64", 1000, Type="Timestamp", timeUnit="microseconds") == key("INT64", 1, Type="Timestamp", timeUnit="milliseconds")
    assert key("INT32", 150, scale=2, Type="Decimal") == key("INT64", 1500, scale=3, Type="Decimal")


def test_sort_order_of_every_type(spark, tmp_path):
    high = 2**53
    columns = {
        "long": [high + 2, high + 1, high + 4, high + 3], "text": ["a", "b", "ba", "bb"], "down": ["d", "c", "b", "a"], "amount": [decimal.Decimal("-5.01"), decimal.Decimal("-5.00"), decimal.Decimal("3"), decimal.Decimal("10")],
        "day": [dt.date(2020, 1, k) for k in (4, 3, 2, 1)], "none": pa.nulls(4, pa.string()), "flag": [False, False, True, True],
    }
    pq.write_table(pa.table(columns), tmp_path / "f.parquet", row_group_size=1)
    with api.Dataset(spark, str(tmp_path)) as data:
        got = {r["column_name"]: (r["sort_order"], round(r["confidence"], 3)) for r in data.sort_order().collect()}
    assert got == {
        "long": ("unsorted", 0.333), "text": ("ascending", 1.0), "down": ("descending", 0.0), "amount": ("ascending", 1.0), "day": ("descending", 0.0), "flag": ("ascending", 1.0),
    }


def test_overlapping_groups_are_unsorted(spark, tmp_path):
    pq.write_table(pa.table({"x": [0.0, 9.0, 1.0, 8.0, 2.0, 7.0]}), tmp_path / "f.parquet", row_group_size=2)
    with api.Dataset(spark, str(tmp_path)) as data:
        assert [tuple(r) for r in data.sort_order().collect()] == [("x", "unsorted", 0.0)]
        assert [tuple(r) for r in data.sort_order(strict=False).collect()] == [("x", "descending", 0.0)]


def test_mixed_folders(spark, tmp_path):
    tree(tmp_path)
    assert {(r["y"], r["m"]) for r in read(spark, str(tmp_path)).collect()} == {("1", "02"), ("1", None), ("2", None), (None, None)}
    kept = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    assert read(spark, str(tmp_path / "y=1" / "m=02")).columns == ["a"] and spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == kept


def test_first_rows_stop_early(spark, tmp_path):
    many_groups(tmp_path / "b.parquet", 60, 100)
    many_groups(tmp_path / "a.parquet", 60, 100)
    with api.Dataset(spark, str(tmp_path)) as data:
        tasks = spark.sparkContext.defaultParallelism
        rows, looked = data.first_rows("id >= 250 AND id < 5990", 10)
        assert [r["id"] for r in rows.collect()] == list(range(250, 260)) and looked == tasks
        rows, looked = data.first_rows("id >= 5850", 200)
        assert [r["id"] for r in rows.collect()] == [*range(5850, 6000), *range(5850, 5900)] and rows.columns == data.rows_frame().columns
        assert looked <= 4 and data.first_rows("id = 17", 5)[0].count() == 2
        assert data.first_rows("id < 0", 5)[0].collect() == [] and data.first_rows("id > 0", 0) [0].collect() == []


def test_columns_with_dots_are_filtered(spark):
    df = spark.createDataFrame([(1, (2,)), (3, (4,))], "`a.b` int, s struct<c:int>")
    assert [r["a.b"] for r in api.filter_rows(df, "a.b > 1").collect()] == [3] and api.filter_rows(df, "s.c = 2").count() == 1
