"""States that merge, profiles that stop early, statistics that follow files."""

import math
import os
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colquarry import api
from colquarry.operators import profile as P
from colquarry.operators.partial import waves
from colquarry.operators.states import Distinct, Quantiles, State, column_states, merged
from colquarry.streaming.incremental import FileStates


def test_ranks_after_many_merges():
    r = np.random.default_rng(4)
    whole, parts = None, [r.lognormal(k % 5, 2, int(r.integers(1, 30_000))) for k in range(150)]
    for values in parts:
        one = Quantiles()
        for piece in np.array_split(values, 3):
            one.add(piece)
        one = Quantiles.unpack(one.pack())
        if whole is None:
            whole = one
        else:
            whole.merge(one)
    every = np.sort(np.concatenate(parts))
    shares = np.linspace(0.001, 0.999, 200)
    assert sum(len(x) << k for k, x in enumerate(whole.levels)) == len(every) and len(whole.pack()) < 64_000
    assert np.abs(np.searchsorted(every, whole.at(shares)) / len(every) - shares).max() < 0.005


def test_few_values_are_exact():
    values = [5.0, 1.0, 3.0, 2.0, 4.0]
    q = Quantiles()
    q.add(np.array(values))
    assert q.at([0.01, 0.2, 0.5, 0.99]) == [1.0, 1.0, 3.0, 5.0] and Quantiles().at([0.5]) == [0.0]


@pytest.mark.parametrize("n", [0, 1, 2000, 2100, 30_000, 60_000, 400_000])
def test_distinct(n):
    r = np.random.default_rng(n)
    hashes = r.integers(0, 2**64, n, dtype=np.uint64)
    a, b, c = Distinct(), Distinct(), Distinct()
    a.add(hashes[: n // 3])
    b.add(hashes[n // 4 :])
    for part in np.array_split(np.concatenate([hashes, hashes]), 7):
        c.add(part)
    a = Distinct.unpack(a.pack())
    a.merge(Distinct.unpack(b.pack()))
    assert a.estimate() == c.estimate() and abs(a.estimate() - n) <= (0 if n <= 2048 else 0.03 * n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6), max_size=30), min_size=1, max_size=8))
def test_moments_of_parts_are_those_of_all(parts):
    whole = State()
    for values in parts:
        one = State()
        one.numbers(np.array(values))
        whole.merge(State.of(one.row("c")))
    x = np.array([v for p in parts for v in p])
    assert whole.sums["numbers"] == len(x)
    if len(x):
        d = x - x.mean()
        scale = max(1.0, np.abs(x).max())
        for k, (got, want) in enumerate(zip(whole.moments, (x.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum())), 1):
            assert abs(got - want) <= 1e-9 * len(x) * scale ** k


def test_many_states_merge_by_a_tree(spark):
    df = spark.range(0, 30_000, 1, 600).select((F.col("id") % 977).alias("a"), F.concat(F.lit("k"), F.col("id") % 5).alias("s"))
    fields = P.kinds(df)
    states = column_states(df, fields).drop("unit")
    got = {r["column_name"]: r for r in P.described(merged(states, 600), fields).collect()}
    assert (got["a"].row_count, got["a"].distinct_count, got["a"].numeric.max, got["s"].distinct_count, got["s"].string.max_length) == (30_000, 977, 976.0, 5, 2)
    assert abs(got["a"].numeric.mean - np.mean(np.arange(30_000) % 977)) < 1e-9


def test_profiles_of_two_hundred_columns_take_two_scans(spark, tmp_path):
    table = pa.table({f"c{k}": [k + x for x in range(50)] if k % 2 else [f"v{x % 7}" for x in range(50)] for k in range(200)})
    pq.write_table(table, tmp_path / "w.parquet")
    df = spark.read.parquet(str(tmp_path / "w.parquet"))
    assert P._first_pass(df, P.kinds(df))._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert P._value_counts(df, ["c0", "c2"], {f"c{k}": (0.0, 300.0, 30, 10.0) for k in range(1, 200, 2)})._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r["column_name"]: r for r in P.profile(df).collect()}
    assert len(got) == 200 and got["c199"].numeric.mean == 199 + 24.5 and got["c198"].top_values[0]["count"] == 8 and sum(b["count"] for b in got["c1"].histogram) == 50


def grouped(path, rows=4000, size=100):
    pq.write_table(pa.table({"id": range(rows), "v": [None if k % 4 == 0 else k / 2 for k in range(rows)], "s": [f"x{k % 10}" for k in range(rows)]}), path, row_group_size=size)


def test_a_limit_of_row_groups(spark, tmp_path):
    grouped(tmp_path / "a.parquet")
    grouped(tmp_path / "b.parquet", 500)
    assert list(waves(10, 2)) == [(0, 2), (2, 6), (6, 10)] and list(waves(0, 4)) == []
    with api.Dataset(spark, str(tmp_path)) as data:
        got = {r["column_name"]: r for r in data.limited_profile(row_groups=7).collect()}
        assert (got["id"].row_count, got["id"].numeric.max, got["v"].null_count, got["s"].distinct_count) == (700, 699.0, 175, 10)
        assert got["id"].truncated and got["id"].row_groups == 7 and got["id"].total_row_groups == 45 and got["id"].row_share == 700 / 4500
        whole = {r["column_name"]: r for r in data.limited_profile(seconds=600).collect()}
        assert not whole["id"].truncated and whole["id"].row_share == 1.0
        full = {r["column_name"]: r for r in P.profile(data.rows_frame()).collect()}
        for c in ("id", "v", "s"):
            assert whole[c].row_count == full[c].row_count and whole[c].null_count == full[c].null_count and whole[c].distinct_count == full[c].distinct_count
        assert math.isclose(whole["v"].numeric.stddev, full["v"].numeric.stddev) and math.isclose(whole["v"].numeric.kurtosis, full["v"].numeric.kurtosis, abs_tol=1e-9)
        none = data.limited_profile(seconds=0).collect()
        assert {r["row_count"] for r in none} == {0} and all(r["truncated"] for r in none) and len(none) == 3


def test_a_time_limit_keeps_what_was_merged(spark, tmp_path, monkeypatch):
    grouped(tmp_path / "a.parquet")
    from colquarry.operators import partial

    real, calls = partial.read_row_groups, []

    def slow(*args):
        calls.append(1)
        rows = real(*args)
        return rows if len(calls) == 1 else rows.where(F.expr("reflect('java.lang.Thread', 'sleep', 3000L) is null"))

    monkeypatch.setattr(partial, "read_row_groups", slow)
    with api.Dataset(spark, str(tmp_path)) as data:
        began = time.monotonic()
        got = data.limited_profile(seconds=20, columns=["id"]).first()
        assert time.monotonic() - began < 60
        assert got.truncated and got.row_groups == spark.sparkContext.defaultParallelism and got.row_count == 100 * got.row_groups and got.numeric.max == got.row_count - 1


def test_statistics_follow_the_files(spark, tmp_path):
    data, store = tmp_path / "data", str(tmp_path / "store")
    data.mkdir()
    r = random.Random(2)

    def write(name, n):
        pq.write_table(pa.table({"id": [r.randint(0, 10**6) for _ in range(n)], "s": [r.choice(["a", "bb", None]) for _ in range(n)]}), data / name)

    for k in range(4):
        write(f"{k} +ä.parquet", 300)
    states = FileStates(spark, str(data), store)

    def compare(change):
        full = {x["column_name"]: x for x in P._first_pass(spark.read.parquet(str(data)), P.kinds(spark.read.parquet(str(data)))).collect()}
        got = {x["column_name"]: x for x in change.profile.collect()}
        for c in full:
            for k in ("row_count", "null_count", "distinct_count", "string"):
                assert got[c][k] == full[c][k], (c, k)
        assert math.isclose(got["id"].numeric.mean, full["id"].numeric.mean) and math.isclose(got["id"].numeric.skewness, full["id"].numeric.skewness, abs_tol=1e-9)

    first = states.refresh()
    assert (first.added, first.rewritten, first.deleted) == (4, 0, 0)
    compare(first)
    write("new.parquet", 50)
    write("1 +ä.parquet", 200)
    (data / "0 +ä.parquet").unlink()
    read, real = [], FileStates._read

    def noted(self, files, *rest):
        read.extend(os.path.basename(x["path"]) for x in files.collect())
        real(self, files, *rest)

    FileStates._read = noted
    try:
        change = states.refresh()
    finally:
        FileStates._read = real
    assert (change.added, change.rewritten, change.deleted) == (1, 1, 1) and sorted(read) == ["1 +ä.parquet", "new.parquet"]
    compare(change)
    assert [(c.added, c.deleted) for c in states.watch(0.01, rounds=2)] == []
    compare(states.refresh())
    (tmp_path / "none").mkdir()
    nothing = FileStates(spark, str(tmp_path / "none"), f"{tmp_path}/store2").refresh()
    assert (nothing.added, nothing.profile) == (0, None)


def test_correlation_in_one_scan(spark):
    from colquarry.operators import stats as A

    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 60)) @ r.normal(size=(60, 60)) + 1e7 * np.arange(60)
    x[:, 7] = 3.25
    x[r.random(x.shape) < 0.2] = np.nan
    x[5, 9] = np.inf
    rows = [[None if np.isnan(v) and k % 2 else float(v) for v in row] for k, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{k}` double" for k in range(60))).repartition(5)
    found = A.correlation(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2
    got = {(p.a, p.b): p.pearson for p in found.collect()}
    assert len(got) == 3600
    for a in range(60):
        for b in range(60):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            want = 1.0 if a == b else 0.0 if 7 in (a, b) or (9 in (a, b) and both[5]) else np.corrcoef(x[both, a], x[both, b])[0, 1]
            assert abs(got[f"c.{a}", f"c.{b}"] - want) < 1e-6, (a, b)
    assert [tuple(p) for p in A.correlation(df.select(F.col("`c.1`").alias("y"))).collect()] == [("y", "y", 1.0)] and A.correlation(df, []).collect() == []
    assert {p.pearson for p in A.correlation(df.limit(0), ["c.1", "c.2"]).collect()} == {0.0, 1.0}


def test_duplicates_shuffle_hashes_and_what_shares_one(spark):
    from colquarry.operators import stats as A

    rows = [(k % 70, f"{k % 70}", None if k % 70 == 3 else 1.5, [k % 70]) for k in range(100)] + [(None, None, None, None)] * 4 + [(None, "", None, None)]
    df = spark.createDataFrame(rows, "`a.b` int, s string, x double, l array<int>").repartition(4)
    got = A.duplicates(df).first()
    assert (got.total_rows, got.duplicate_rows, got.is_exact) == (105, 33, True)
    assert tuple(A.duplicates(df.limit(0)).first())[:3] == (0, 0, 0.0)
    same = spark.range(1000).select(F.lit("x" * 50).alias("t"))
    assert A.duplicates(same).first().duplicate_rows == 999
    plan = A.duplicates(spark.range(0, 1000, 1, 4).select("id", F.repeat(F.lit("x"), 500).alias("t")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
