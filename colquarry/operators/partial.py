"""Profiles that may stop early: row groups in their order, in growing waves, whose states are added up."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.splits import read_row_groups
from ..streaming.watch import TimedOut, with_timeout
from .profile import described
from .states import STATE, State, column_states, merged


def waves(total: int, first: int, factor: int = 2):
    """(begin, end) of runs of row groups, each ``factor`` times as long as the one before."""
    begin = 0
    while begin < total:
        yield begin, min(total, begin + first)
        begin, first = begin + first, first * factor


def limited_profile(
    spark: SparkSession, groups: DataFrame, schema: T.StructType, columns: list[str] | None = None, seconds: float | None = None, row_groups: int | None = None
) -> DataFrame:
    """The profile (without counts of values) of as many row groups as ``seconds`` or a number of ``row_groups`` allow.

    ``groups``: path, row_group, index (their order, from 0), num_rows, total_byte_size. A wave of row groups is one job; what the waves before
    have found is kept when time runs out, and the jobs of the wave at hand are cancelled. With each row come truncated, row_groups and
    total_row_groups, and row_share, the share of all rows that was read. The driver holds one state for each column."""
    fields = {f.name: f.dataType for f in schema if columns is None or f.name in columns}
    if not fields:
        raise ValueError("no column of this kind")
    facts = groups.agg(F.count("*").alias("n"), F.sum("num_rows").alias("rows")).first()
    most = facts["n"] if row_groups is None else min(row_groups, facts["n"])
    until = None if seconds is None else time.monotonic() + seconds
    found: dict[str, State] = {}
    done = rows = 0
    for begin, end in waves(most, spark.sparkContext.defaultParallelism):
        chosen = groups.where((F.col("index") >= begin) & (F.col("index") < end))

        def work(chosen: DataFrame = chosen) -> list:
            read = read_row_groups(spark, chosen, schema, list(fields))
            return merged(column_states(read, fields).drop("unit"), read.rdd.getNumPartitions()).collect()

        try:
            got = work() if until is None else with_timeout(spark, max(0.0, until - time.monotonic()), work) if until > time.monotonic() else None
        except TimedOut:
            got = None
        if got is None:
            break
        with np.errstate(all="ignore"):
            for r in got:
                state = State.of(r.asDict())
                if r["column"] in found:
                    found[r["column"]].merge(state)
                else:
                    found[r["column"]] = state
        done, rows = end, max((s.sums["row_count"] for s in found.values()), default=0)
    states = spark.createDataFrame([s.row(c) for c, s in found.items()], STATE)
    out = described(states, fields).drop("_low", "_high")
    share = rows / facts["rows"] if facts["rows"] else 1.0
    return out.withColumns({"truncated": F.lit(done < facts["n"]), "row_groups": F.lit(done), "total_row_groups": F.lit(facts["n"]), "row_share": F.lit(share)})
