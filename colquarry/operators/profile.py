"""Column profiles.

A profile of all columns takes two scans, however many columns there are: one fills mergeable states (see ``states``), one
counts values and bins of all columns as rows (column, bin, value). What asks for a few statistics of a kind only is an
aggregation for every few columns; the wide row is turned into a row per column by inline(array(struct)). NaN is left
out of numeric statistics.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars as S
from .states import FLAGS, State, column_states, kind, merged, quoted

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_QUANTILE_NAMES = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")
#: Columns that go into one aggregation. Each aggregation reads its own columns only, so more of them read nothing
#: twice; with more columns in one its generated code outgrows what gets compiled.
COLUMNS_AT_ONCE = 2
#: Registers of the sketch of distinct values, as a power of two: an error of 0.65 %.
DISTINCT_BITS = 14
TOP_N, TOP_MOST_DISTINCT = 20, 10_000


def kinds(df: DataFrame, columns: list[str] | None = None) -> dict[str, T.DataType]:
    """The profiled columns with their types; names that aren't there are passed over."""
    return {f.name: f.dataType for f in df.schema if columns is None or f.name in columns}


def _of(df: DataFrame, columns: list[str] | None, test) -> list[str]:
    return [c for c, t in kinds(df, columns).items() if test(t)]


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _of(df, columns, lambda t: isinstance(t, T.NumericType))


def string_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _of(df, columns, lambda t: isinstance(t, T.StringType))


def boolean_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _of(df, columns, lambda t: isinstance(t, T.BooleanType))


def temporal_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return _of(df, columns, lambda t: isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)))


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _number(c: str) -> Column:
    d = _q(c).cast("double")
    return F.when(~F.isnan(d), d)


def per_column(df: DataFrame, columns: list[str], statistics) -> DataFrame:
    """A row (column_name, statistics(name)...) for each column, from one aggregation for every few columns."""
    out: DataFrame | None = None
    for a in range(0, len(columns), COLUMNS_AT_ONCE):
        part = columns[a : a + COLUMNS_AT_ONCE]
        named = [(c, statistics(c)) for c in part]
        wide = df.agg(*(x.alias(f"_{i}_{k}") for i, (_, stats) in enumerate(named) for k, x in stats.items()))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"_{i}_{k}").alias(k) for k in stats)) for i, (c, stats) in enumerate(named)))
        long = wide.select(F.inline(rows))
        out = long if out is None else out.union(long)
    if out is None:
        raise ValueError("no column of this kind")
    return out


NUMERIC = ("count", "mean", "stddev", "min", "max", "skewness", "kurtosis", *_QUANTILE_NAMES)


def _numeric(c: str, statistics: tuple[str, ...]) -> dict[str, Column]:
    x = _number(c)
    moments = {"count": F.count(x), "mean": F.avg(x), "stddev": F.stddev_pop(x), "min": F.min(x), "max": F.max(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x)}
    wanted = [q for q, n in zip(QUANTILES, _QUANTILE_NAMES) if n in statistics]
    out = {k: v if k == "count" else F.coalesce(v, F.lit(0.0)) for k, v in moments.items() if k in statistics}
    return out | ({"_at": F.percentile_approx(x, wanted, 10_000)} if wanted else {})


#: Share of the values on each side of an exact quantile that are told apart, ten times the error of the sketch.
_ASIDE = 0.001


def _exact_quantiles(df: DataFrame, columns: list[str], wanted: list[float]) -> DataFrame:
    """column_name and _at, the quantiles interpolated over all values (null without any).

    A sketch gives bounds around each quantile; how many values lie below and within them is counted, and only the values
    within are told apart and ranked, a few of a thousand. Bounds that miss the ranks give way to all values."""
    around = [min(max(q + aside, 0.0), 1.0) for aside in (-_ASIDE, _ASIDE) for q in wanted]
    bounds = lambda c: {"n": F.count(_number(c)), "at": F.percentile_approx(_number(c), around, 10_000)}
    found = {r["column_name"]: r for r in per_column(df, columns, bounds).collect() if r["n"]}  # a row for each column
    spark, places = df.sparkSession, []
    names = spark.createDataFrame([(c,) for c in columns], "column_name string")
    if not found:
        return names.withColumn("_at", F.lit(None).cast("array<double>"))
    ends = lambda c: list(zip(found[c]["at"], found[c]["at"][len(wanted) :]))
    counts = lambda c: {k: v for i, (low, high) in enumerate(ends(c)) for k, v in ((f"b{i}", F.count_if(_number(c) < low)), (f"w{i}", F.count_if(_number(c) <= high)))}
    for r in [per_column(df, [c], counts).first() for c in found]:
        c = r["column_name"]
        for i, (low, high) in enumerate(ends(c)):
            at, before = (found[c]["n"] - 1) * wanted[i], r[f"b{i}"]
            if before > math.floor(at) or r[f"w{i}"] <= math.ceil(at):
                low, high, before = float("-inf"), float("inf"), 0
            places.append((c, i, low, high, before, at))
    inside = lambda c: functools.reduce(lambda a, b: a | b, (_number(c).between(low, high) for k, _, low, high, *_ in places if k == c))
    values = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(inside(c), _number(c)).alias("x")) for c in found)))).where("x is not null")
    tally = values.groupBy("column_name", "x").agg(F.count("*").alias("n"))
    near = tally.join(F.broadcast(spark.createDataFrame(places, "column_name string, i int, low double, high double, before long, at double")), "column_name").where(F.col("x").between(F.col("low"), F.col("high")))
    ranked = near.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("column_name", "i").orderBy("x")))
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    pairs = ranked.groupBy("column_name", "i", "at").agg(first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    return names.join(pairs.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("_at")), "column_name", "left")


def _quantiles(at: Column, statistics: tuple[str, ...]) -> list[Column]:
    names = [n for n in _QUANTILE_NAMES if n in statistics]
    return [F.coalesce(F.get(at, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None, exact_quantiles: bool = False, statistics: tuple[str, ...] = NUMERIC) -> DataFrame:
    """column_name and the ``statistics`` (count, mean, stddev, min, max, skewness, excess kurtosis, p1 .. p99) of the
    numeric columns; what isn't asked for isn't computed.

    Population moments; 0 for shape statistics of a constant, and for all of them without values. Quantiles come
    from a bounded sketch (percentile_approx); ``exact_quantiles`` interpolates over all values instead, in more
    scans, which are made at once."""
    numeric, wanted = numeric_columns(df, columns), [q for q, n in zip(QUANTILES, _QUANTILE_NAMES) if n in statistics]
    if exact_quantiles and wanted and numeric:
        others = tuple(n for n in statistics if n not in _QUANTILE_NAMES)
        wide = _exact_quantiles(df, numeric, wanted)
        wide = per_column(df, numeric, lambda c: _numeric(c, others)).join(wide, "column_name") if others else wide
    else:
        wide = per_column(df, numeric, lambda c: _numeric(c, statistics))
    kept = [c for c in wide.columns if c != "_at"]
    return wide.select(*kept, *(_quantiles(F.col("_at"), statistics) if "_at" in wide.columns else []))


def _string(c: str) -> dict[str, Column]:
    x, n = _q(c), F.count(_q(c))
    share = lambda p: S.percentage(F.count_if(x.rlike(p)), n)
    size = F.octet_length(x)
    return {
        "count": n, "empty_count": F.count_if(x == ""), "whitespace_count": F.count_if(x.rlike(S.BLANK)), "min_length": F.coalesce(F.min(size), F.lit(0)),
        "max_length": F.coalesce(F.max(size), F.lit(0)), "mean_length": F.coalesce(F.avg(size), F.lit(0.0)), "numeric_pct": share(S.NUMERIC),
        "email_pct": share(S.EMAIL), "uuid_pct": share(S.UUID), "iso_date_pct": share(S.ISO_DATE),
    }


def string_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, empty_count, whitespace_count, min/max/mean length in bytes and the shares of four patterns in %."""
    return per_column(df, string_columns(df, columns), _string)


def _boolean(c: str) -> dict[str, Column]:
    x = _q(c)
    return {"true_count": F.count_if(x), "false_count": F.count_if(~x), "null_count": F.count_if(x.isNull()), "true_pct": S.percentage(F.count_if(x), F.count(x))}


def boolean_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return per_column(df, boolean_columns(df, columns), _boolean)


def _temporal(c: str, kind: T.DataType) -> dict[str, Column]:
    ms = S.epoch_ms(_q(c), kind)
    low, high = F.min(ms), F.max(ms)
    return {"count": F.count(ms), "null_count": F.count_if(_q(c).isNull()), "min_ms": low, "max_ms": high, "range_days": ((high - low) / 86_400_000.0)}


def temporal_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    types = kinds(df)
    return per_column(df, temporal_columns(df, columns), lambda c: _temporal(c, types[c]))


def year_distribution(df: DataFrame, column: str, calendar: bool = False) -> DataFrame:
    """Rows per year; years of 365.25 days from 1970 unless ``calendar``."""
    year = F.year(_q(column)) if calendar else S.approximate_year(S.epoch_ms(_q(column), df.schema[column].dataType))
    return df.where(_q(column).isNotNull()).groupBy(year.alias("year")).agg(F.count("*").alias("count")).orderBy("year")


def approx_distinct(*columns: Column) -> Column:
    """Distinct non-null values by a sketch, which is one binary field of an aggregation."""
    known = F.when(columns[0].isNotNull(), F.xxhash64(*columns)) if len(columns) == 1 else F.xxhash64(*columns)  # of several, whole rows
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(known, F.lit(DISTINCT_BITS))), F.lit(0).cast("long"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Distinct non-null values of each column, by a HyperLogLog sketch or exactly."""
    count = F.count_distinct if exact else approx_distinct
    return per_column(df, list(kinds(df, columns)), lambda c: {"distinct_count": count(_q(c))})


def _value_counts(df: DataFrame, few: Iterable[str], bins: dict[str, tuple[float, float, int, float]]) -> DataFrame:
    """column_name and items, the list of (bin, value, count): of the columns in ``few`` every value, with its bin if
    there are ``bins`` (low, high, number, width) for the column; of other columns with bins the bins alone.

    One aggregation of rows (column, bin, value) of all these columns, combined before the shuffle: its keys are fewer than the
    most distinct values allowed, or the bins, of each column."""
    names = list(dict.fromkeys([*few, *bins]))
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, items array<struct<bin:int,value:string,count:bigint>>")
    number = lambda v: f"CAST('{v!r}' AS DOUBLE)"

    def place(c: str) -> str:
        if c not in bins:
            return "CAST(NULL AS INT)"
        x, (low, _, n, width) = f"CAST({quoted(c)} AS DOUBLE)", bins[c]
        at = f"CAST(least(floor(({x} - {number(low)}) / {number(width)}), {n - 1}) AS INT)" if n > 1 else "0"
        return f"CASE WHEN abs(nullif({x}, {number(float('nan'))})) < {number(float('inf'))} THEN {at} END"

    text = lambda c: f"CAST({quoted(c)} AS STRING)" if c in few else "CAST(NULL AS STRING)"
    few = set(few)
    each = "array(" + ", ".join(f"struct({k} AS k, {place(c)} AS bin, {text(c)} AS value)" for k, c in enumerate(names)) + ")"
    counts = df.select(F.expr(f"inline({each})")).where("bin is not null or value is not null").groupBy("k", "bin", "value").agg(F.count("*").alias("count"))
    name = F.get(F.array(*map(F.lit, names)), F.col("k"))
    return counts.groupBy(name.alias("column_name")).agg(F.collect_list(F.struct("bin", "value", "count")).alias("items"))


def _first_values(items: Column, n: int) -> Column:
    """(rank, value, count, percentage) of the ``n`` most frequent values, ties by value."""
    values = F.filter(items, lambda x: x["value"].isNotNull())
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x["count"])
    order = F.slice(F.array_sort(F.transform(values, lambda x: F.struct((-x["count"]).alias("minus"), x["value"].alias("value")))), 1, n)
    return F.transform(order, lambda x, i: F.struct((i + 1).alias("rank"), x["value"].alias("value"), (-x["minus"]).alias("count"), S.percentage(-x["minus"], total).alias("percentage")))


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = TOP_N, most_distinct: int = TOP_MOST_DISTINCT) -> DataFrame:
    """The ``n`` most frequent values of each column with fewer than ``most_distinct`` values: column_name, value,
    count, percentage (of non-null values) and rank; ties by value. Columns that have too many values by the sketch
    are left out, so what is ranked has a bound."""
    chosen = list(kinds(df, columns))
    if not chosen:
        raise ValueError("no column of this kind")
    few = [r["column_name"] for r in distinct_counts(df, chosen).collect() if r["distinct_count"] < most_distinct]
    return _value_counts(df, few, {}).select("column_name", F.inline(_first_values(F.col("items"), n))).select("column_name", "value", "count", "rank", "percentage")


def _finite_of(x: Column) -> Column:
    d = x.cast("double")
    return F.when(F.abs(F.nullif(d, F.lit(float("nan")))) < float("inf"), d)


def _finite(c: str) -> Column:
    return _finite_of(_q(c))


def _bins(low: float, high: float, bins: int) -> tuple[int, float]:
    """Number and width of the bins; the difference of two finite numbers may be infinite, their halves' isn't."""
    bins = 1 if high - low < 2.220446049250313e-16 else bins
    return bins, (high / bins - low / bins) if high - low == float("inf") else (high - low) / bins


def _bin(x: Column, low: float, bins: int, width: float) -> Column:
    place = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int") if bins > 1 else F.lit(0)
    return F.when(x.isNotNull(), place)  # least passes over nulls


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] of the finite values, the last one closed; one bin if they are all equal; none
    without any. Infinite values and NaN belong to no bin."""
    if bins < 1:
        raise ValueError("a histogram needs a bin")
    x = df.select(_finite(column).alias("x")).where("x is not null")
    edges = x.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    spark = df.sparkSession
    if edges["low"] is None:
        return spark.createDataFrame([], "bin int, low double, high double, count long")
    low, high = edges["low"], edges["high"]
    bins, width = _bins(low, high, bins)
    counts = x.groupBy(_bin(F.col("x"), low, bins, width).alias("bin")).agg(F.count("*").alias("count"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(low) + k * F.lit(width)
    return every.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), (F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(edge(F.col("bin") + 1))).alias("high"), F.coalesce("count", F.lit(0)).alias("count")
    )


def string_length_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Bins of whole byte lengths, of width (max - min) div bins, 1 at least; the last one takes the rest."""
    if bins < 1:
        raise ValueError("a histogram needs a bin")
    x = df.select(F.octet_length(_q(column)).cast("long").alias("x")).where("x is not null")
    edges = x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    first = edges.first()
    spark = df.sparkSession
    if first["low"] is None:
        return spark.createDataFrame([], "bin int, low long, high long, count long")
    low, width = first["low"], max(1, (first["high"] - first["low"]) // bins)
    counts = x.groupBy(F.least(F.expr(f"(x - {low}L) div {width}L"), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    start = F.lit(low) + F.col("bin").cast("long") * width
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", start.alias("low"), (start + width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


_KINDS = {
    "numeric": [("count", "long"), *((k, "double") for k in NUMERIC if k != "count")],
    "string": [(k, "long") for k in ("count", "empty_count", "whitespace_count", "min_length", "max_length")] + [(k, "double") for k in ("mean_length", "numeric_pct", "email_pct", "uuid_pct", "iso_date_pct")],
    "boolean": [("true_count", "long"), ("false_count", "long"), ("null_count", "long"), ("true_pct", "double")],
    "temporal": [("count", "long"), ("null_count", "long"), ("min_ms", "long"), ("max_ms", "long"), ("range_days", "double")],
}
_PROFILE = "column_name string, type string, row_count long, null_count long, distinct_count long, " + ", ".join(
    f"{k} struct<{','.join(f'{n}:{t}' for n, t in like)}>" for k, like in _KINDS.items()
) + ", _low double, _high double"


def _moments(state: State) -> dict:
    """count, mean, stddev, min, max, skewness and excess kurtosis; 0 for what has no value."""
    n, (mean, m2, m3, m4) = state.sums["numbers"], state.moments
    shaped = n > 0 and m2 != 0
    return {
        "count": n, "mean": mean, "stddev": (m2 / n) ** 0.5 if n else 0.0, "min": state.bounds["least"] or 0.0, "max": state.bounds["most"] or 0.0,
        "skewness": n**0.5 * m3 / m2**1.5 if shaped else 0.0, "kurtosis": n * m4 / m2**2 - 3 if shaped else 0.0,
    }


def _described(state: State, name: str, t: T.DataType) -> dict:
    """A column's row of the profile, but for histogram and top values."""
    of, sums, bounds = kind(t), state.sums, state.bounds
    share = lambda k, n: 100.0 * sums[k] / n if n else 0.0
    out = {"column_name": name, "type": t.simpleString(), "row_count": sums["row_count"], "null_count": sums["null_count"], "_low": bounds["low"], "_high": bounds["high"]}
    out["distinct_count"] = None if isinstance(t, (T.MapType, T.VariantType)) else state.distinct.estimate()
    if of == "numeric":
        out["numeric"] = _moments(state) | dict(zip(_QUANTILE_NAMES, state.quantiles.at(QUANTILES)))
    elif of == "string":
        n = sums["texts"]
        out["string"] = {
            "count": n, **{k: sums[k] for k in FLAGS[:2]}, "min_length": bounds["text_least"] or 0, "max_length": bounds["text_most"] or 0, "mean_length": sums["text_bytes"] / n if n else 0.0,
            **{f"{k}_pct": share(k, n) for k in FLAGS[2:]},
        }
    elif of == "boolean":
        out["boolean"] = {"true_count": sums["true_count"], "false_count": sums["false_count"], "null_count": sums["null_count"], "true_pct": share("true_count", sums["true_count"] + sums["false_count"])}
    elif of == "temporal":
        low, high = bounds["time_least"], bounds["time_most"]
        out["temporal"] = {"count": sums["times"], "null_count": sums["null_count"], "min_ms": low, "max_ms": high, "range_days": None if low is None else (high - low) / 86_400_000.0}
    return out


def described(states: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    """A row for each merged state of ``states``, and one for each column without any: the profile but for counts of values."""
    schema = T._parse_datatype_string(_PROFILE)
    arrow = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_described(State.of(r), r["column"], fields[r["column"]]) for r in batch.to_pylist()], schema=arrow)

    spark = states.sparkSession
    empty = spark.createDataFrame([_described(State(), c, t) for c, t in fields.items()], schema)
    found = states.mapInArrow(run, schema)
    return found.unionByName(empty).groupBy("column_name").agg(*(F.max_by(c, "row_count").alias(c) for c in schema.names[1:]))


def _first_pass(df: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    """A row for each column with every statistic of it, in one scan."""
    if not fields:
        raise ValueError("no column of this kind")
    return described(merged(column_states(df, fields).drop("unit"), df.rdd.getNumPartitions()), fields)


def profile(df: DataFrame, columns: list[str] | None = None, bins: int = 30, top: int = TOP_N, most_distinct: int = TOP_MOST_DISTINCT) -> DataFrame:
    """A row for each column: column_name, type, row_count, null_count, distinct_count (by a sketch; null for maps);
    numeric, string, boolean and temporal, of which the one of its type is there; histogram (low, high, count of each
    bin, of numeric columns with finite values) and top_values (value, count, rank and percentage, of columns with
    fewer than ``most_distinct`` values).

    Two scans at any number of columns: one for every statistic, which comes to the driver as a row for each column, and one for
    bins and values of the columns that have them."""
    fields = kinds(df, columns)
    return _with_values(df, _first_pass(df, fields), bins, top, most_distinct)


def _with_values(df: DataFrame, found: DataFrame, bins: int, top: int, most_distinct: int) -> DataFrame:
    spark, schema = df.sparkSession, found.schema
    rows = found.collect()  # a row for each column
    first = spark.createDataFrame(rows, schema)
    plan = {r["column_name"]: (r["_low"], r["_high"], *_bins(r["_low"], r["_high"], bins)) for r in rows if r["_low"] is not None}
    few = [r["column_name"] for r in rows if r["distinct_count"] is not None and 0 < r["distinct_count"] < most_distinct]
    made = _value_counts(df, few, plan)
    edges = [(c, [(k, low + k * width, high if k == n - 1 else low + (k + 1) * width) for k in range(n)]) for c, (low, high, n, width) in plan.items()]
    out = first.join(spark.createDataFrame(edges, "column_name string, _edges array<struct<bin:int,low:double,high:double>>"), "column_name", "left").join(made, "column_name", "left")
    inside = lambda e: F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] == e["bin"], x["count"]).otherwise(F.lit(0)))
    bars = F.transform("_edges", lambda e: F.struct(e["low"].alias("low"), e["high"].alias("high"), inside(e).alias("count")))
    top_ = F.when(F.col("column_name").isin(few), _first_values(F.col("items"), top))
    return out.withColumns({"histogram": bars, "top_values": top_}).select(*(c for c in first.columns if not c.startswith("_")), "histogram", "top_values")
