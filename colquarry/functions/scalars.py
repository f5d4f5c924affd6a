"""Scalar rules as Column functions: ratios, pattern tests, writer identification, classes and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What each text pattern means; Unicode digits, and no match before a final line break.
NUMERIC = r"^\p{Nd}+(\.\p{Nd}+)?\z"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
ISO_DATE = r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"
BLANK = r"^\p{IsWhite_Space}+\z"

#: Marks in a writer's name, in order of precedence, with the engine.
ENGINES = (
    (("spark",), "Apache Spark"),
    (("pyarrow", "arrow"), "PyArrow / Apache Arrow"),
    (("duckdb",), "DuckDB"),
    (("impala",), "Apache Impala"),
    (("hive",), "Apache Hive"),
    (("trino", "presto"), "Trino / Presto"),
    (("flink",), "Apache Flink"),
    (("pandas",), "Pandas (via fastparquet or PyArrow)"),
    (("parquet-go", "parquet_go"), "parquet-go"),
    (("parquet4s",), "parquet4s (Scala)"),
)

#: What to look at in files of an engine, by its name.
HINTS = {
    "Apache Spark": ("sort by a filtered column before writing, so that row groups can be skipped", "parquet.bloom.filter.enabled#column serves equality on columns with many values"),
    "PyArrow / Apache Arrow": ("row_group_size counts rows, not bytes: wide tables need fewer", "write_page_index lets readers skip pages"),
    "DuckDB": ("ROW_GROUP_SIZE 122880 is small for scans by many executors",),
    "Apache Impala": ("old versions left bounds out of footers: see the share of columns with bounds",),
    "Apache Hive": ("times may be in the 96-bit form, which has no bounds", "one file for each reducer: see the sizes of files"),
    "Trino / Presto": ("writers scale with data, so files of a partition differ much in size",),
    "Apache Flink": ("a file for each checkpoint: compact them",),
    "Pandas (via fastparquet or PyArrow)": ("a column __index_level_0__ is the frame's index",),
    "parquet-go": ("see whether chunks have bounds and null counts",),
    "parquet4s (Scala)": ("see the codec: files may be uncompressed",),
}


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """A division that gives ``empty`` where the divisor isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * 100.0).otherwise(F.lit(0.0))


def engine(created_by: Column) -> Column:
    """A struct of engine_name, version_hint and hints for a writer's own description of itself."""
    lower = F.lower(created_by)
    none = F.struct(F.lit("Unknown").alias("name"), F.array().cast("array<string>").alias("hints"))
    found = none
    for marks, name in reversed(ENGINES):
        test = F.lit(False)
        for m in marks:
            test = test | F.contains(lower, F.lit(m))
        found = F.when(test, F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, HINTS[name])).alias("hints"))).otherwise(found)
    return F.struct(found["name"].alias("engine_name"), version(created_by).alias("version_hint"), found["hints"].alias("hints"))


def version(created_by: Column) -> Column:
    """What follows the first "version ", else the first "v", as far as digits, dots and hyphens go."""
    after = lambda p: F.nullif(F.regexp_extract(created_by, p, 1), F.lit(""))
    return F.coalesce(after(r"(?i)version ([0-9.-]*)"), after(r"(?i)v([0-9.-]*)"))


def epoch_ms(c: Column, kind: T.DataType) -> Column:
    """Milliseconds since 1970, cut towards zero."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000
    return F.call_function("div", F.unix_micros(c.cast("timestamp")), F.lit(1000))


def approximate_year(ms: Column) -> Column:
    """1970 plus whole years of 365.25 days."""
    return F.lit(1970) + (ms / F.lit(31_557_600_000.0)).cast("int")


def byte_text(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for size, unit in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        out = F.when(n >= size, F.format_string("%.2f " + unit, n / float(size))).otherwise(out)
    return out


def duration_text(ms: Column) -> Column:
    out = F.concat(ms.cast("string"), F.lit("ms"))
    for size, unit in ((1000, "s"), (60_000, "m"), (3_600_000, "h"), (86_400_000, "d")):
        out = F.when(ms >= size, F.format_string("%.1f" + unit, ms / float(size))).otherwise(out)
    return out


def epoch_text(seconds: Column) -> Column:
    """Seconds since 1970 as a date and time in UTC."""
    plain = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.date_format(plain, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


#: The sign that stands for a physical type.
ICONS = {"INT32": "#", "INT64": "#", "FLOAT": "~", "DOUBLE": "~", "BYTE_ARRAY": '"', "FIXED_LEN_BYTE_ARRAY": '"', "BOOLEAN": "?"}


def type_icon(physical: Column) -> Column:
    out = F.lit(".")
    for name, sign in ICONS.items():
        out = F.when(physical == name, F.lit(sign)).otherwise(out)
    return out


def shortened(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def null_bucket(percent: Column) -> Column:
    return F.when(percent < 1, "<1%").when(percent < 25, "<25%").when(percent < 75, "<75%").otherwise(">=75%")


def duplicate_severity(percent: Column) -> Column:
    return F.when(percent > 5, "error").when(percent > 1, "warning").otherwise("ok")


def quality_class(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warning").otherwise("poor")


def type_class(physical: Column, logical: Column) -> Column:
    text = F.upper(F.coalesce(logical, F.lit("")))
    return (
        F.when(text.rlike("TIMESTAMP|DATE|TIME"), "temporal").when(physical == "BOOLEAN", "boolean").when(physical.isin("FLOAT", "DOUBLE"), "float")
        .when(text.rlike("DECIMAL"), "decimal").when(physical.isin("INT32", "INT64", "INT96"), "integer").when(text.rlike("STRING|UTF8"), "string").otherwise("binary")
    )
