"""Paths: resolving files, directories, globs and object-store locations; Hive partitions; configuration."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STORE = re.compile(r"^(?P<scheme>s3a?|gs)://(?P<bucket>[^/]+)/?(?P<key>.*)$")


def parse_store_uri(uri: str) -> tuple[str, str, str] | None:
    """(scheme, bucket, key) of an s3:// or gs:// location, else None."""
    m = _STORE.match(uri)
    return (m["scheme"], m["bucket"], m["key"]) if m else None


def readable(path: str) -> str:
    """The form that Hadoop's file systems know."""
    return re.sub(r"^s3://", "s3a://", path)


LISTING = "path string, size long, modified timestamp, partitions map<string,string>"
_GLOB = re.compile(r"[*?\[{]")


def _glob_pattern(path: str) -> str:
    """A pattern for what a glob names, of Hadoop's kind: nothing but ``**`` is missing there, too."""
    out, depth, at = "", 0, 0
    while at < len(path):
        ch = path[at]
        if ch == "[" and "]" in path[at + 1 :]:
            end = path.index("]", at + 1)
            inner = path[at + 1 : end]
            out += f"[{'^' + inner[1:] if inner[:1] in '!^' else inner}]"
            at = end
        elif ch == "\\" and at + 1 < len(path):
            out += re.escape(path[at + 1])
            at += 1
        else:
            depth += (ch == "{") - (ch == "}")
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(ch) or ("|" if ch == "," and depth else re.escape(ch))
        at += 1
    return out


def _partitions(rest: Column) -> Column:
    """The k=v folders of a path below a base as a map; an empty key or value is passed over, of equal keys the last counts."""
    folders = F.filter(F.split(rest, "/"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(folders, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    known = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    return F.map_from_entries(F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda q: q["key"] == p["key"])))


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified and partitions of the Parquet files that a file, directory or glob names.

    Spark's own file index lists them, in a job where there are many folders, when this is called; the table is read by tasks. Directories
    are searched to the bottom for names ending in .parquet, and only they have partitions; names that begin with a dot or an
    underscore are passed over. Nothing found is an empty table. Any file system that Hadoop knows will do."""
    where = readable(path)
    own = spark.newSession()  # its settings are its relations' alone: files are dealt by number, as nothing of them is read
    own.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 60))
    own.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    reader = own.read.format("binaryFile").option("recursiveFileLookup", "true")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    base = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    glob = _GLOB.search(where)
    try:
        found = reader.load(where)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    # a path with the name of the file or glob itself was asked for by name; all others lie below a folder that was
    named = F.col("path").rlike(f"^{_glob_pattern(base)}$") if glob else F.col("path") == base
    rest = F.regexp_replace("path", f"^{_glob_pattern(base)}/" if glob else f"^{re.escape(base)}/", "")
    rest = F.regexp_replace(rest, "[^/]*$", "")
    listing = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(named, F.create_map().cast("map<string,string>")).otherwise(_partitions(rest)).alias("partitions"))
    return listing.where(named | F.endswith("path", F.lit(".parquet")))


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, dict[str, str]]]:
    """(path, size, partitions) of ``resolve``, by path, on the driver; for few files."""
    return sorted((r["path"], r["size"], r["partitions"]) for r in resolve(spark, path).collect())


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a dataset; unknown column names are passed over.

    Of a directory, the files below it to the bottom whose names end in .parquet, with the values of k=v folders as
    strings. Where all files lie in folders of the same keys, Spark reads these as partitions and prunes by them; else
    the values are taken from each row's path."""
    where = readable(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df = None
    if not _GLOB.search(where) and fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory():
        base = fs.makeQualified(hadoop).toString().rstrip("/")
        folders = F.split(F.regexp_replace(F.regexp_replace("path", f"^{re.escape(base)}/", ""), "/?[^/]*$", ""), "/")
        keys_of = F.transform(F.filter(folders, lambda x: x != ""), lambda x: F.when(F.contains(x, F.lit("=")), F.substring_index(x, "=", 1)))
        orders = [tuple(r[0]) for r in resolve(spark, path).select(keys_of).distinct().limit(2).collect()]
        if orders:
            reader = spark.read.option("pathGlobFilter", "*.parquet")
            flat = reader.option("recursiveFileLookup", "true").parquet(where)
            if len(orders) == 1 and None not in orders[0]:
                # with types given, Spark infers none for the folders' values
                types = T.StructType([f for f in flat.schema if f.name not in orders[0]] + [T.StructField(k, T.StringType()) for k in orders[0]])
                df = spark.read.option("pathGlobFilter", "*.parquet").schema(types).parquet(where)
            else:
                keys = [r[0] for r in resolve(spark, path).select(F.explode(F.map_keys("partitions"))).distinct().collect() if r[0] not in flat.columns]
                df = flat.withColumns(partition_columns(F.col("_metadata.file_path"), sorted(keys))) if keys else flat
    df = spark.read.parquet(where) if df is None else df
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that are read again: in ``spark.checkpoint.dir``, which a cluster shares; where that is
    unset and one process does all, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='colquarry-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def decoded_path(path: Column, encoded: bool = True) -> Column:
    """The path of a file in one form, from a row's ``_metadata.file_path`` or, not ``encoded``, as listings give it."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(plain, "^file:/+", "file:/")


def partition_columns(file_path: Column, keys: list[str]) -> dict[str, Column]:
    """The values of Hive partition keys, from the path that a row came from."""
    return {k: F.nullif(F.regexp_extract(decoded_path(file_path), rf"/{re.escape(k)}=([^/]+)/", 1), F.lit("")) for k in keys}


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """The first rows, every cell as text."""
    return df.limit(n).select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in df.columns))


def config_path() -> str:
    """COLQUARRY_CONFIG if it is set, else config.json in the platform's folder for settings."""
    if given := os.environ.get("COLQUARRY_CONFIG"):
        return given
    home = os.path.expanduser("~")
    base = {"darwin": os.path.join(home, "Library", "Application Support"), "win32": os.environ.get("APPDATA", home)}.get(sys.platform)
    return os.path.join(base or os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config"), "colquarry", "config.json")


@dataclass
class Config:
    """Settings of a user; unknown keys of a file are passed over."""

    max_rows_preview: int = 100
    histogram_bins: int = 30
    large_file_bytes: int = 1 << 30
    full_scan_timeout_secs: int | None = None
    watch_interval_secs: int = 30
    s3_endpoint: str | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        path = path or config_path()
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})

    def save(self, path: str | None = None) -> None:
        path = path or config_path()
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)

    def apply(self, spark: SparkSession) -> None:
        if self.s3_endpoint:
            spark.sparkContext._jsc.hadoopConfiguration().set("fs.s3a.endpoint", self.s3_endpoint)
