"""Parquet footers as tables: a row per file, row group, column chunk and leaf column.

The footers are read by tasks over the listing: a task opens local files and objects of stores by itself and reads the last
bytes of each. Of other file systems, which only Hadoop can open, the driver fetches the last bytes in many threads, wave by wave, and
a wave's footers are stored before the next. A footer's tables come from pyarrow; the schema's tree and the bloom filters, which it
doesn't show, from the footer's bytes.
"""

from __future__ import annotations

import datetime
import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .paths import resolve, scratch_folder
from .stores import Opener, Options, in_tasks, last_bytes, opened, options
from .thrift import Reader

FILE = "path string, file_size long, row_count long, row_group_count int, created_by string, version string, key_values map<string,string>, error string"
GROUP = "index int, num_rows long, total_byte_size long, compressed_size long, offsets array<long>, sizes array<long>"
CHUNK = (
    "row_group int, leaf_path string, column_name string, physical_type string, null_count long, distinct_count long, min string, max string, min_exact decimal(38,18), "
    "max_exact decimal(38,18), min_number double, max_number double, min_micros long, max_micros long, min_key binary, max_key binary, uncompressed_size long, compressed_size long, codec string, encodings array<string>, has_column_index boolean, has_offset_index boolean, has_bloom_filter boolean"
)
LEAF = "position int, leaf_path string, column_name string, physical_type string, logical_type string, repetition string, max_def_level int, max_rep_level int, holders array<string>"


def _struct(fields: str) -> str:
    parts, depth, name = [], 0, ""
    for ch in fields:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            parts.append(name.strip())
            name = ""
        else:
            name += ch
    parts.append(name.strip())
    return "struct<" + ",".join(p.replace(" ", ":", 1) for p in parts) + ">"


_FOOTER = f"{FILE}, row_groups array<{_struct(GROUP)}>, chunks array<{_struct(CHUNK)}>, leaves array<{_struct(LEAF)}>"


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _text(x: object) -> str | None:
    return None if x is None else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)


def _exact(x: object) -> Decimal | None:
    """Whole numbers and decimals, as far as 20 digits before the point and 18 after it hold them."""
    if isinstance(x, bool) or not isinstance(x, (int, Decimal)):
        return None
    d = Decimal(x)
    return d if d.is_finite() and abs(d) < 10**20 and -d.as_tuple().exponent <= 18 else None


def _micros(x: object) -> int | None:
    if isinstance(x, datetime.datetime):
        zone = datetime.timezone.utc
        return (x.replace(tzinfo=x.tzinfo or zone) - datetime.datetime(1970, 1, 1, tzinfo=zone)) // datetime.timedelta(microseconds=1)
    return (x - datetime.date(1970, 1, 1)).days * 86_400_000_000 if isinstance(x, datetime.date) else None


#: Nanoseconds of a unit of time.
_UNITS = {"milliseconds": 1_000_000, "microseconds": 1_000, "nanoseconds": 1}


def order_key(physical: str, logical: dict, scale: int, raw: object) -> bytes | None:
    """Bytes that are in the order of a leaf's values, from the raw form of a bound: whole numbers and times with the sign turned
    round, decimals at 38 digits behind the point, floating point with its bits turned, text and bytes as they are. None for what has
    no order (NaN, the old form of times in 96 bits, half floats)."""
    kind = logical.get("Type")
    if raw is None or physical == "INT96" or kind == "Float16":
        return None
    if physical == "BOOLEAN":
        return bytes([raw])
    if physical in ("FLOAT", "DOUBLE"):
        if raw != raw:
            return None
        bits = int.from_bytes(struct.pack(">d", raw + 0.0), "big")  # minus zero is zero
        return (bits ^ ((1 << 64) - 1 if bits >> 63 else 1 << 63)).to_bytes(8, "big")
    if kind == "Decimal":
        whole = raw if isinstance(raw, int) else int.from_bytes(raw, "big", signed=True)
        return (whole * 10 ** (38 - scale) + (1 << 263)).to_bytes(33, "big")
    if isinstance(raw, int):
        if kind == "Int" and not logical.get("isSigned", True) and raw < 0:
            raw += 1 << (32 if physical == "INT32" else 64)
        return (raw * _UNITS.get(logical.get("timeUnit"), 1) + (1 << 127)).to_bytes(16, "big")
    return bytes(raw)


class BadFooter(ValueError):
    pass


def tail(read, size: int) -> bytes:
    """A footer with its length and mark, by ``read(n)``, the last n bytes of a file."""
    if size < 12 or (end := read(min(size, 1 << 16)))[-4:] != b"PAR1":
        raise BadFooter("no Parquet file")
    whole = int.from_bytes(end[-8:-4], "little") + 8
    if whole > size:
        raise BadFooter("the footer is longer than the file")
    return end[-whole:] if whole <= len(end) else read(whole)


def footer(path: str, size: int, end: bytes | None = None, error: str | None = None, opener: Opener = opened, given: Options = ()) -> dict:
    """One file's footer; a file that can't be read has only its error."""
    import pyarrow.parquet as pq

    row: dict = {"path": path, "file_size": size, "row_groups": [], "chunks": [], "leaves": []}
    if error:
        return row | {"error": error}
    try:
        if end is None:
            with opener(path, given) as file:
                end = tail(last_bytes(file, size), size)
        return row | _rows(pq.read_metadata(pa.BufferReader(b"PAR1" + end)), Reader(end[:-8]).struct())
    except Exception as e:  # a broken file must not end the scan of the others
        return row | {"error": f"{type(e).__name__}: {e}"[:500]}


#: Repetition types, and the converted and logical types of lists and maps.
_REPETITION = {0: "REQUIRED", 1: "OPTIONAL", 2: "REPEATED"}
_CONVERTED, _LOGICAL = {1: "map", 2: "map", 3: "list"}, {2: "map", 3: "list"}


def leaf_holders(elements: list[dict]) -> list[tuple[str, list[str]]]:
    """(repetition, what holds it from the root on: list, map or struct) of each leaf, from a schema in the order of
    a walk. The repeated group that a list or map consists of counts with it."""
    out, at = [], 0

    def walk(holders: list[str], inner: bool) -> None:
        nonlocal at
        element, at = elements[at], at + 1
        if not element.get(5):
            out.append((_REPETITION.get(element.get(3, 0), "REQUIRED"), holders))
            return
        kind = _CONVERTED.get(element.get(6, -1)) or next((_LOGICAL[k] for k in element.get(10) or {} if k in _LOGICAL), None)
        own = [] if inner else [kind or "struct"]
        for _ in range(element[5]):
            walk(holders + own, bool(kind) and not inner)

    root, at = elements[0], 1
    for _ in range(root.get(5) or 0):
        walk([], False)
    return out


def _rows(meta, told: dict) -> dict:
    groups, chunks, leaves = [], [], []
    schema, tree = meta.schema, leaf_holders(told[2])
    kinds = [json.loads(schema.column(i).logical_type.to_json()) for i in range(len(schema))]
    for i in range(len(schema)):
        c = schema.column(i)
        logical = str(c.logical_type)
        leaves.append({
            "position": i, "leaf_path": c.path, "column_name": c.path, "physical_type": c.physical_type, "logical_type": None if logical == "None" else logical,
            "repetition": tree[i][0], "max_def_level": c.max_definition_level, "max_rep_level": c.max_repetition_level, "holders": tree[i][1],
        })
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        columns = [group.column(i) for i in range(group.num_columns)]
        groups.append({
            "index": g, "num_rows": group.num_rows, "total_byte_size": group.total_byte_size, "compressed_size": sum(c.total_compressed_size for c in columns),
            "offsets": [c.data_page_offset for c in columns], "sizes": [c.total_compressed_size for c in columns],
        })
        blooms = [14 in (x.get(3) or {}) for x in told[4][g][1]]
        for i, (c, bloom) in enumerate(zip(columns, blooms)):
            stats = c.statistics
            bounds = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
            raw = (stats.min_raw, stats.max_raw) if stats is not None and stats.has_min_max else (None, None)
            keys = [order_key(c.physical_type, kinds[i], schema.column(i).scale, x) for x in raw]
            chunks.append({
                "row_group": g, "leaf_path": c.path_in_schema, "column_name": c.path_in_schema, "physical_type": c.physical_type,
                "null_count": stats.null_count if stats is not None and stats.has_null_count else None,
                "distinct_count": stats.distinct_count if stats is not None and stats.has_distinct_count else None,
                "min": _text(bounds[0]), "max": _text(bounds[1]), "min_number": _number(bounds[0]), "max_number": _number(bounds[1]),
                "min_exact": _exact(bounds[0]), "max_exact": _exact(bounds[1]), "min_micros": _micros(bounds[0]), "max_micros": _micros(bounds[1]),
                "min_key": keys[0], "max_key": keys[1],
                "uncompressed_size": c.total_uncompressed_size, "compressed_size": c.total_compressed_size, "codec": c.compression, "encodings": list(c.encodings),
                "has_column_index": c.has_column_index, "has_offset_index": c.has_offset_index, "has_bloom_filter": bloom,
            })
    pairs = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}
    return {
        "row_count": meta.num_rows, "row_group_count": meta.num_row_groups, "created_by": meta.created_by, "version": str(meta.format_version), "key_values": pairs,
        "row_groups": groups, "chunks": chunks, "leaves": leaves,
    }


@dataclass
class Footers:
    """The tables of a dataset's footers. ``files`` includes those that couldn't be read, with an error."""

    spark: SparkSession
    paths: DataFrame
    raw: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.raw.drop("row_groups", "chunks", "leaves")

    @property
    def row_groups(self) -> DataFrame:
        return self.raw.select("path", F.inline("row_groups")).withColumn(
            "compression_ratio", F.when(F.col("compressed_size") > 0, F.col("total_byte_size") / F.col("compressed_size")).otherwise(1.0)
        )

    @property
    def chunks(self) -> DataFrame:
        return self.raw.select("path", F.inline("chunks"))

    @property
    def leaves(self) -> DataFrame:
        return self.raw.select("path", F.inline("leaves"))

    def bloom_filters(self) -> DataFrame:
        """(path, row_group, leaf_path, has_bloom_filter)."""
        return self.chunks.select("path", "row_group", "leaf_path", "has_bloom_filter")


def _tails(spark: SparkSession, paths: list[tuple[str, int]], threads: int = 64) -> list[tuple[str, int, bytes | None, str | None]]:
    """(path, size, last bytes, error) of files that aren't local, through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def one(path: str, size: int) -> tuple[str, int, bytes | None, str | None]:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            file = where.getFileSystem(conf).open(where)
            try:

                def read(n: int) -> bytes:
                    file.seek(size - n)
                    return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(file, n))

                return path, size, tail(read, size), None
            finally:
                file.close()
        except Exception as e:  # a broken file must not end the scan of the others
            return path, size, None, f"{type(e).__name__}: {e}"[:500]

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda x: one(*x), paths))


#: Files whose last bytes the driver holds at once.
WAVE = 2048


def _far(spark: SparkSession, paths: DataFrame, read, schema) -> DataFrame:
    """The footers of files that tasks can't open, stored wave by wave."""
    folder, wave = scratch_folder(spark, "footers"), []
    shape = "path string, size long, tail binary, error string"

    def keep() -> None:
        spark.createDataFrame(_tails(spark, wave), shape).repartition(max(1, len(wave) // 64)).mapInArrow(read, schema).write.mode("append").parquet(folder)
        wave.clear()

    for r in paths.toLocalIterator():
        wave.append((r["path"], r["size"]))
        if len(wave) == WAVE:
            keep()
    if wave:
        keep()
    return spark.read.schema(schema).parquet(folder)


def read_footers(spark: SparkSession, path: str | DataFrame, files_per_task: int = 64, opener: Opener = opened) -> Footers:
    """The footers of what a path names, or of the files of a listing (path, size, partitions). The tables are read again whenever they are
    asked for, unless ``raw`` is kept."""
    paths = resolve(spark, path) if isinstance(path, str) else path
    settings, spark_schema = options(spark), _parse_datatype_string(_FOOTER)
    schema = to_arrow_schema(spark_schema)

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [footer(r["path"], r["size"], r.get("tail"), r.get("error"), opener, settings) for r in batch.to_pylist()]
            rows = [{f.name: r.get(f.name) for f in schema} | {"key_values": list((r.get("key_values") or {}).items())} for r in rows]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    scheme = F.regexp_extract("path", "^([a-z0-9]+):", 1)
    seen = paths.groupBy(scheme.alias("scheme")).agg(F.count("*").alias("n")).collect()
    far = [r["scheme"] for r in seen if opener is opened and not in_tasks(f"{r['scheme'] or 'file'}:/")]
    near = paths.where(~scheme.isin(far)) if far else paths
    n = max(1, -(-sum(r["n"] for r in seen if r["scheme"] not in far) // files_per_task))
    raw = near.select("path", "size").repartition(n).mapInArrow(read, spark_schema)
    if far:
        raw = raw.unionByName(_far(spark, paths.where(scheme.isin(far)).select("path", "size"), read, spark_schema))
    return Footers(spark, paths, raw)
