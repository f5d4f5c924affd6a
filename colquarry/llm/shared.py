"""What the operators share: tables in the cluster's shared folder, Arrow helpers, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that is unset and driver and
    executors are one process (tests, a laptop) it is a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="colquarry-"))
    return _OWN_DIR[0]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class Tables:
    """The intermediate tables of one run of one operator, in the shared folder.

    ``store`` writes a frame once as Parquet and returns the stored table. That cuts the lineage: later jobs read
    files that every executor sees, so a lost executor costs a re-read, and work that two jobs need is done once.
    Spark removes the shuffle files of such a write at its end. ``drop`` deletes tables that nothing reads any
    more; those that a returned frame still reads go when the application ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """``by``: the last columns, which name the folders of the table."""
        path = f"{shared_dir(self.spark)}/colquarry/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        files, hadoop = _hadoop(self.spark, path)
        files.deleteOnExit(hadoop)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((stored, path))
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for _, path in (x for x in self.held if any(x[0] is t for t in tables)):
            files, hadoop = _hadoop(self.spark, path)
            files.delete(hadoop, True)
            files.cancelDeleteOnExit(hadoop)
        self.held = [x for x in self.held if all(x[0] is not t for t in tables)]

    def drop_others(self, *kept: DataFrame) -> None:
        self.drop(*(t for t, _ in self.held if all(t is not k for k in kept)))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A stored table that stays until the application ends."""
    return Tables(df.sparkSession).store(df, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_batches(columns: dict[str, pa.DataType], rows: dict[str, object]) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in ((rows[k], t) for k, t in columns.items())]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


# ---------------------------------------------------------------------------------------------
# Word hashing over the UTF-8 bytes of an Arrow column

M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & M64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = random64(256, 11)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = random64(1 << 12, 12) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = random64(1 << int(n - 1).bit_length(), 12) | np.uint64(1)
    return _PLACE


def text_chunks(column: pa.Array, most_bytes: int = 1 << 21):
    """Cut a string column into runs of rows of about ``most_bytes`` (a longer text is a run of its
    own): yields (first row, bytes, offsets from 0). A null is an empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + most_bytes, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_hashes(raw: np.ndarray, off: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of several texts, A-Z lower-cased; or of the maximal runs of bytes
    that aren't ``outside``.

    Returns (hashes in order, bounds): text i has the words bounds[i]:bounds[i + 1]."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~outside[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1]
    heads = heads[heads < len(raw)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = np.cumsum(begins) - 1
    place = np.arange(len(raw)) - starts[np.maximum(word, 0)]
    place[~inside] = 0
    value = _BYTE[raw] * _places(int(place.max()) + 1)[place]
    value[~inside] = 0
    hashes = mix64(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, off).astype(np.int64)


def text_runs(texts: list[str], most: int = 1 << 20):
    """(first, end) of runs of texts with about ``most`` characters; a longer text is a run of its own."""
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def crc32_bucket(column: str, buckets: int) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % buckets
