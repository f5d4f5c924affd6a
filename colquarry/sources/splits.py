"""Row groups as splits: tasks read the row groups that they are given, by their indexes, and nothing else of a file.

A task reads the footer and the chosen columns' chunks of its row groups, in batches, so what is read follows what is
chosen. Files that only Hadoop can open are read by Spark, whose rows are then told apart by their place in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .paths import decoded_path
from .stores import Opener, Options, in_tasks, opened, options

#: Bytes (uncompressed) of the row groups that a task takes, about.
TASK_BYTES = 256 << 20
_BATCH_ROWS = 1 << 16


def conformed(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The columns of a schema in its types, null where the batch has none; what it has besides is left out."""
    have = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    columns = []
    for f in schema:
        x = have.get(f.name)
        columns.append(pa.nulls(batch.num_rows, f.type) if x is None else x if x.type == f.type else _cast(x, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _cast(x: pa.Array, to: pa.DataType) -> pa.Array:
    # a time without a zone in the file is one in UTC, and finer times lose what Spark can't hold
    return x.cast(to, safe=not pa.types.is_timestamp(to))


#: A row's place: the index of its row group among all, and its place inside.
PLACE = T.StructType([T.StructField("_group", T.LongType()), T.StructField("_row", T.LongType())])


def _placed(batch: pa.RecordBatch, group: int, first: int) -> pa.RecordBatch:
    place = [pa.repeat(pa.scalar(group, pa.int64()), batch.num_rows), pa.array(range(first, first + batch.num_rows), pa.int64())]
    return pa.RecordBatch.from_arrays([*batch.columns, *place], names=[*batch.schema.names, *PLACE.names])


def _reader(schema: T.StructType, given: Options, opener: Opener, placed: bool):
    arrow = to_arrow_schema(schema)

    def read(batches) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        path = file = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = row["path"], pq.ParquetFile(opener(row["path"], given), pre_buffer=False, coerce_int96_timestamp_unit="us")
                wanted = [c for c in file.schema_arrow.names if c in arrow.names]
                n, first = file.metadata.row_group(row["row_group"]).num_rows, 0
                if wanted:
                    parts = (conformed(x, arrow) for x in file.iter_batches(_BATCH_ROWS, row_groups=[row["row_group"]], columns=wanted, use_threads=False))
                else:
                    parts = iter([pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in arrow], schema=arrow)])
                for part in parts:
                    yield _placed(part, row["index"], first) if placed else part
                    first += part.num_rows
        if file is not None:
            file.close()

    return read


def _by_place(spark: SparkSession, groups: DataFrame, schema: T.StructType, placed: bool) -> DataFrame:
    """For files that tasks can't open: all their rows, without those outside the groups."""
    paths = [r["path"] for r in groups.select("path").distinct().collect()]
    names = [F.col(f"`{f.name}`") for f in schema]
    rows = spark.read.schema(schema).parquet(*paths).select(*names, decoded_path(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.row_index").alias("_row"))
    ranges = groups.groupBy(decoded_path(F.col("path"), False).alias("_path")).agg(F.collect_list(F.struct("first_row", (F.col("first_row") + F.col("num_rows")).alias("end"), (F.col("index") if placed else F.lit(0)).alias("index"))).alias("_ranges"))
    own = F.filter("_ranges", lambda x: (F.col("_row") >= x["first_row"]) & (F.col("_row") < x["end"]))
    found = rows.join(ranges, "_path").withColumn("_own", F.get(own, F.lit(0))).where("_own is not null")
    return found.select(*names, *([F.col("_own.index").cast("long").alias("_group"), (F.col("_row") - F.col("_own.first_row")).alias("_row")] if placed else []))


def read_row_groups(
    spark: SparkSession, groups: DataFrame, schema: T.StructType | None = None, columns: list[str] | None = None, task_bytes: int = TASK_BYTES, opener: Opener = opened, placed: bool = False
) -> DataFrame:
    """The rows of chosen row groups.

    ``groups``: path, row_group, first_row, num_rows and total_byte_size of each. ``schema``: the rows' (that of the first file if not given);
    ``columns``: those of it to read; ``placed``: with each row's place, by the ``index`` of the row groups. Row groups of a file that
    follow each other go to one task as far as its bytes reach."""
    facts = groups.agg(F.count("*").alias("n"), F.sum("total_byte_size").alias("bytes"), F.min("path").alias("path"), F.max("path").alias("last")).first()
    if schema is None:
        schema = spark.read.parquet(facts["path"]).schema if facts["n"] else T.StructType([])
    schema = schema if columns is None else T.StructType([f for f in schema if f.name in columns])
    if not facts["n"]:
        return spark.createDataFrame([], T.StructType([*schema, *(PLACE if placed else [])]))
    if opener is opened and not (in_tasks(facts["path"]) and in_tasks(facts["last"])):
        return _by_place(spark, groups, schema, placed)
    tasks = max(1, min(facts["n"], max(spark.sparkContext.defaultParallelism, -(-(facts["bytes"] or 0) // task_bytes))))
    dealt = groups.select("path", "row_group", *(["index"] if placed else [])).repartitionByRange(tasks, "path", "row_group").sortWithinPartitions("path", "row_group")
    return dealt.mapInArrow(_reader(schema, options(spark), opener, placed), T.StructType([*schema, *(PLACE if placed else [])]))
