"""Statistics of a dataset that follow its files: states are stored for each file, and only files that changed are read."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import described, kinds
from ..operators.states import STATE, column_states, merged
from ..sources.paths import decoded_path, read, resolve

#: Files that one job takes, whose names the driver lists for it.
WAVE = 2048


@dataclass
class Change:
    """Files added, rewritten and deleted since the last look, and the profile of all that are there now."""

    added: int
    rewritten: int
    deleted: int
    profile: DataFrame


class FileStates:
    """The stored states of a dataset's files below ``store``, a folder of its own. Each refresh that finds a change writes a version; a
    reader of the one before isn't disturbed, and a refresh that fails leaves it as it was."""

    def __init__(self, spark: SparkSession, path: str, store: str, columns: list[str] | None = None) -> None:
        self.spark, self.path, self.store, self.columns = spark, path, store.rstrip("/"), columns

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.store}/v=*/_SUCCESS")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def _delete(self, version: int) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.store}/v={version}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _read(self, files: DataFrame, fields: dict[str, T.DataType], to: str) -> None:
        """Append the states of some files (path, size, modified) to a folder, wave by wave."""
        schema, wave = T.StructType([T.StructField(c, t) for c, t in fields.items()]), []

        def keep() -> None:
            rows = self.spark.read.schema(schema).parquet(*(r["path"] for r in wave))
            unit = F.xxhash64(decoded_path(F.col("_metadata.file_path")))
            states = merged(column_states(rows, fields, unit), 1, by=("unit",))
            names = self.spark.createDataFrame(wave, files.schema).withColumn("unit", F.xxhash64(decoded_path(F.col("path"), False)))
            names.join(states, "unit", "left").drop("unit").write.mode("append").parquet(to)
            wave.clear()

        for r in files.toLocalIterator():
            wave.append(r)
            if len(wave) == WAVE:
                keep()
        if wave:
            keep()

    def refresh(self) -> Change:
        """Read the files that are new or whose size or time of change differ, leave out those that are gone, and merge.

        The columns and their types are those of the first refresh; a file without one of them counts its rows as nulls."""
        spark, versions = self.spark, self._versions()
        listing = resolve(spark, self.path).select("path", "size", "modified")
        if versions:
            stored = spark.read.parquet(f"{self.store}/v={versions[-1]}")
            known = stored.select("path", "size", "modified").distinct()
            fields = {c: T._parse_datatype_string(t) for c, t in spark.read.json(f"{self.store}/fields").select("name", "type").orderBy("place").collect()}
        else:
            known = spark.createDataFrame([], listing.schema)
            try:
                fields = kinds(read(spark, self.path), self.columns)
            except AnalysisException:
                fields = {}
            places = [(k, c, t.simpleString()) for k, (c, t) in enumerate(fields.items())]
            spark.createDataFrame(places, "place int, name string, type string").coalesce(1).write.mode("overwrite").json(f"{self.store}/fields")
        old = known.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
        both = listing.join(old, "path", "full").withColumn(
            "change", F.when(F.col("_size").isNull(), "added").when(F.col("size").isNull(), "deleted").when((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "rewritten")
        )
        n = {r["change"]: r["n"] for r in both.where("change is not null").groupBy("change").agg(F.count("*").alias("n")).collect()}
        current = f"{self.store}/v={versions[-1]}" if versions else None
        if n or not versions:
            version = (versions[-1] if versions else 0) + 1
            self._delete(version)  # what a refresh that failed has left
            current = f"{self.store}/v={version}"
            if versions:
                stored.join(both.where("change is null").select("path"), "path", "left_semi").write.mode("append").parquet(current)
            else:
                spark.createDataFrame([], T.StructType([*listing.schema, *T._parse_datatype_string(STATE)])).write.mode("append").parquet(current)
            self._read(both.where("change in ('added', 'rewritten')").select("path", "size", "modified"), fields, current)
            for gone in versions[:-1]:  # the version before stays for those who read it
                self._delete(gone)
        states = spark.read.parquet(current).where("column is not null").drop("path", "size", "modified")
        profile = described(merged(states, max(1, states.count() // max(1, len(fields)))), fields).drop("_low", "_high") if fields else None
        return Change(n.get("added", 0), n.get("rewritten", 0), n.get("deleted", 0), profile)

    def watch(self, interval: float = 30.0, rounds: int | None = None, log: Callable[[Change], None] | None = None) -> Iterator[Change]:
        """Refresh every ``interval`` seconds and yield what has changed."""
        k = 0
        while rounds is None or k < rounds:
            if k:
                time.sleep(interval)
            change, k = self.refresh(), k + 1
            if change.added or change.rewritten or change.deleted:
                if log:
                    log(change)
                yield change
