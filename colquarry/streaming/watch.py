"""Watching a dataset: new files as a stream, or polling for changes; and runs with a time limit."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, recompute: Callable[[DataFrame, int], None], checkpoint: str, log: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Call ``recompute(all rows of the dataset, batch)`` whenever files have been added, and log each reload.

    The source sees new files; for files rewritten in place use ``poll``. Without an ``interval`` what is there
    now is processed and the query ends."""
    schema = spark.read.parquet(path).schema

    def batch(new: DataFrame, number: int) -> None:
        recompute(spark.read.schema(schema).parquet(path), number)
        if log:
            new.agg(F.count("*").alias("new_rows")).select(F.lit(number).alias("batch"), F.current_timestamp().alias("at"), "new_rows").write.mode("append").parquet(log)

    stream = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()


def history(log: DataFrame, n: int = 20) -> DataFrame:
    """The last reloads, newest first."""
    return log.orderBy(F.desc("at"), F.desc("batch")).limit(n)


def poll(state: Callable[[], object], interval: float = 30.0, rounds: int | None = None) -> Iterator[object]:
    """Yield what ``state`` returns (a row count, say) each time that it differs from before."""
    last, k = object(), 0
    while rounds is None or k < rounds:
        if k:
            time.sleep(interval)
        now, k = state(), k + 1
        if now != last:
            yield now
        last = now


class TimedOut(TimeoutError):
    pass


def with_timeout(spark: SparkSession, seconds: float, work: Callable[[], object], tag: str | None = None) -> object:
    """Run ``work``; after so many seconds its jobs are cancelled and TimedOut is raised. There are no partial
    results: a task can't hand over half of an aggregate."""
    context, fired, tag = spark.sparkContext, threading.Event(), tag or f"colquarry-{uuid.uuid4().hex}"

    def stop() -> None:
        fired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if fired.is_set():
            raise TimedOut(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
