"""Best-fit packing of documents into sequences of a fixed number of tokens, planned on a length histogram.

The histogram of piece lengths has at most ``capacity`` rows, however many documents there are. Best fit
runs over its counts on the driver: all pieces of one length are placed at once into runs of sequences with
equal room. The plan names, for each length, which ranks go to which sequences. A piece then finds its slot
by its rank within its length, which comes from a count per (length, bucket) and a rank inside the bucket,
so no task orders all pieces of a common length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, materialize
from .vocabulary import default_path, load, words_of


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.

    Returns rows (length, first rank, pieces, first sequence, pieces per sequence, offset): the pieces of
    that length with ranks from the first on fill the sequences from the first on, so many in each, side by
    side from the offset on."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: list[int] = []  # the rooms that some sequence has, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    sequences = 0

    def keep(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in runs:
                runs[space] = []
                room.insert(bisect_left(room, space), space)
            runs[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(room, length)
            if k == len(room):
                space, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                space = room[k]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], room[k]
            each = space // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - space))
                keep(space - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            used = full
            if left and full < n:
                rows.append((length, rank, left, first + full, left, capacity - space))
                keep(space - left * length, first + full, 1)
                used, left = full + 1, 0
            keep(space, first + used, n - used)
    return rows


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    from .vocabulary import PATTERN

    v = load(path)
    ranks = {piece: i for i, piece in v.pieces.items() if i not in v.special.values()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special), v


#: White space of this length goes past tiktoken, whose pattern takes stack for each character of it.
_LONG_SPACE = re.compile(r"(?<!\s)\s{65536}")


def encode(path: str, text: str) -> list[int]:
    """The ids that the tokenizers library gives for the vocabulary file, without special tokens added."""
    encoding, v = _encoding(path)
    if len(text) > 65536 and _LONG_SPACE.search(text):
        merged = lru_cache(maxsize=1 << 16)(v.merge)
        parts = ([v.special[x]] if k % 2 else (i for w in words_of(x) for i in merged(w.encode())) for k, x in enumerate(v.segments(text)))
        return [i for part in parts for i in part]
    if any(x in text for x in v.special):
        return encoding.encode(text, allowed_special="all")
    return encoding.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: pieces of ``capacity``, a shorter one first."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    out = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        out["ids"] = pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in out]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(path, text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    values = (doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32))
                    for to, value in zip(rows, values):
                        to.append(value)
            yield arrow_batches(out, dict(zip(out, rows)))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T._parse_datatype_string(schema))


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, rows_per_bucket: int = 50_000
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    A document is its ids and the end id; a null or empty text is the end id alone. One row per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for). Rows that share a
    doc_id are documents of their own. An empty table gives an empty result. A null doc_id stays null. A very long
    text is cut into pieces of ``capacity``, of which the first may be shorter.
    Columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, tokenizer_path or default_path(), capacity, end_id, with_ids), "pieces")
    buckets = max(1, -(-made.count() // rows_per_bucket))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    counts = made.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = spark.createDataFrame(
        plan(histogram, capacity), "length long, first_rank long, n_pieces long, first_sequence long, each long, first_offset long"
    )
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = made.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    k = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(planned, "length")
        .where((F.col("rank") >= F.col("first_rank")) & (k < F.col("n_pieces")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
            F.expr("first_sequence + (rank - first_rank) div each").alias("sequence_id"),
            (F.col("first_offset") + k % F.col("each") * F.col("length")).alias("offset"),
        )
    )
