"""Connected components of an edge table, by local contraction and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, arrow_batches

_EDGE = {"a": pa.int64(), "b": pa.int64()}
_NODE = {"node": pa.int64(), "component": pa.int64()}


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest one that these edges reach, but for that one itself."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        now = least.copy()
        np.minimum.at(now, i, least[j])
        np.minimum.at(now, j, least[i])
        now = now[now]
        if (now == least).all():
            break
        least = now
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def _contracted(most: int = 1 << 20):
    """Edges of the same components, in stars as far as some ``most`` edges at a time tell."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(a) for a, _ in held) >= most:
                yield arrow_batches(_EDGE, dict(zip("ab", stars(*map(np.concatenate, zip(*held))))))
                held = []
        if held:
            yield arrow_batches(_EDGE, dict(zip("ab", stars(*map(np.concatenate, zip(*held))))))

    return run


def _labelled(batches) -> Iterator[pa.RecordBatch]:
    """Every node of a task's edges with the smallest one reached."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        nodes, least = stars(*map(np.concatenate, zip(*held)))
        roots = np.unique(least)
        yield arrow_batches(_NODE, {"node": np.concatenate([nodes, roots]), "component": np.concatenate([least, roots])})


def components(edges: DataFrame, tables: Tables | None = None, most: int = 1 << 20) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of long): the smallest node reached; a stored
    table, of ``tables`` if they are given. A node with no edge but loops is left out.

    Up to ``most`` edges are told by one task. Of more, tasks first contract the edges they read, ``most`` at a time,
    into stars. Then each round hangs neighbours onto the smallest node they see; rounds are logarithmic in the longest
    path that is left, each is a stored table, and no node's neighbours are ever gathered in one place: the smallest
    neighbour is an aggregate, joined back. An empty table gives an empty result; loops are allowed, null ends are not."""
    rounds, tables = Tables(edges.sparkSession), tables or Tables(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    if (number := edges.count()) <= most:
        return tables.store(edges.coalesce(1).mapInArrow(_labelled, "node long, component long"), "components")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def contract(df: DataFrame, n: int) -> DataFrame:
        """As few tasks as hold ``most`` edges each: the more of a component one sees, the fewer rounds follow."""
        few = df.select("a", "b").coalesce(max(1, -(-n // most)))
        return rounds.store(few.mapInArrow(_contracted(most), "a long, b long"), "edges")

    now = contract(edges, number)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lower, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = rounds.store(hung.union(lower.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        if (after := state(small)) == state(now):
            break
        now = contract(small, after[0])
        rounds.drop_others(now)
    pairs = small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(small.select(F.col("b").alias("node"), F.col("b").alias("component")))
    found = tables.store(pairs.distinct(), "components")
    rounds.drop_others()
    return found
