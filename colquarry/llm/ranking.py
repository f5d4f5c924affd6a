"""Ranked lexical search over a clustered index, exact.

1. The items' terms are the index's vocabulary; nothing else of a document can score. A block of items has a bounded
   number of terms, and there are as many blocks as the items need.
2. Each text becomes its length and the vocabulary's terms in it. A tree from recursive graph bisection, fitted on a sample, gives it
   a leaf; leaves in the tree's order are the new order of documents.
3. A leaf is cut into shards of a bounded number of postings. A shard is a row: its doc_ids, and for each term a posting list of
   (number inside the shard, impact) and the highest impact. Shards that follow each other lie in one folder, a part.
4. The bound of a shard for an item is what a document with all the highest impacts would score. Each item first visits the
   shards of the highest bounds, which gives it a goal: the score of its k-th best document so far. Then those shards
   are visited whose bound reaches the goal; no other can hold a document of the result. Parts without such shards aren't read.

A shard scores by adding up posting lists. Numbers become doc_ids where hits leave the shard, as equal scores go by doc_id.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bisection import Tree, fit
from .shared import Tables, arrow_batches, random64, text_chunks, word_hashes

#: Documents that the tree is fitted on, about, and terms of each.
SAMPLE_ROWS = 8192
SAMPLE_TERMS = 1024
#: Terms of the items of a block, about: with their weights some megabytes that every task gets.
BLOCK_TERMS = 1 << 20
#: Items of a block at most, about: the driver gets FIRST_SHARDS rows and a goal for each.
BLOCK_ITEMS = 1 << 14
SHARD_POSTINGS = 1 << 19
PART_POSTINGS = 1 << 22
FEWEST_PARTS, MOST_PARTS = 24, 8192
#: Shards that each item visits before it has a goal.
FIRST_SHARDS = 4

#: Bytes that no term holds: all of ASCII but letters and digits.
_OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _occurrences(raw: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of each text, counted with repeats; then (text, number in the vocabulary, occurrences), by text and number."""
    hashes, bounds = word_hashes(raw, off, _OUTSIDE)
    n = np.diff(bounds)
    if not len(vocabulary) or not len(hashes):
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    pairs, times = np.unique(np.repeat(np.arange(len(n)), n)[known] * len(vocabulary) + at[known], return_counts=True)
    return n, pairs // len(vocabulary), pairs % len(vocabulary), times


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    """Rows of items with their distinct terms, as signed hashes, and how often each occurs."""
    for batch in batches:
        ids = batch.column("item_id")
        for first, raw, off in text_chunks(batch.column("text")):
            hashes, bounds = word_hashes(raw, off, _OUTSIDE)
            found = [np.unique(hashes[a:b].view(np.int64), return_counts=True) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(found)), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], names=["item_id", "terms", "times"]
            )


@dataclass(frozen=True)
class Items:
    """A block of items. Item k has the terms (numbers in the vocabulary) and weights from begins[k] to begins[k + 1]; no item is
    without terms. A term's weight holds its repeats in the item."""

    begins: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.begins) - 1

    def bounds(self, terms: np.ndarray, tops: np.ndarray, n_terms: int) -> np.ndarray:
        """For each item the score of a document that has the highest impact of each of a shard's terms."""
        top = np.zeros(n_terms, np.int64)
        top[terms] = tops
        return np.add.reduceat(top[self.terms] * self.weights, self.begins[:-1])


def _impacts(times: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10^9 * tf) div (1000 * tf + 8 * m), with m = 25 + (75 * n * N) div L, all whole numbers."""
    if int(n.max(initial=0)) * 75 * documents < 1 << 62:
        m = 25 + 75 * n * documents // max(length, 1)
    else:
        m = np.array([25 + 75 * int(x) * documents // length for x in n.tolist()], np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


_FORWARD = {"doc_id": pa.int64(), "n": pa.int64(), "leaf": pa.int32(), "deal": pa.int64(), "terms": pa.binary(), "times": pa.binary()}


def _forward(docs: DataFrame, shared, tree) -> DataFrame:
    """doc_id, n, leaf, a number to deal the leaf's documents by, and the vocabulary's terms in the text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = shared.value, 0
        for batch in batches:
            ids = batch.column("doc_id")
            for first, raw, off in text_chunks(batch.column("text")):
                n, text, term, times = _occurrences(raw, off, vocabulary)
                leaf = tree.value.leaf(text, term, len(n))
                cuts = np.searchsorted(text, np.arange(len(n) + 1)) * 4
                a, b = term.astype("<u4").tobytes(), times.astype("<u4").tobytes()
                yield arrow_batches(_FORWARD, {
                    "doc_id": ids.slice(first, len(n)), "n": n, "leaf": leaf.astype(np.int32), "deal": (random64(len(n), seen + 1) >> np.uint64(2)).astype(np.int64),
                    "terms": [a[x:y] for x, y in zip(cuts, cuts[1:])], "times": [b[x:y] for x, y in zip(cuts, cuts[1:])],
                })
                seen += 1

    return docs.mapInArrow(run, "doc_id long, n long, leaf int, deal long, terms binary, times binary")


def _sampled(docs: DataFrame, shared) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, term) pairs of about SAMPLE_ROWS documents, SAMPLE_TERMS of each at most, and how many documents."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for _, raw, off in text_chunks(batch.column("text")):
                _, text, term, _ = _occurrences(raw, off, vocabulary)
                mixed = np.lexsort((random64(len(vocabulary), 3)[term], text))
                text, term = text[mixed], term[mixed]
                begins = np.searchsorted(text, np.arange(len(off)))
                yield pa.RecordBatch.from_arrays([pa.array([term[a : min(b, a + SAMPLE_TERMS)].astype("<u4").tobytes() for a, b in zip(begins, begins[1:])], pa.binary())], names=["terms"])

    rows = docs.select("text").sample(share, seed=17) if share < 1 else docs.select("text")
    found = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.mapInArrow(run, "terms binary").toArrow().column("terms").to_pylist()]
    lengths = [len(x) for x in found]
    return np.repeat(np.arange(len(found)), lengths), np.concatenate([np.zeros(0, np.int64), *found]), len(found)


_DOCUMENTS, _LENGTH, _POSTINGS, _HOLDING = range(4)
_SUMS = {"kind": pa.int32(), "key": pa.int64(), "n": pa.int64()}


def _sums(forward: DataFrame, n_terms: int, leaves: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Documents with a term, terms of all, postings of each leaf, documents that hold each term: a row per task and key, added up."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        documents = length = 0
        holding, postings = np.zeros(n_terms, np.int64), np.zeros(leaves, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            data = batch.column("terms").to_pylist()
            holding += np.bincount(np.frombuffer(b"".join(data), "<u4"), minlength=n_terms)
            postings += np.bincount(batch.column("leaf").to_numpy(), weights=[len(x) // 4 for x in data], minlength=leaves).astype(np.int64)
        at, p = np.flatnonzero(holding), np.flatnonzero(postings)
        kind = np.repeat([_DOCUMENTS, _LENGTH, _POSTINGS, _HOLDING], [1, 1, len(p), len(at)])
        yield arrow_batches(_SUMS, {"kind": kind.astype(np.int32), "key": np.concatenate([[0, 0], p, at]), "n": np.concatenate([[documents, length], postings[p], holding[at]])})

    table = forward.select("n", "leaf", "terms").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (table.column(c).to_numpy() for c in ("kind", "key", "n"))
    holding, postings = np.zeros(n_terms, np.int64), np.zeros(leaves, np.int64)
    holding[key[kind == _HOLDING]] = n[kind == _HOLDING]
    postings[key[kind == _POSTINGS]] = n[kind == _POSTINGS]
    return int(n[kind == _DOCUMENTS].sum()), int(n[kind == _LENGTH].sum()), postings, holding


_SHARD = {
    "shard": pa.int64(), "doc_ids": pa.list_(pa.int64()), "terms": pa.binary(), "tops": pa.binary(), "ends": pa.binary(), "numbers": pa.binary(), "impacts": pa.binary(), "part": pa.int32(),
}
_SHARD_TYPES = "shard long, doc_ids array<long>, terms binary, tops binary, ends binary, numbers binary, impacts binary, part int"


def _shard(shard: int, part: int, rows: pa.Table, documents: int, length: int) -> pa.RecordBatch:
    """One row: the shard's documents by ascending doc_id (those without last), posting lists by term."""
    rows = rows.sort_by([("doc_id", "ascending")])
    terms, times = (rows.column(c).to_pylist() for c in ("terms", "times"))
    counts = np.array([len(x) // 4 for x in terms], np.int64)
    term, tf = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (terms, times))
    number = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(term, kind="stable")
    impact = _impacts(tf, np.repeat(rows.column("n").to_numpy(), counts), documents, length)[order]
    distinct, begins = np.unique(term[order], return_index=True)
    tops = np.maximum.reduceat(impact, begins) if len(begins) else impact
    return arrow_batches(_SHARD, {
        "shard": [shard], "doc_ids": pa.ListArray.from_arrays([0, len(counts)], rows.column("doc_id").combine_chunks()),
        "terms": [distinct.astype("<u4").tobytes()], "tops": [tops.astype("<u4").tobytes()], "ends": [np.append(begins, len(order)).astype("<i8").tobytes()],
        "numbers": [number[order].astype("<u4").tobytes()], "impacts": [impact.astype("<u4").tobytes()], "part": [part],
    })


@dataclass(frozen=True)
class Index:
    """shards: the stored table of shards, a folder for each part. holding: documents that hold each term of the vocabulary."""

    shards: DataFrame
    documents: int
    length: int
    holding: np.ndarray

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(self.holding[term]) + 1)))


def build(docs: DataFrame, vocabulary: np.ndarray, tables: Tables, shard_postings: int = SHARD_POSTINGS, part_postings: int = PART_POSTINGS) -> Index:
    """The clustered index of all documents for the terms with these (ascending) hashes."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = context.broadcast(vocabulary)
    document, term, n = _sampled(docs, shared)
    tree: Tree = fit(document, term, n, len(vocabulary))
    forward = tables.store(_forward(docs, shared, context.broadcast(tree)), "forward")
    documents, length, postings, holding = _sums(forward, len(vocabulary), tree.leaves)
    splits = np.maximum(1, -(-postings // shard_postings))
    base = np.cumsum(splits) - splits
    shards = int(splits.sum())
    parts = min(shards, max(FEWEST_PARTS, min(MOST_PARTS, int(postings.sum()) // part_postings)))
    each = -(-shards // parts)

    def of_leaf(values: np.ndarray):
        return F.get(F.array(*(F.lit(int(x)).cast("long") for x in values)), F.col("leaf"))

    dealt = forward.where(F.octet_length("terms") > 0).withColumn("shard", of_leaf(base) + F.col("deal") % of_leaf(splits)).drop("leaf", "deal")
    dealt = dealt.repartitionById(parts, F.expr(f"int(shard div {each})")).sortWithinPartitions("shard")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = -1
        for batch in batches:
            at = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(at, prepend=at[:1] - 1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(at)]):
                if int(at[a]) != shard and held:
                    yield _shard(shard, shard // each, pa.Table.from_batches(held), documents, length)
                    held = []
                shard = int(at[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield _shard(shard, shard // each, pa.Table.from_batches(held), documents, length)

    index = tables.store(dealt.mapInArrow(run, _SHARD_TYPES), "shards", by=["part"])
    tables.drop(forward)
    return Index(index, documents, length, holding)


def _u4(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), "<u4").astype(np.int64)


_BOUND = {"item": pa.int32(), "shard": pa.int64(), "part": pa.int32(), "bound": pa.int64()}


def _first_visits(index: Index, items, n_terms: int, most: int) -> dict[int, list[tuple[int, int]]]:
    """part -> (shard, item) for the shards of the highest bounds of each item: a task names as many of each as are asked for."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        kept = np.zeros((len(block), most, 3), np.int64)  # bound, shard, part
        for batch in batches:
            for shard, part, terms, tops in zip(*(batch.column(c) for c in ("shard", "part", "terms", "tops"))):
                bound = block.bounds(_u4(terms), _u4(tops), n_terms)
                least = kept[:, :, 0].argmin(axis=1)
                better = np.flatnonzero(bound > kept[np.arange(len(block)), least, 0])
                kept[better, least[better]] = np.stack([bound[better], np.full(len(better), shard.as_py()), np.full(len(better), part.as_py())], axis=1)
        item, place = np.nonzero(kept[:, :, 0])
        bound, shard, part = kept[item, place].T
        yield arrow_batches(_BOUND, {"item": item.astype(np.int32), "shard": shard, "part": part.astype(np.int32), "bound": bound})

    named = index.shards.select("shard", "part", "terms", "tops").mapInArrow(run, "item int, shard long, part int, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    out: dict[int, list[tuple[int, int]]] = {}
    for r in named.withColumn("rank", rank).where(F.col("rank") <= most).collect():
        out.setdefault(r["part"], []).append((r["shard"], r["item"]))
    return out


def _parts_left(index: Index, items, goals, n_terms: int) -> list[int]:
    """The parts with a shard whose bound reaches the goal of some item."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = set()
        for batch in batches:
            for part, terms, tops in zip(*(batch.column(c) for c in ("part", "terms", "tops"))):
                if part.as_py() not in parts and (items.value.bounds(_u4(terms), _u4(tops), n_terms) >= goals.value).any():
                    parts.add(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(parts), pa.int32())], names=["part"])

    return [r["part"] for r in index.shards.select("part", "terms", "tops").mapInArrow(run, "part int").distinct().collect()]


_HIT = {"item": pa.int32(), "doc_id": pa.int64(), "score": pa.int64()}


def _visited(shards: DataFrame, items, goals, visits, first: bool, n_terms: int, k: int) -> DataFrame:
    """The k best documents of each item that a task finds: in the shards named for a ``first`` visit, else in all others whose
    bound reaches the item's goal, which rises as the task goes on."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        named: dict[int, set[int]] = {}
        for shard, item in visits.value:
            named.setdefault(shard, set()).add(item)
        goal = goals.value.copy()
        best: list[list[tuple[int, bool, int]]] = [[] for _ in range(len(block))]
        place = np.empty(n_terms, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                column = {c: batch.column(c)[row] for c in ("shard", "doc_ids", "terms", "tops", "ends", "numbers", "impacts")}
                done = named.get(column["shard"].as_py(), set())
                terms, tops = _u4(column["terms"]), _u4(column["tops"])
                wanted = sorted(done) if first else [i for i in np.flatnonzero(block.bounds(terms, tops, n_terms) >= goal).tolist() if i not in done]
                if not wanted:
                    continue
                ids = column["doc_ids"].values
                ends, numbers, impacts = np.frombuffer(column["ends"].as_py(), "<i8"), _u4(column["numbers"]), _u4(column["impacts"])
                place[:] = -1
                place[terms] = np.arange(len(terms))
                for i in wanted:
                    at = slice(block.begins[i], block.begins[i + 1])
                    local = place[block.terms[at]]
                    score = np.zeros(len(ids), np.int64)
                    for t, w in zip(local[local >= 0].tolist(), block.weights[at][local >= 0].tolist()):
                        score[numbers[ends[t] : ends[t + 1]]] += w * impacts[ends[t] : ends[t + 1]]
                    hits = np.flatnonzero(score >= goal[i])
                    if len(hits) > k:
                        hits = hits[np.lexsort((hits, -score[hits]))[:k]]
                    if len(hits):
                        found = [(-s, d is None, d or 0) for s, d in zip(score[hits].tolist(), ids.take(pa.array(hits)).to_pylist())]
                        best[i] = sorted(best[i] + found)[:k]
                        if len(best[i]) == k:
                            goal[i] = max(goal[i], -best[i][-1][0])
        rows = [(i, None if no_id else d, -s) for i, hits in enumerate(best) for s, no_id, d in hits]
        yield arrow_batches(_HIT, dict(zip(_HIT, zip(*rows) if rows else ([], [], []))))

    return shards.mapInArrow(run, "item int, doc_id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, items: Items, n_terms: int, tables: Tables, k: int, first_shards: int = FIRST_SHARDS) -> DataFrame:
    """item (its number in the block), rank, doc_id, score of the k best documents of each item."""
    context = index.shards.sparkSession.sparkContext
    shared = context.broadcast(items)
    visits = _first_visits(index, shared, n_terms, first_shards)
    named = context.broadcast([x for part in visits.values() for x in part])
    scanned = lambda parts: index.shards.where(F.col("part").isin(parts))
    start = np.ones(len(items), np.int64)
    early = tables.store(_best(_visited(scanned(list(visits)), shared, context.broadcast(start), named, True, n_terms, k), k), "early")
    goals = start.copy()
    for r in early.where(F.col("rank") == k).select("item", "score").collect():
        goals[r["item"]] = r["score"]
    held = context.broadcast(goals)
    late = _visited(scanned(_parts_left(index, shared, held, n_terms)), shared, held, named, False, n_terms, k)
    return _best(early.drop("rank").unionByName(late), k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS, first_shards: int = FIRST_SHARDS) -> DataFrame:
    """The k documents that score highest for each item: item_id, rank (from 1), doc_id, score.

    ``docs``: doc_id and text; ``items``: item_id and text. Terms are the maximal runs of ASCII letters and digits and of all
    characters beyond ASCII, with A-Z lower-cased. N documents have a term, L terms in all, n of one; df documents hold a term, tf
    times in one. The score is the sum over the item's terms, repeats included, of floor(1000 * ln((2N + 2) / (2df + 1))) *
    (10^9 * tf div (1000 * tf + 8 * (25 + 75 * n * N div L))). Only scores above 0 count; equal ones go by ascending doc_id.

    A null or empty text has no terms: as a document it scores nothing, as an item it gets no rows, and so does an item that no document
    shares a term with. A text of any length is read whole. Rows with one doc_id are documents of their own, those without an id come last of equal scores;
    rows with one item_id are items of their own. Empty tables give an empty result. Other columns are ignored."""
    spark = docs.sparkSession
    tables = Tables(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    stored = tables.store(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<long>, times array<long>").where(F.size("terms") > 0), "items")
    total = stored.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"), F.count("*").alias("items")).first()
    blocks = max(1, -(-total["terms"] // block_terms), -(-total["items"] // BLOCK_ITEMS))
    read = stored.withColumn("block", F.monotonically_increasing_id() % blocks)  # a stored table's rows: the same each time it is read
    found: DataFrame | None = None
    for number in range(blocks):
        rows = read.where(F.col("block") == number).toArrow().to_pylist()
        if not rows:
            continue
        hashes = np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64)
        vocabulary = np.unique(hashes)
        index = build(docs, vocabulary, tables, shard_postings)
        terms = np.searchsorted(vocabulary, hashes)
        weights = np.array([index.weight(t) for t in range(len(vocabulary))], np.int64)[terms] * np.concatenate([r["times"] for r in rows])
        block = Items(np.cumsum([0, *(len(r["terms"]) for r in rows)]), terms, weights)
        best = search(index, block, len(vocabulary), tables, k, first_shards)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], f"item int, item_id {kind}")
        best = tables.store(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        tables.drop_others(stored, best, *([found] if found is not None else []))
        found = best if found is None else tables.store(found.unionByName(best), "ranked")
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def oracle_sql(k: int = 10) -> str:
    """DuckDB SQL for ranked(documents, benchmark)."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS terms FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
whole AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, whole GROUP BY term, big_n),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)) AS impact FROM p, whole),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {k}"""
