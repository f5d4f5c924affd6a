"""A quality classifier: a convolutional network over bytes, in numpy.

Bytes have learned vectors, and filters of eight bytes slide over all of a text. A chunk is 256 places and overlaps the next by
half; the last one ends with the text, so all of it is covered. Of each filter a chunk keeps the highest value, so a chunk that says the same again and
again has few high values. A hidden layer reads these, its units are max-pooled over the chunks, and one sum of them
gives the probability. Text runs through in slabs of blocks of 128 places, so memory doesn't grow with a text but for the blocks' maxima.

The network is fitted on the driver on a sample of labelled rows that is bounded in rows and in blocks of each, by gradients
derived by hand; everything is scored in tasks, which get the network of some 20 KB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, text_chunks

BLOCK = 128  # places; a chunk is two blocks
WIDTH, VECTOR, FILTERS, HIDDEN = 8, 8, 32, 16
_PAD = 256
_SLAB = 128  # blocks
#: Labelled rows to learn from, about half of each class, and blocks of each row.
SAMPLE_ROWS, SAMPLE_BLOCKS = 4096, 16


@dataclass
class Network:
    """vectors: of each byte and of none; filters, offsets: the convolution; hidden, shift: from a chunk's maxima and its share of places;
    last: from the pooled units; bias: log odds without evidence."""

    vectors: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    hidden: np.ndarray
    shift: np.ndarray
    last: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        vectors = draw(_PAD + 1, VECTOR, by=0.5)
        vectors[_PAD] = 0
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(vectors, draw(WIDTH * VECTOR, FILTERS, by=0.2), zeros(FILTERS), draw(FILTERS + 1, HIDDEN, by=0.2), zeros(HIDDEN), draw(HIDDEN, by=0.3), zeros(1))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def convolved(self, tokens: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """The filters' values at each place of some blocks; lowest where the text has no place any more."""
        x = np.ascontiguousarray(self.vectors[tokens]).reshape(len(tokens), -1)
        seen = np.lib.stride_tricks.as_strided(x, (len(tokens), BLOCK, WIDTH * VECTOR), (x.strides[0], VECTOR * 4, 4))
        out = (np.ascontiguousarray(seen).reshape(-1, WIDTH * VECTOR) @ self.filters).reshape(len(tokens), BLOCK, FILTERS)
        short = np.flatnonzero(valid < BLOCK)
        out[short] = np.where(np.arange(BLOCK)[None, :, None] < valid[short, None, None], out[short], np.float32(-1e30))
        return out

    def maxima(self, tokens: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.maximum(self.convolved(tokens, valid).max(axis=1) + self.offsets, 0)

    def logits(self, maxima: np.ndarray, valid: np.ndarray, left: np.ndarray, right: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log odds of each text, whose chunks begin at ``begins`` and are the blocks left and right."""
        pre = chunk_inputs(maxima, valid, left, right) @ self.hidden + self.shift
        return np.maximum.reduceat(np.maximum(pre, 0), begins, axis=0) @ self.last + self.bias


def chunk_inputs(maxima: np.ndarray, valid: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    places = valid[left] + np.where(right > left, valid[right], 0)
    return np.column_stack([np.maximum(maxima[left], maxima[right]), (places / (2 * BLOCK)).astype(np.float32)])


def layout(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each block and its first place in the text; every text has one block at least."""
    n = np.maximum(1, -(-np.diff(off) // BLOCK))
    text = np.repeat(np.arange(len(n)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK


def blocks(raw: np.ndarray, off: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of these blocks with those that the last places look ahead at, and how many places each has."""
    n = np.diff(off)[text]
    place = start[:, None] + np.arange(BLOCK + WIDTH - 1)
    padded = np.append(raw, np.uint8(0))
    tokens = np.where(place < n[:, None], padded[np.minimum(off[text][:, None] + place, len(raw))], np.uint16(_PAD))
    return tokens.astype(np.uint16), np.clip(n - start, 1, BLOCK)


def chunks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left block, right block, first chunk of each text) for blocks in the order of their texts. A text of one block is one chunk."""
    last = np.append(text[1:] != text[:-1], True)
    alone = last & np.append(True, text[1:] != text[:-1])
    left = np.flatnonzero(~last | alone)
    return left, left + ~alone[left], np.flatnonzero(np.append(True, text[left][1:] != text[left][:-1]))


def texts_logits(network: Network, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    text, start = layout(off)
    maxima, valid = np.empty((len(text), FILTERS), np.float32), np.empty(len(text), np.int64)
    for a in range(0, len(text), _SLAB):
        tokens, valid[a : a + _SLAB] = blocks(raw, off, text[a : a + _SLAB], start[a : a + _SLAB])
        maxima[a : a + _SLAB] = network.maxima(tokens, valid[a : a + _SLAB])
    return network.logits(maxima, valid, *chunks(text))


def gradients(network: Network, tokens: np.ndarray, valid: np.ndarray, left: np.ndarray, right: np.ndarray, begins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, Network]:
    """The weighted mean log loss of a batch and its derivatives. What was pooled away has none."""
    values = network.convolved(tokens, valid)
    highest = values.max(axis=1) + network.offsets
    maxima = np.maximum(highest, 0)
    inputs = chunk_inputs(maxima, valid, left, right)
    units = np.maximum(inputs @ network.hidden + network.shift, 0)
    pooled = np.maximum.reduceat(units, begins, axis=0)
    logit = pooled @ network.last + network.bias
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - label * logit)))
    d_logit = (weight * (1 / (1 + np.exp(-logit)) - label) / len(label)).astype(np.float32)
    # each pooled unit comes from the first chunk that has it
    text = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(left))))
    chunk, unit = np.nonzero((units == pooled[text]) & (units > 0))
    _, first = np.unique(text[chunk] * HIDDEN + unit, return_index=True)
    chunk, unit = chunk[first], unit[first]
    d_units = np.zeros_like(units)
    d_units[chunk, unit] = d_logit[text[chunk]] * network.last[unit]
    d_inputs = (d_units @ network.hidden.T)[:, :FILTERS]
    from_right = maxima[right] > maxima[left]
    d_maxima = np.zeros_like(maxima)
    np.add.at(d_maxima, left, np.where(from_right, 0, d_inputs))
    np.add.at(d_maxima, right, np.where(from_right, d_inputs, 0))
    d_maxima[highest <= 0] = 0
    some = np.flatnonzero(d_maxima.any(axis=1))
    place = values[some].argmax(axis=1)
    block, f = np.nonzero(d_maxima[some])
    d, first = d_maxima[some[block], f], place[block, f]
    seen = tokens[some[block][:, None], first[:, None] + np.arange(WIDTH)]
    d_filters = np.zeros((FILTERS, WIDTH * VECTOR), np.float32)
    np.add.at(d_filters, f, d[:, None] * network.vectors[seen].reshape(len(d), -1))
    d_vectors = np.zeros_like(network.vectors)
    np.add.at(d_vectors, seen.ravel(), (d[:, None] * network.filters.T[f]).reshape(-1, VECTOR))
    d_vectors[_PAD] = 0
    return loss, Network(
        d_vectors, np.ascontiguousarray(d_filters.T), d_maxima.sum(axis=0), inputs.T @ d_units, d_units.sum(axis=0), pooled.T @ d_logit, d_logit.sum(keepdims=True)
    )


def trained(texts: list[np.ndarray], labels: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 0.004, seed: int = 3) -> Network:
    """Adam over shuffled batches; both classes weigh alike. A text is its blocks (rows of bytes, then the number of places), as
    ``_sampled`` gives them."""
    weights = (len(labels) / 2 / np.bincount(labels, minlength=2)).astype(np.float32)[labels]
    network, r = Network.random(seed), np.random.default_rng(seed)
    mean, square = ([np.zeros_like(x) for x in network.arrays()] for _ in range(2))
    step = 0
    while step < steps:
        order = r.permutation(len(texts))
        for a in range(0, min(len(order), (steps - step) * batch), batch):
            of = order[a : a + batch]
            rows = np.concatenate([texts[k] for k in of])
            text = np.repeat(np.arange(len(of)), [len(texts[k]) for k in of])
            _, change = gradients(network, rows[:, :-1], rows[:, -1].astype(np.int64), *chunks(text), labels[of].astype(np.float32), weights[of])
            step += 1
            pace = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, g, m, s in zip(network.arrays(), change.arrays(), mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                x -= (pace * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return network


def _sampled(batches) -> Iterator[pa.RecordBatch]:
    """Labelled rows with all their blocks, or with a sample of neighbouring pairs of them where there are more than SAMPLE_BLOCKS."""
    for batch in batches:
        for first, raw, off in text_chunks(batch.column("text")):
            text, start = layout(off)
            bounds = np.searchsorted(text, np.arange(len(off)))
            out = []
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                at = np.arange(a, b)
                if len(at) > SAMPLE_BLOCKS:
                    pairs = np.random.default_rng(int(b - a)).choice(len(at) - 1, SAMPLE_BLOCKS // 2, replace=False)
                    at = a + np.sort(np.concatenate([pairs, pairs + 1]))
                tokens, valid = blocks(raw, off, text[at], start[at])
                out.append(np.column_stack([tokens, valid]).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(first, len(out)), pa.array(out, pa.binary())], names=["quality", "blocks"])


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the rows, by their ids; and those without an id, which can have no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> Network:
    """The network, learned from the rows of ``labels`` (doc_id, quality 0 or 1) that aren't held out.

    Some ``sample_rows`` / 2 of each class, or all where there are fewer, are chosen by a hash of their ids; the bias then makes up for
    the share of the classes in all labels. A document with several labels is good if none says otherwise, a doc_id with several texts has the least.
    Without labels of both classes the network knows no evidence and gives the share of good labels, a half without any."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    total = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect() if r["quality"] in (0, 1)}
    bad, good = total.get(0, 0), total.get(1, 0)
    prior = float(np.log((good + 0.5) / (bad + 0.5)))
    empty = Network.random(seed)
    empty.last[:], empty.bias[:] = 0, prior
    if not bad or not good:
        return empty
    most = F.when(F.col("quality") == 1, min(1.0, sample_rows / 2 / good)).otherwise(min(1.0, sample_rows / 2 / bad)) * (1 << 20)
    chosen = known.where("quality in (0, 1)").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < most)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # some sample_rows ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
    found = rows.mapInArrow(_sampled, "quality int, blocks binary").toArrow()
    texts, label = found.column("blocks").to_pylist(), found.column("quality").to_numpy()
    order = sorted(range(len(texts)), key=lambda k: (texts[k], label[k]))  # not that of the tasks
    label = label[order]
    if not len(label) or label.min() == label.max():
        return empty
    network = trained([np.frombuffer(texts[k], "<u2").reshape(-1, BLOCK + WIDTH) for k in order], label, seed=seed)
    network.bias += np.float32(prior)
    return network


_OUT = {"doc_id": pa.int64(), "score": pa.float64()}


def scores(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score, the probability that the text is good, of every row.

    Nothing but the text is read. A null or empty text is one chunk without a place, a text of any length is read whole. A null doc_id stays null,
    repeated rows are kept and score alike, an empty table gives an empty result. Columns other than doc_id and text are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, off in text_chunks(batch.column("text"), 1 << 20):
                logit = texts_logits(shared.value, raw, off).astype(np.float64)
                yield arrow_batches(_OUT, {"doc_id": batch.column("doc_id").slice(first, len(logit)), "score": 1 / (1 + np.exp(-np.clip(logit, -500, 500)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (never learned from), score and predicted (1 from ``threshold`` on) of every row."""
    return scores(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
