"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie. For each node two things are computed ahead: the failure link, the node that stands
for what remains of the node's string after as many longest-match pieces as are then certain have been taken,
and how many pieces that took. A word is read once, byte by byte: where the trie has no step, the link is
followed and its pieces are counted, so the work is linear in the word's length. Distinct words of a batch
take their steps together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, text_runs
from .vocabulary import default_path, load, words_of

_MOST_BYTES = 64 << 20


class Automaton:
    """keys: node << 8 | byte, sorted; targets: where each leads. links: failure links, -1 for none.
    popped: pieces taken by the link. start: where a word begins; rest: where what follows a piece begins."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes] | None = None) -> None:
        """``continuing``: the pieces that may follow another; None: the same as ``initial``."""
        child: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]

        def grow(root: int, piece: bytes) -> None:
            node = root
            for byte in piece:
                node = child[node].setdefault(byte, len(child))
                if node == len(child):
                    child.append({})
                    ends.append(False)
            ends[node] = True

        for piece in initial:
            if piece:
                grow(0, piece)
        self.start = self.rest = 0
        if continuing is not None:
            self.rest = len(child)
            child.append({})
            ends.append(False)
            for piece in continuing:
                if piece:
                    grow(self.rest, piece)
        links, popped = [-1] * len(child), [0] * len(child)
        level = list(dict.fromkeys([self.start, self.rest]))
        while level:
            following = []
            for node in level:
                for byte, to in child[node].items():
                    following.append(to)
                    if ends[to]:
                        links[to], popped[to] = self.rest, 1
                        continue
                    z, n = links[node], popped[node]
                    while z >= 0 and byte not in child[z]:
                        n += popped[z]
                        z = links[z]
                    links[to], popped[to] = (child[z][byte], n) if z >= 0 else (-1, 0)
            level = following
        steps = sorted((node << 8 | byte, to) for node, out in enumerate(child) for byte, to in out.items())
        self.keys = np.array([*(k for k, _ in steps), 1 << 62], np.int64)  # the last is never met
        self.targets = np.array([*(t for _, t in steps), -1], np.int32)
        self.links, self.popped = np.array(links, np.int32), np.array(popped, np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.targets, self.links, self.popped))

    def counts(self, words: list[bytes], unknown: int = 1) -> np.ndarray:
        """The number of pieces of each word; ``unknown`` where some rest matches no piece; 0 if empty."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        out = np.zeros(n, np.int64)
        live = np.flatnonzero(lengths)
        node, at, count = np.full(len(live), self.start, np.int64), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        while len(live):
            reading = at < lengths[live]
            key = np.where(reading, node << 8 | data[np.minimum(begins[live] + at, len(data) - 1)], -1)
            found = np.searchsorted(self.keys, key)
            step = self.keys[found] == key
            count += np.where(step, 0, self.popped[node])
            node = np.where(step, self.targets[found], self.links[node]).astype(np.int64)
            at += step
            lost = node < 0
            done = lost | ((at == lengths[live]) & (node == self.rest) & ~step)
            if done.any():
                out[live[done]] = np.where(lost, unknown, count)[done]
                live, node, at, count = live[~done], node[~done], at[~done], count[~done]
        return out


_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_tokens": pa.int64()}


def token_counts(
    docs: DataFrame,
    automaton: Automaton | None = None,
    words: Callable[[str], list[str]] = words_of,
    tokenizer_path: str | None = None,
    memory: int = 300_000,
) -> DataFrame:
    """n_words and n_tokens of every text: its words by ``words``, their greedy longest-match pieces.

    Without an automaton the pieces are those of the byte-level vocabulary file, all of which may begin or
    continue a word; every byte is one, so no word is unknown. A null or empty text has no words, a very long one is
    counted whole. A null doc_id stays null, repeated rows are kept, an empty table gives an empty result. Columns other than
    doc_id and text are ignored."""
    if automaton is None:
        v = load(tokenizer_path or default_path())
        automaton = Automaton(p for i, p in v.pieces.items() if i not in v.special.values())
    if automaton.nbytes > _MOST_BYTES:
        raise ValueError(f"the automaton takes {automaton.nbytes} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches) -> Iterator[pa.RecordBatch]:
        match = shared.value
        place: dict[str, int] = {}
        sizes = np.zeros(0, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_words, n_tokens = [], []
            for first, end in text_runs(texts):
                if len(place) > memory:
                    place, sizes = {}, np.zeros(0, np.int64)
                found = [words(t) for t in texts[first:end]]
                at = [np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int64, len(ws)) for ws in found]
                new = [w.encode() for w in list(place)[len(sizes) :]]
                if new:
                    sizes = np.concatenate([sizes, match.counts(new)])
                n_words += map(len, found)
                n_tokens += [int(sizes[k].sum()) for k in at]
            yield arrow_batches(_OUT, {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_tokens": n_tokens})

    schema = T._parse_datatype_string("doc_id long, n_words long, n_tokens long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
