"""Byte-level BPE through a lexicon: frequent words in a minimal acyclic transducer, the rest merged exactly.

The words of all texts are counted, the most frequent compiled into an automaton whose equal suffixes are
shared. Each transition carries how many accepted words are skipped by taking it, so the sum along a path is
the word's number, and the number points to its ids. The automaton is one block of bytes that workers map
from a file. Words that it does not accept are merged pair by pair.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Tables, arrow_batches, text_runs
from .vocabulary import Vocabulary, default_path, load, words_of

#: Words kept in the lexicon; with at most 64 bytes each it stays far below what may be broadcast.
LEXICON_WORDS = 50_000
_LONGEST = 64
_MOST_BYTES = 64 << 20


class Builder:
    """Adds words in ascending order; states with equal futures become one."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.path: list[list] = [[False, []]]  # of the last word: [accepts, [(byte, state)]]
        self.last = b""

    def _freeze(self, node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def _close(self, depth: int) -> None:
        while len(self.path) - 1 > depth:
            node = self.path.pop()
            self.path[-1][1].append((self.last[len(self.path) - 1], self._freeze(node)))

    def add(self, word: bytes) -> None:
        if word <= self.last and self.path[0][1]:
            raise ValueError("words must ascend")
        k = 0
        while k < min(len(word), len(self.last)) and word[k] == self.last[k]:
            k += 1
        self._close(k)
        self.path += [[False, []] for _ in word[k:]]
        self.path[-1][0] = True
        self.last = word

    def finish(self) -> int:
        self._close(0)
        return self._freeze(self.path[0])


class Transducer:
    """The compiled lexicon: flat arrays in one block of bytes."""

    FIELDS = (("keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("accepts", np.uint8), ("starts", np.int64), ("ids", np.int32))

    def __init__(self, block) -> None:
        sizes = np.frombuffer(block, np.int64, len(self.FIELDS) + 1)
        self.root, at = int(sizes[0]), 8 * len(sizes)
        for (name, kind), n in zip(self.FIELDS, sizes[1:]):
            setattr(self, name, np.frombuffer(block, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> bytes:
        builder = Builder()
        words = sorted(w for w in lexicon if w)
        for word in words:
            builder.add(word)
        root = builder.finish()
        below: list[int] = []  # accepted words from each state; a state comes after those it leads to
        keys, targets, skips = [], [], []
        for state, (accepts, out) in enumerate(builder.states):
            n = int(accepts)
            for byte, to in out:
                keys.append(state << 8 | byte)
                targets.append(to)
                skips.append(n)
                n += below[to]
            below.append(n)
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(lexicon[w]) for w in words], out=starts[1:])
        values = {
            "keys": keys, "targets": targets, "skips": skips, "accepts": [a for a, _ in builder.states],
            "starts": starts, "ids": [i for w in words for i in lexicon[w]],
        }
        parts = [np.ascontiguousarray(values[name], dtype=kind) for name, kind in cls.FIELDS]
        head = np.array([root, *map(len, parts)], np.int64).tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, block: bytes) -> Transducer:
        """Map the block from a file that is unlinked at once: its pages are shared, not copied, and
        nothing is left behind."""
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(block)
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ))
        finally:
            os.unlink(path)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it isn't accepted; all words take a step at once."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= _LONGEST))
        if not len(live) or not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        state, number = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        for depth in range(_LONGEST + 1):
            done = lengths[live] == depth
            if done.any():
                final = done & (self.accepts[state] == 1)
                out[live[final]] = number[final]
                live, state, number = live[~done], state[~done], number[~done]
            if not len(live):
                break
            key = state << 8 | data[begins[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            live, at = live[on], at[on]
            state, number = self.targets[at].astype(np.int64), number[on] + self.skips[at]
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Encoder:
    """Encodes texts word by word; what was found for a word is kept for a while."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer, memory: int = 500_000) -> None:
        self.vocabulary, self.lexicon, self.memory = vocabulary, lexicon, memory
        self.place: dict[str, int] = {}
        self.ids: list[list[int]] = []

    def look_up(self, *words: list[str]) -> None:
        """Resolve the words of some lists that are new: through the automaton, else by merging."""
        new = list(set().union(*words).difference(self.place))
        raw = [w.encode() for w in new]
        for word, data, number in zip(new, raw, self.lexicon.numbers(raw).tolist()):
            self.place[word] = len(self.ids)
            self.ids.append(self.lexicon.output(number) if number >= 0 else self.vocabulary.merge(data))

    def forget(self) -> bool:
        if len(self.ids) <= self.memory:
            return False
        self.place, self.ids = {}, []
        return True

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.vocabulary.segments(text)):
            if k % 2:
                out.append(self.vocabulary.special[part])
            else:
                words = words_of(part)
                self.look_up(words)
                for w in words:
                    out += self.ids[self.place[w]]
        return out


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    return b"".join(map(vocabulary.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _counted(path: str, most: int = 500_000):
    """Words and how often they occur. Texts are cut at white space and only what differs is cut into words, as it is
    behind a space; a word that begins a line counts as one that follows another."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        runs: Counter[str] = Counter()

        def rows():
            counts: dict[str, int] = {}
            for chunk, n in runs.items():
                for word in words_of(" " + chunk):
                    counts[word] = counts.get(word, 0) + n
            return arrow_batches({"word": pa.string(), "n": pa.int64()}, {"word": list(counts), "n": list(counts.values())})

        for batch in batches:
            for text in batch.column("text"):
                for part in vocabulary.segments(text.as_py() or "")[::2]:
                    runs.update(part.split())
                if len(runs) > most:
                    yield rows()
                    runs.clear()
        if runs:
            yield rows()

    return run


def most_frequent(counts: DataFrame, n_words: int) -> Column:
    """Whether a row (word, n) is among the some ``n_words`` most frequent: by a histogram of the counts, exact up to
    1023 and in steps of a thousandth beyond, so that the driver gets some ten thousand rows at most. Of the words of
    the last step a share is taken, by their hashes."""
    shift = F.greatest(F.length(F.bin("n")) - 10, F.lit(0))
    step = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), shift), shift)
    histogram = counts.groupBy(step.alias("least")).agg(F.count("*").alias("words")).collect()
    least, last, share, total = 1 << 62, 1 << 62, 0.0, 0
    for r in sorted(histogram, key=lambda r: -r["least"]):
        if total + r["words"] > n_words:
            last, share = r["least"], (n_words - total) / r["words"]
            break
        least, total = r["least"], total + r["words"]
    return (F.col("n") >= least) | ((F.col("n") >= last) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))


def lexicon(docs: DataFrame, path: str, n_words: int = LEXICON_WORDS) -> bytes:
    """The block of the some ``n_words`` most frequent words of all texts, at most 64 bytes long each."""
    vocabulary, tables = load(path), Tables(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_counted(path), "word string, n long").where(F.octet_length("word") <= _LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    counts = tables.store(counts, "words")
    top = counts.where(most_frequent(counts, n_words)).select("word").collect()
    tables.drop(counts)
    block = Transducer.compile({(w := r["word"].encode()): vocabulary.merge(w) for r in top})
    if len(block) > _MOST_BYTES:
        raise ValueError(f"the lexicon takes {len(block)} bytes; ask for fewer words")
    return block


_OUT = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encoded(docs: DataFrame, tokenizer_path: str | None = None, n_words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    decoded text in UTF-8); with ``with_ids`` also ids and decoded. A null text counts as empty: no ids. A
    null doc_id stays null, repeated rows are kept, an empty table gives an empty result, a text of any
    length is encoded whole. Columns other than doc_id and text are ignored."""
    path = tokenizer_path or default_path()
    block = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, n_words))
    out = _OUT | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {})

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        encoder = Encoder(vocabulary, Transducer.mapped(block.value))
        digits: list[bytes] = []
        pieces: list[bytes] = []
        lengths: list[int] = []
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            docs_of = batch.column("doc_id").to_pylist()
            rows: list[list] = [[] for _ in out]
            for first, end in text_runs(texts):
                parts = [vocabulary.segments(t) for t in texts[first:end]]
                words = [[words_of(p) if k % 2 == 0 else p for k, p in enumerate(part)] for part in parts]
                if encoder.forget() or len(digits) > len(encoder.ids):
                    digits, pieces, lengths = [], [], []
                encoder.look_up(*(p for part in words for p in part[::2]))
                for k in range(len(digits), len(encoder.ids)):
                    ids, encoder.ids[k] = encoder.ids[k], []  # what follows is all that is needed of them
                    lengths.append(len(ids))
                    digits.append(",".join(map(str, ids)).encode())
                    pieces.append(b"".join(map(vocabulary.pieces.__getitem__, ids)))
                place = encoder.place.__getitem__
                for doc, part in zip(docs_of[first:end], words):
                    n, shown, plain = 0, [], []
                    at: list[int] = []
                    for k, p in enumerate(part):
                        if k % 2:
                            special = vocabulary.special[p]
                            shown.append(b"%d" % special)
                            plain.append(vocabulary.pieces[special])
                            n += 1
                        else:
                            at = list(map(place, p))
                            n += sum(map(lengths.__getitem__, at))
                            shown += map(digits.__getitem__, at)
                            plain += map(pieces.__getitem__, at)
                    text = b"".join(plain).decode("utf-8", "replace")
                    values = [doc, n, hashlib.sha256(b",".join(shown)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    if with_ids:
                        values += [[int(x) for x in b",".join(shown).split(b",") if x], text]
                    for to, value in zip(rows, values):
                        to.append(value)
            yield arrow_batches(out, dict(zip(out, rows)))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T._parse_datatype_string(schema))
