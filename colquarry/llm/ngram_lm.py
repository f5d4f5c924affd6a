"""Language-model scores from a sharded Elias-Fano trie of word pairs.

Documents are dealt to blocks. A block counts its words and word pairs and asks the shards for them: a word, and
the pairs that it begins, belong to the shard of its hash. A shard merges what all blocks counted in training
documents into a trie of two levels: contexts, with monotone pointers to the ranges of their successors, and
successors, told apart by 32 bits and Elias-Fano coded behind their context. Probabilities are smoothed and
quantised to a byte. The trie is mapped from a file; a block's pairs are looked up by searching the successors
of their context only. The answers, a byte for each pair, go back to the blocks, which score their documents.

Everything that moves is packed: a row for each block and shard. Pairs of words that are very frequent contexts
(and of the beginning of a text) are dealt by their second word, so that no shard holds all of them.

The probability of w after v is (c(vw) - d) / c(v) + d s(v) / c(v) p(w), where s(v) is the number of different
successors of v: absolute discounting, by which a pair seen twice is far from one seen once. The successors of a frequent
context lie on all shards; each tells every block how many different ones it has, and blocks add these up, so the formula is the same
for all contexts and which of them count as frequent changes no score. p(w) is (c(w) - d) / N for words seen in
training, and the discounts of all words, d V / N, are the probability of an unseen one.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, crc32_bucket, materialize, mix64, text_chunks, word_hashes

DISCOUNT = 0.75
_BEGIN, _END = (int(x) for x in mix64(np.array([101, 202], np.uint64)))
#: Quantisation: 255 steps over so many decades.
DECADES = 12.0
#: A word that makes up this share of a sample's words is a frequent context.
FREQUENT = 0.002
_SAMPLE_ROWS = 2000


class EliasFano:
    """A monotone sequence of n values below ``top``: low bits packed, high bits in unary, with a directory of
    ones per 64-bit word for selection."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (int(top) // max(1, n)).bit_length() - 1)
        bits = np.zeros(((int(top) >> low_bits) + n) // 64 * 64 + 64, np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        mask = np.uint64((1 << low_bits) - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.zeros(n * low_bits // 8 + 9, np.uint8)
        step = 1 << 16
        for a in range(0, n, step):  # packed in runs, which begin at whole bytes
            part = ((values[a : a + step, None] & mask) >> shifts & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(part.ravel(), bitorder="little")
            low[a * low_bits // 8 : a * low_bits // 8 + len(packed)] = packed
        return cls(n, low_bits, low, high, ones)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        word = np.searchsorted(self.ones, at, side="right") - 1
        rest = (at - self.ones[word]).astype(np.int64)
        bits, place = self.high[word], np.zeros(len(at), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # select the rest-th one inside the word
            half = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            up = rest >= half
            rest -= np.where(up, half, 0)
            place += np.where(up, width, 0)
            bits = np.where(up, bits >> np.uint64(width), bits)
        high = (word * 64 + place - at).astype(np.uint64)
        if not self.low_bits:
            return high
        bit = at * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        low = np.zeros(len(at), np.uint64)
        for k in range(8):
            low |= self.low[np.minimum(byte + k, len(self.low) - 1)].astype(np.uint64) << np.uint64(8 * k)
        low >>= shift
        if self.low_bits > 57:
            low |= np.where(shift > 0, self.low[np.minimum(byte + 8, len(self.low) - 1)].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), 0)
        return high << np.uint64(self.low_bits) | low & np.uint64((1 << self.low_bits) - 1)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]


class Trie:
    """pointers: where each context's successors begin; successors: context << 32 | word, monotone as a whole;
    codes: the quantised probability of each."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        (pn, pb), (sn, sb) = parts[0].tolist(), parts[4].tolist()
        self.pointers, self.successors, self.codes = EliasFano(pn, pb, *parts[1:4]), EliasFano(sn, sb, *parts[5:8]), parts[8]

    @classmethod
    def build(cls, n_contexts: int, keys: np.ndarray, codes: np.ndarray) -> Trie:
        begins = np.searchsorted(keys, np.arange(n_contexts + 1, dtype=np.uint64) << np.uint64(32)).astype(np.uint64)
        parts = [*EliasFano.build(begins, len(keys)).arrays(), *EliasFano.build(keys, n_contexts << 32).arrays(), codes]
        return cls(mapped(parts))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of the pairs, 0 where there is none: a search among the context's successors."""
        low, high = self.pointers[context].astype(np.int64), self.pointers[context + 1].astype(np.int64)
        key = context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
        out, live = np.zeros(len(key), np.uint8), np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            got = self.successors[middle]
            same = got == key[live]
            out[live[same]] = self.codes[middle[same]]
            less = got < key[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[~same & (low[live] < high[live])]
        return out


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file that is mapped and unlinked at once: pages come and go with use, and nothing is left."""
    fd, path = tempfile.mkstemp(prefix="levels-")
    try:
        with os.fdopen(fd, "wb") as f:
            starts = []
            for x in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                starts.append(f.tell())
                f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0" * 8)
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    finally:
        os.unlink(path)
    return [np.frombuffer(data, x.dtype, x.size, s) for x, s in zip(arrays, starts)]


def quantise(log10: np.ndarray) -> np.ndarray:
    """A byte from 1 to 255 for a logarithm of 0 to -DECADES (or less)."""
    return (255 - np.clip(np.rint(-log10 * (254 / DECADES)), 0, 254)).astype(np.uint8)


def restored(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.float64) - 255) * (DECADES / 254)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}q", *(x.nbytes for x in arrays))
    return _PACK.compress(head + b"".join(x.tobytes() for x in arrays))


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    raw = _UNPACK.decompress(data)
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, struct.unpack_from(f"<{len(kinds)}q", raw)):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def tokens(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts, each text's words and one end, and where each text's begin."""
    words, lengths = [], []
    for column in texts:
        for _, raw, off in text_chunks(column):
            h, bounds = word_hashes(raw, off)
            words.append(np.insert(h, bounds[1:], np.uint64(_END)))
            lengths.append(np.diff(bounds) + 1)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


class Block:
    """The distinct words and pairs of a block's documents, in an order that depends on nothing else."""

    def __init__(self, texts: list[pa.Array], training: np.ndarray, shards: int, frequent: np.ndarray) -> None:
        token, self.bounds = tokens(texts)
        n = np.diff(self.bounds)
        self.training = training
        trained = np.repeat(training, n)
        self.words, self.token = np.unique(token, return_inverse=True)
        self.counts = np.bincount(self.token, weights=trained, minlength=len(self.words)).astype(np.uint32)
        before = np.empty(len(token), np.int64)
        before[1:] = self.token[:-1]
        before[self.bounds[:-1][n > 0]] = len(self.words)  # the beginning of a text
        code = before * (len(self.words) + 1) + self.token
        order = np.argsort(code, kind="stable")
        first = np.concatenate([[True], code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, bool)
        number = np.cumsum(first) - 1
        self.pair = np.empty(len(code), np.int64)
        self.pair[order] = number
        self.pair_counts = np.bincount(self.pair, weights=trained, minlength=int(first.sum())).astype(np.uint32)
        distinct = code[order][first]
        self.context, self.following = distinct // (len(self.words) + 1), distinct % (len(self.words) + 1)
        # the frequent contexts, by their place in the list; else -1
        self.special = np.full(len(self.words) + 1, -1, np.int64)
        at = np.searchsorted(frequent, self.words)
        known = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == self.words)
        self.special[:-1][known] = at[known]
        self.special[-1] = int(np.searchsorted(frequent, np.uint64(_BEGIN)))
        self.word_shard = ((self.words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        special = self.special[self.context]
        shard = np.where(special >= 0, self.word_shard[self.following], np.append(self.word_shard, 0)[self.context])
        # of a shard, pairs of its own words first, then those of the frequent contexts; each as they were
        rank = np.where(special >= 0, len(self.words) + special, self.context)
        self.pair_order = np.lexsort((rank, shard))
        self.shards, self.n_frequent = shards, len(frequent)
        self.word_cuts = np.searchsorted(self.word_shard, np.arange(shards + 1))
        self.pair_cuts = np.searchsorted(shard[self.pair_order], np.arange(shards + 1))
        self.rank = rank

    def request(self, shard: int) -> bytes:
        a, b = self.word_cuts[shard : shard + 2]
        pairs = self.pair_order[self.pair_cuts[shard] : self.pair_cuts[shard + 1]]
        rank = self.rank[pairs]
        context = np.where(rank >= len(self.words), rank - len(self.words) + (b - a), rank - a)
        successors = np.bincount(context, minlength=b - a + self.n_frequent).astype(np.uint32)
        word = (self.words[self.following[pairs]] >> np.uint64(8)).astype(np.uint32)
        return packed(self.words[a:b], self.counts[a:b], successors, word, self.pair_counts[pairs])


_REQUEST = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
_MESSAGE = {"block": pa.int64(), "shard": pa.int32(), "data": pa.binary()}


def remainder(different: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The quantised share of contexts that so many different successors leave to the words alone: all of it where a
    context wasn't seen."""
    share = DISCOUNT * different / np.maximum(counts, 1)
    return quantise(np.log10(np.where(share > 0, share, 1.0)))


def answers(requests: list[tuple[int, bytes]], frequent_counts: np.ndarray) -> tuple[list[tuple[int, bytes]], int]:
    """For each block's request of a shard the counts of its words, the quantised share that their successors leave
    to the words alone, the number of different successors that each frequent context has here, and the quantised
    probabilities of the block's pairs; and the number of words seen in training."""
    read = [(block, *unpacked(data, *_REQUEST)) for block, data in requests]
    words, place = np.unique(np.concatenate([r[1] for r in read]), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([r[2] for r in read]), minlength=len(words)).astype(np.int64)
    n_contexts = len(words) + len(frequent_counts)
    keys, asked = [], []
    at = 0
    for _, own, _, successors, word, n in read:
        context = np.repeat(np.concatenate([place[at : at + len(own)], np.arange(len(words), n_contexts)]), successors)
        at += len(own)
        asked.append((context, word))
        keys.append(context.astype(np.uint64)[n > 0] << np.uint64(32) | word[n > 0].astype(np.uint64))
    seen, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(inverse, weights=np.concatenate([r[5][r[5] > 0] for r in read]), minlength=len(seen))
    total = np.concatenate([counts, frequent_counts]).astype(np.float64)
    context = (seen >> np.uint64(32)).astype(np.int64)
    different = np.bincount(context, minlength=n_contexts)
    left = remainder(different[: len(words)], counts)
    with np.errstate(divide="ignore", invalid="ignore"):
        codes = quantise(np.log10((times - DISCOUNT) / total[context]))
    trie = Trie.build(n_contexts, seen, codes)
    out, at = [], 0
    for (block, own, *_), (context, word) in zip(read, asked):
        mine = place[at : at + len(own)]
        at += len(own)
        out.append((block, packed(counts[mine].astype(np.uint32), left[mine], different[len(words) :].astype(np.uint32), trie.find(context, word))))
    return out, int((counts > 0).sum())


_ANSWER = (np.uint32, np.uint8, np.uint32, np.uint8)
_SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "log_counts": pa.float64(), "log_model": pa.float64()}


def scores(block: Block, replies: dict[int, bytes], n_train: int, frequent_counts: np.ndarray) -> dict[str, np.ndarray]:
    """For each document: n_tokens, n_known, the sum of log10(c + 1), and the model's logarithm but for the number
    of words seen, which the probability of every unseen word holds as a factor."""
    counts, left = np.zeros(len(block.words), np.float64), np.zeros(len(block.words) + 1)
    code, different = np.zeros(len(block.pair_order), np.uint8), np.zeros(len(frequent_counts), np.int64)
    for shard, data in replies.items():
        c, own, here, pairs = unpacked(data, *_ANSWER)
        a, b = block.word_cuts[shard : shard + 2]
        counts[a:b] = c
        left[a:b] = restored(own)
        code[block.pair_order[block.pair_cuts[shard] : block.pair_cuts[shard + 1]]] = pairs
        different += here
    at = np.flatnonzero(block.special >= 0)
    left[at] = restored(remainder(different, frequent_counts))[block.special[at]]
    alone = np.where(counts > 0, np.log10(np.maximum(counts - DISCOUNT, 1e-9)), np.log10(DISCOUNT)) - np.log10(max(1, n_train))
    after = np.power(10.0, left[block.context] + alone[block.following])
    pair = np.log10(np.where(code > 0, np.power(10.0, restored(code)), 0.0) + after)
    starts = block.bounds[:-1]
    total = lambda x: np.add.reduceat(x[block.token], starts) if len(starts) else np.zeros(0)
    return {
        "n_tokens": np.diff(block.bounds),
        "n_known": total((counts > 0).astype(np.int64)),
        "log_counts": total(np.log10(counts + 1)),
        "log_model": np.add.reduceat(pair[block.pair], starts) if len(starts) else np.zeros(0),
    }


def _frequent(docs: DataFrame, training: Column) -> tuple[np.ndarray, int, np.ndarray, int]:
    """Frequent contexts, from a sample; then from all texts their exact counts in training, the number of training
    tokens and the bytes. The beginning of a text is one of them."""
    rows = docs.select(F.count("*")).first()[0]
    share = min(1.0, _SAMPLE_ROWS / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.unique(tokens([batch.column("text")])[0], return_counts=True)
            keep = n >= max(2, 0.2 * FREQUENT * n.sum())
            yield arrow_batches({"w": pa.int64(), "n": pa.int64()}, {"w": np.append(words[keep].view(np.int64), 0), "n": np.append(n[keep], n.sum())})

    top = sample.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = materialize(top, "sample")
    size = (top.where("w = 0").agg(F.sum("n")).first()[0] or 0) * FREQUENT
    hot = [r["w"] for r in top.where((F.col("w") != 0) & (F.col("n") > size)).select("w").collect()]  # at most 1 / FREQUENT
    frequent = np.unique(np.append(np.array(hot, np.int64).view(np.uint64), np.uint64(_BEGIN)))
    frequent = frequent[frequent != np.uint64(_END)]

    def exact(batches) -> Iterator[pa.RecordBatch]:
        found, n, size = np.zeros(len(frequent), np.int64), 0, 0
        for batch in batches:
            flags = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
            token, bounds = tokens([batch.column("text")])
            trained = token[np.repeat(flags, np.diff(bounds))]
            at = np.minimum(np.searchsorted(frequent, trained), len(frequent) - 1)
            found += np.bincount(at[frequent[at] == trained], minlength=len(frequent))
            found[np.searchsorted(frequent, np.uint64(_BEGIN))] += flags.sum()
            n += len(trained)
            size += batch.column("text").nbytes
        yield arrow_batches({"w": pa.int64(), "n": pa.int64()}, {"w": [*range(len(frequent)), -1, -2], "n": [*found.tolist(), n, size]})

    sums = dict(docs.select("text", training.alias("training")).mapInArrow(exact, "w long, n long").groupBy("w").agg(F.sum("n")).collect())
    return frequent, sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(len(frequent))], np.int64), sums.get(-2, 0)


def scored(docs: DataFrame, held_out: Column | None = None, block_bytes: int = 14 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are the words, A-Z lower-cased, and one end. The model learns from the rows that are not held out (by
    default those whose crc32(doc_id as text) modulo 7 isn't 2; a null doc_id trains). base_score is the sum of
    log10((c + 1) / (N + V + 1)); score the logarithm by the trie's model, of the same tokens. A null or empty
    text is an end alone, a very long one is scored whole in its block. Without training tokens every base_score and score is 0. Repeated rows are kept and
    count each; an empty table gives an empty result. Columns other than doc_id and text are ignored."""
    held = crc32_bucket("doc_id", 7) == 2 if held_out is None else held_out
    docs = docs.withColumn("_held", F.coalesce(held, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_held").alias("held_out"))
    frequent, n_train, frequent_counts, size = _frequent(docs, ~F.col("held_out"))
    n = max(1, -(-size // block_bytes))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "block")

    def block_of(texts: list[pa.Array], held: np.ndarray) -> Block:
        return Block(texts, ~held, n, frequent)

    def ask(table: pa.Table) -> pa.Table:
        block = block_of(table.column("text").chunks, table.column("held_out").to_numpy().astype(bool))
        name, shards = table.column("block")[0].as_py(), range(n)
        return pa.table({"block": pa.array([name] * n, pa.int64()), "shard": pa.array(shards, pa.int32()), "data": pa.array(map(block.request, shards), pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        out, known = answers(list(zip(table.column("block").to_pylist(), table.column("data").to_pylist())), frequent_counts)
        shard = table.column("shard")[0].as_py()
        rows = [*((b, shard, d) for b, d in out), (-1 - shard, shard, known.to_bytes(8, "little"))]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), _MESSAGE.values())], names=list(_MESSAGE))

    def score(own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:  # what a shard tells of itself
            data = replies.column("data")[0].as_py()
            values = {"doc_id": [None], "held_out": [None], "n_tokens": [-1], "n_known": [int.from_bytes(data, "little")], "log_counts": [0.0], "log_model": [0.0]}
        else:
            held = own.column("held_out").to_numpy().astype(bool)
            block = block_of(own.column("text").chunks, held)
            data = dict(zip(replies.column("shard").to_pylist(), replies.column("data").to_pylist()))
            values = {"doc_id": own.column("doc_id").combine_chunks(), "held_out": held, **scores(block, data, n_train, frequent_counts)}
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, _SCORES[k]) for k, x in values.items()], names=list(_SCORES))

    requests = dealt.groupBy("block").applyInArrow(ask, "block long, shard int, data binary")
    replies = requests.groupBy("shard").applyInArrow(reply, "block long, shard int, data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double"
    done = materialize(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema), "scores")
    known = done.where("n_tokens = -1").agg(F.sum("n_known")).first()[0] or 0
    from math import log10

    unseen = F.col("n_tokens") - F.col("n_known")
    out = done.where("n_tokens >= 0").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * log10(n_train + known + 1)).alias("base_score"),
        (F.col("log_model") + unseen * log10(max(1, known))).alias("score"),
    )
    return out if n_train else out.withColumn("base_score", F.lit(0.0)).withColumn("score", F.lit(0.0))
