"""Document fingerprints from prefix polynomial hashes.

A text of code points c_0 .. c_{n-1} has the modular prefix arrays S[i] = sum_{j<i} (c_j + 1) * b^j mod p
for two primes. The hash of a span [i, j) is (S[j] - S[i]) * b^-i, so any two spans compare in constant
time and the longest common extension of two positions is found by binary search.

A fingerprint keeps the prefix hashes at cut points only. A cut stands where the hash of the following
16-character window ends in enough zero bits, so equal passages are cut alike wherever they stand, and
cuts of a coarser level are a subset of those of a finer one. The spans between cuts of two fingerprints,
hashed through their kept prefixes, are compared: the likeness is the share of the longer text that lies
in spans both have. Where cuts are far apart or none is left (windows that repeat), even cuts counted from the
last one stand in. Prefix hashes at fixed rungs, which grow by a sixteenth up to the text's length, are kept as well;
a binary search over them finds the common prefix to the rung, which counts where it is the larger share.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, mix64

PRIMES = (2147483647, 2147483629)
BASES = (1000003579, 1500450271)
WINDOW = 16
MOST_CUTS = 48
_FIRST_BITS = 4
#: A span of more than so many mean ones is cut evenly.
_WIDE = 4


def _rungs() -> np.ndarray:
    at = [0]
    while at[-1] < 1 << 31:  # no string is longer
        at.append(at[-1] + max(1, at[-1] // 16))
    return np.array(at[1:])


RUNGS = _rungs()


class _Powers:
    """b^0, b^1, ... and the inverse powers, grown on demand to the longest text seen."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, self.prime)) % np.uint64(self.prime)])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, self.prime)) % np.uint64(self.prime)])


_POWERS = tuple(_Powers(p, b) for p, b in zip(PRIMES, BASES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            powers.grow(self.n + 1)
            p = np.uint64(powers.prime)
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum((points + np.uint64(1)) * powers.up[: self.n] % p, out=s[1:])
            self.sums.append(s % p)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of the span [i, j), the same wherever an equal span stands."""
        return tuple((int(s[j]) - int(s[i])) * int(w.down[i]) % w.prime for s, w in zip(self.sums, _POWERS))  # type: ignore[return-value]

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """The length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def window_hashes(self) -> np.ndarray:
        if self.n < WINDOW:
            return np.zeros(0, np.uint64)
        s, powers = self.sums[0], _POWERS[0]
        p = np.uint64(powers.prime)
        return mix64((s[WINDOW:] + p - s[:-WINDOW]) * powers.down[: self.n - WINDOW + 1] % p)


def _even_cuts(at: np.ndarray, low: np.ndarray, n: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The cuts and, in wide spans, every ``step`` characters more. Their distance from the span's start stands for
    the window's hash, so of these too those of a coarser level are a subset."""
    edges = np.concatenate([[0], at, [n]])
    wide = np.flatnonzero(np.diff(edges) > _WIDE * step)
    if not len(wide):
        return at, low
    away = [np.arange(step, edges[k + 1] - edges[k], step) for k in wide]
    more = np.concatenate([edges[k] + a for k, a in zip(wide, away)])
    order = np.argsort(np.concatenate([at, more]))
    return np.concatenate([at, more])[order], np.concatenate([low, np.concatenate(away).astype(np.uint32)])[order]


class Fingerprint:
    """Cut points with their prefix hashes, and the text's length and whole hash."""

    __slots__ = ("n", "bits", "at", "low", "h1", "h2", "rungs", "_spans")

    def __init__(self, hashes: PrefixHashes) -> None:
        n = self.n = hashes.n
        marks = hashes.window_hashes()
        bits = first_bits = _FIRST_BITS + max(0, int(n // (MOST_CUTS << _FIRST_BITS)).bit_length())
        at = np.flatnonzero((marks & np.uint64((1 << bits) - 1)) == 0)
        while len(at) > 2 * MOST_CUTS:
            bits += 1
            at = at[(marks[at] & np.uint64((1 << bits) - 1)) == 0]
        at = at[at > 0]
        if len(at) < MOST_CUTS // 8:  # the few that are left count at the level of texts as long
            bits = first_bits
        self.bits = bits
        low = (marks[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at, self.low = _even_cuts(at, low, n, 1 << bits)
        ends = np.append(at, n)
        self.at = ends.astype(np.uint32)
        self.h1, self.h2 = (s[ends].astype(np.uint32) for s in hashes.sums)
        first = RUNGS[: np.searchsorted(RUNGS, n, side="right")]
        self.rungs = np.concatenate([s[first] for s in hashes.sums]).astype(np.uint32)
        self._spans: dict[int, list] = {}

    def __str__(self) -> str:
        data = b"".join(x.astype("<u4").tobytes() for x in (self.rungs, self.at, self.h1, self.h2, self.low))
        return f"{self.n}:{self.bits}:{int(self.h1[-1]):08x}{int(self.h2[-1]):08x}:{base64.b64encode(data).decode()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, bits, _, data = text.split(":")
        words = np.frombuffer(base64.b64decode(data), "<u4")
        out = cls.__new__(cls)
        out.n, out.bits, out._spans = int(n), int(bits), {}
        r = 2 * int(np.searchsorted(RUNGS, out.n, side="right"))
        out.rungs, words = words[:r], words[r:]
        k = (len(words) + 1) // 4
        out.at, out.h1, out.h2, out.low = words[:k], words[k : 2 * k], words[2 * k : 3 * k], words[3 * k :]
        return out

    def spans(self, bits: int) -> list[tuple[int, int]]:
        """(hash, length) of each span between the cuts that hold at ``bits`` or more zero bits."""
        if bits not in self._spans:
            keep = np.append((self.low.astype(np.uint64) & np.uint64((1 << min(bits, 32)) - 1)) == 0, True)
            at = self.at[keep].astype(np.int64)
            start = np.concatenate([[0], at[:-1]])
            keys = np.zeros(len(at), np.uint64)
            for h, powers in zip((self.h1, self.h2), _POWERS):
                powers.grow(self.n + 1)
                p, ends = np.uint64(powers.prime), h[keep].astype(np.uint64)
                first = np.concatenate([np.zeros(1, np.uint64), ends[:-1]])
                keys = (keys << np.uint64(31)) ^ ((ends + p - first) * powers.down[start] % p)
            self._spans[bits] = list(zip(keys.tolist(), (at - start).tolist()))
        return self._spans[bits]


def common_rung(a: Fingerprint, b: Fingerprint) -> int:
    """The longest kept prefix that both have, by binary search: prefixes differ from some rung on."""
    na, nb = len(a.rungs) // 2, len(b.rungs) // 2
    low, high = 0, min(na, nb)
    while low < high:
        k = (low + high + 1) // 2
        if a.rungs[k - 1] == b.rungs[k - 1] and a.rungs[na + k - 1] == b.rungs[nb + k - 1]:
            low = k
        else:
            high = k - 1
    return int(RUNGS[low - 1]) if low else 0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the longer text that lies in spans that both have, or in the common prefix found at the
    rungs if that is more: 0 to 1, 1 for equal texts."""
    if a.n == b.n and a.h1[-1] == b.h1[-1] and a.h2[-1] == b.h2[-1]:
        return 1.0
    bits = max(a.bits, b.bits)
    left: dict[tuple[int, int], int] = {}
    for span in a.spans(bits):
        left[span] = left.get(span, 0) + 1
    common = 0
    for span in b.spans(bits):
        if left.get(span, 0) > 0:
            left[span] -= 1
            common += span[1]
    return max(common, common_rung(a, b)) / max(a.n, b.n)


def edited(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many (or all) of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_OUT = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: Fingerprint, own_points: np.ndarray, following: str, next_print: Fingerprint, next_points: np.ndarray) -> tuple:
    n = len(own_points)
    q = n // 4
    changed = text[: n - q] + following[:q]
    if changed == text:
        other = own
    else:
        other = Fingerprint(PrefixHashes(np.concatenate([own_points[: n - q], next_points[:q]])))
    return (
        doc_id,
        n,
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        str(own),
        str(other),
        likeness(own, other),
        likeness(own, next_print),
    )


def _chain(batches):
    """Rows sorted by (bucket, tail, doc_id, text): each row meets its successor; a bucket ends with
    the first rows of the next one (tail), which are read but not returned."""
    held = None
    out: list[tuple] = []
    for batch in batches:
        bucket, tail, ids = (batch.column(k).to_pylist() for k in ("bucket", "tail", "doc_id"))
        for k, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            if tail[k] and held is None:
                continue
            points = code_points(text)
            mine = Fingerprint(PrefixHashes(points))
            if held is not None and held[0] == bucket[k]:
                out.append(_row(*held[1:], text, mine, points))
            held = None if tail[k] else (bucket[k], ids[k], text, mine, points)
            if len(out) >= 512:
                yield arrow_batches(_OUT, dict(zip(_OUT, zip(*out))))
                out = []
    if out:
        yield arrow_batches(_OUT, dict(zip(_OUT, zip(*out))))


#: Buckets at most, and rows that their bounds are taken from for each. Bounds only balance the buckets: beyond them each grows.
MOST_BUCKETS, SAMPLED_PER_BUCKET = 1 << 15, 64
_PREFIX = 24


def _order_key() -> Column:
    """What orders rows but for the rest of long texts: null ids first, ids, beginnings of texts."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce(F.left("text", F.lit(_PREFIX)), F.lit("")).alias("beginning"))


def _bounds(docs: DataFrame, rows_per_bucket: int, bytes_per_bucket: int) -> list[tuple[bool, int, str]]:
    """The least key of each bucket, in order; none for an empty table. Keys of rows that are there."""
    key = _order_key()
    facts = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.min(key).alias("first")).first()
    if not facts["rows"]:
        return []
    n = min(MOST_BUCKETS, max(1, -(-facts["rows"] // rows_per_bucket), -(-facts["bytes"] // bytes_per_bucket)))
    bounds = {tuple(facts["first"])}
    if n > 1:
        share = min(1.0, n * SAMPLED_PER_BUCKET / facts["rows"])
        sample = docs.select(key.alias("key")) if share == 1.0 else docs.select(key.alias("key")).sample(share, seed=11)
        counted = sorted((tuple(r["key"]), r["count"]) for r in sample.groupBy("key").count().collect())  # some n * SAMPLED_PER_BUCKET rows at most
        total, seen, made = sum(c for _, c in counted), 0, 0
        for k, c in counted:
            if seen * n >= (made + 1) * total:
                bounds.add(k)
                made = seen * n // total
            seen += c
    return sorted(bounds, key=lambda b: (b[0], b[1], b[2].encode()))


def fingerprints(docs: DataFrame, rows_per_bucket: int = 6000, bytes_per_bucket: int = 32 << 20) -> DataFrame:
    """Fingerprint each text and its edit against the next document in ascending (doc_id, text).

    Ranges of doc_id and beginning of the text, cut by a sample, are sorted apart: one shuffle of the texts, each
    dealt to the bucket of its range; the first documents of a range also go to the end of the range before (those
    of the first range to the last), so no order over all rows is needed, and rows that share a doc_id, or have
    none, are split as well.

    A null text counts as empty (n_chars 0, likeness 1 to another empty text, 0 to any other). A null
    doc_id sorts first. Rows with one doc_id follow each other by text; repeated rows are kept. A very long text is
    fingerprinted whole. A single document is its own successor. An empty table gives an empty result. Columns other
    than doc_id and text are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = _bounds(docs, rows_per_bucket, bytes_per_bucket)
    if not bounds:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    steps = (len(bounds) - 1).bit_length()
    array = F.from_json(F.lit(json.dumps([{"known": b, "id": i, "beginning": t} for b, i, t in bounds])), "array<struct<known:boolean,id:bigint,beginning:string>>")
    # the last bound that is not above the key, by binary search
    find = F.aggregate(
        F.lit([1 << k for k in reversed(range(steps))]) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda low, step: F.when((low + step < len(bounds)) & (F.get(array, low + step) <= F.col("key")), low + step).otherwise(low),
    )
    placed = docs.withColumn("key", _order_key()).withColumn("at", find)
    here = F.struct(F.col("at").alias("bucket"), F.lit(0).alias("tail"))
    before = F.struct(((F.col("at") + len(bounds) - 1) % len(bounds)).alias("bucket"), F.lit(1).alias("tail"))
    dealt = placed.select("doc_id", "text", F.inline(F.when(F.get(array, F.col("at")) == F.col("key"), F.array(here, before)).otherwise(F.array(here))))
    return (
        dealt.repartitionById(len(bounds), F.col("bucket"))
        .sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .select("bucket", "tail", "doc_id", "text")
        .mapInArrow(_chain, T._parse_datatype_string(_SCHEMA))
    )
