"""Near duplicates by exact Jaccard similarity of word shingles, joined through signature trees.

A document's set is its distinct shingles, as 64-bit hashes. Equal sets are one class and enter the join once.

Which sets can meet. Sets of a and b elements that link differ in at most (den - num) / (den + num) * (a + b)
of them (for a similarity of num / den). Sizes fall into spaces; the hash range is cut into more parts than two
linked sets of a space can differ in, so some part is the same in both, and the hash of a part's elements routes
a set to all it could link with. No link is lost and no pair is listed yet.

What is worth a meeting. Of a set's parts that aren't empty, all but the most that it can differ in are the same
in a set that it links with. So a set takes part in a space only if that many of its routes are met by others: a
passage shared by many documents makes few of its parts equal, and such sets leave before any of them is read.

What happens where sets meet. The sets of a route form a signature tree: a node holds its sets' OR-combined
bitmap, its range of sizes and how many elements share bits with others. Two nodes are walked together and
dropped where the sizes are too far apart, all their sets are linked already, or the bits both have, with the
shared ones, can't reach the least overlap that a link needs. Pairs of sets that remain are compared exactly.

Sets that can meet, over any number of routes, are a cluster. A cluster that fits a task is walked there as one
tree, so each set is sent once. The sets of larger clusters are walked by route, twice. First each set goes to one
route only, the class that heads most of its routes; that links nearly all copies, and the components of these
links are taken. Then only routes that still hold sets of different components are walked: once with short bitmaps
alone, which leaves the sets that some other one may link with, and in full over these. Routes with many sets are
cut into blocks, and pairs of blocks are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import components
from .shared import Tables, arrow_batches, mix64, random64, text_chunks, word_hashes

_WEIGHTS = random64(64, 21) | np.uint64(1)
_SPAN_RATIO = 1.5


class Spaces:
    """Ranges of set sizes and, for each, the number of parts the hash range is cut into."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the similarity must be in (0, 1]")
        self.num, self.den = num, den
        self.tops = [1]

    def differences(self, a: int, b: int) -> int:
        """How many elements linked sets of a and b elements can differ in, at most."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def linked(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def least_common(self, total: int) -> int:
        """The overlap that a link of sets with so many elements together needs."""
        return -(-self.num * total // (self.num + self.den))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """The spaces of a set of n elements: (number, parts, differences): its own, where it may be the
        smaller of a pair, and those of sizes it may be the larger of."""
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * _SPAN_RATIO)))
        k = int(np.searchsorted(self.tops, n))
        out = []
        while k >= 0:
            top = self.tops[k]
            if top < n and self.den * top < self.num * n:
                break
            most = self.differences(top, top * self.den // self.num)
            out.append((k, most + 2 + most // 16, most))
            k -= 1
        return out


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; one of all words where they are fewer."""
    words, bounds = word_hashes(raw, off)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            runs += words[j : len(words) - k + 1 + j] * _WEIGHTS[j] if len(runs) else runs
        runs = mix64(runs)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                whole = (words[a:b] * _WEIGHTS[32 : 32 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix64(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_id(elements: np.ndarray) -> int:
    """A 64-bit name of a set: two of N sets share one with a chance of about N * N / 2**65."""
    with np.errstate(over="ignore"):
        total = mix64(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def marked_routes(elements: np.ndarray, spaces: Spaces) -> list[tuple[int, int, np.ndarray]]:
    """For each space of a set: its number, how many of the routes a set that links shares at least, and the routes,
    the hash of the elements of each part that has any.

    In m parts, linked sets differ in at most ``most``. A set with more than ``most`` parts that have elements
    has one of these in common with whatever it links with. Where a set has no more than that, its empty parts
    are routes as well: they bring it together with another such set."""
    out, n = [], len(elements)
    with np.errstate(over="ignore"):
        mixed = mix64(elements)
        for number, m, most in spaces.of(n):
            part = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            full = part[first]
            tag = np.uint64(number << 32)
            keys = mix64(np.add.reduceat(mixed, first) + mix64(tag | full))
            top = spaces.tops[number]
            differ = spaces.differences(n, n * spaces.den // spaces.num if n <= top else top)
            if len(first) <= most:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
                keys = np.concatenate([keys, mix64(mix64(tag | empty) ^ np.uint64(0xD1B54A32D192ED03))])
            out.append((number, max(1, len(first) - differ), keys.view(np.int64)))
    return out


def routes(elements: np.ndarray, spaces: Spaces) -> np.ndarray:
    return np.concatenate([keys for _, _, keys in marked_routes(elements, spaces)])


class Frequent:
    """Tells which of the routes that a task has seen already belong to so many of its classes that more of them are
    to be dealt over many tasks. Of each such route ``often`` different classes have gone undealt before.

    Cells count routes first, and a route by itself only once its cell is full, so memory is bounded."""

    CELLS, LIFE = 1 << 22, 1 << 24

    def __init__(self, often: int) -> None:
        self.often = often
        self.clear()

    def clear(self) -> None:
        self.cells, self.age, self.sent = np.zeros(self.CELLS, np.uint32), 0, {}

    def dealt(self, keys: np.ndarray) -> np.ndarray:
        """Flags of the routes to deal; no class may come with a route twice between two calls of clear()."""
        if self.age + len(keys) > self.LIFE:
            self.clear()
        self.age += len(keys)
        cell = (keys.view(np.uint64) >> np.uint64(65 - self.CELLS.bit_length())).astype(np.int64)
        np.add.at(self.cells, cell, np.uint32(1))
        out = np.zeros(len(keys), bool)
        for at in np.flatnonzero(self.cells[cell] >= self.often).tolist():
            times = self.sent.get(key := int(keys[at]), 0)
            out[at] = times >= self.often
            self.sent[key] = times + 1
        return out


_DEAL = 4096  # ways that a frequent route is dealt
_SALT = 40
_ROUTED = {"key": pa.int64(), "set_id": pa.int64(), "n": pa.int64()}


def _routed(k: int, num: int, den: int, id_type: pa.DataType, memory: int = 500_000, often: int = 64):
    """Rows of two kinds: n >= 0: a document (its ref as the key and its doc_id) with its class and the number of
    elements of its set; else a route (key) of a class: -1 - n has the space, above it the routes that are needed
    there, and from bit 40 on, for a frequent route, which of its parts the class is dealt to."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        spaces, seen, frequent = Spaces(num, den), set(), Frequent(often)
        for batch in batches:
            for first, raw, off in text_chunks(batch.column("text")):
                names, sizes, keys, owners, marks = [], [], [], [], []
                for elements in shingle_sets(raw, off, k):
                    name = set_id(elements) if len(elements) else None
                    names.append(name)
                    sizes.append(len(elements))
                    if name is not None and name not in seen:
                        if len(seen) >= memory:
                            seen.clear()
                            frequent.clear()
                        seen.add(name)
                        for number, need, own in marked_routes(elements, spaces):
                            keys.append(own)
                            owners.append(np.full(len(own), name, np.int64))
                            marks.append(np.full(len(own), need << 6 | number, np.int64))
                rows = {"key": batch.column("ref").slice(first, len(names)), "set_id": names, "n": sizes}
                yield arrow_batches(_ROUTED | {"doc_id": id_type}, rows | {"doc_id": batch.column("doc_id").slice(first, len(names))})
                if keys:
                    key, owner, mark = map(np.concatenate, (keys, owners, marks))
                    part = 1 + (mix64(owner.view(np.uint64)) % np.uint64(_DEAL)).astype(np.int64)
                    mark |= np.where(frequent.dealt(key), part, 0) << _SALT
                    yield arrow_batches(_ROUTED | {"doc_id": id_type}, {"key": key, "set_id": owner, "n": -1 - mark, "doc_id": pa.nulls(len(key), id_type)})

    return run


def _met(batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, part, set_id): the documents, and the classes of the routes on which two of them or more meet.

    A dealt route is met: undealt classes of it are elsewhere. So each of its rows stays."""
    last = None
    for batch in batches:
        n = batch.column("n").to_numpy()
        route = n < 0
        if not route.all():
            yield batch.filter(pa.array(~route))
        if not route.any():
            continue
        key, name = (batch.column(c).filter(pa.array(route)).to_numpy(zero_copy_only=False) for c in ("key", "set_id"))
        n = n[route]
        if last is not None:  # the last class of the batch before stands for its route
            key, name, n = (np.concatenate([[x], y]) for x, y in zip(last, (key, name, n)))
        part = (-1 - n) >> _SALT
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (part[1:] == part[:-1])])
        again = same & np.concatenate([[False], name[1:] == name[:-1]])
        other = same & ~again
        met = np.concatenate([other[1:], [False]])  # the one before another class
        met |= other | (part > 0)
        last = key[-1], name[-1], n[-1]
        if met.any():
            ids = batch.schema.field("doc_id").type
            values = {"key": key[met], "set_id": name[met], "n": -1 - (-1 - n[met] & ((1 << _SALT) - 1)), "doc_id": pa.nulls(int(met.sum()), ids)}
            yield arrow_batches(_ROUTED | {"doc_id": ids}, values)

    return


# ---------------------------------------------------------------------------------------------
# Signature trees


class SignatureTree:
    """Sets in the order given, in leaves of 64; nodes of 8. bits: a bitmap for each set (64-bit words)."""

    LEAF, FAN = 64, 8

    def __init__(self, members: list[int], sizes: np.ndarray, bits: np.ndarray, spare: np.ndarray) -> None:
        self.members = np.array(members)
        size = sizes[self.members]
        self.levels = []
        low, high, signature, extra = size, size, bits[self.members], spare[self.members]
        fan = self.LEAF
        while True:
            at, fan = np.arange(0, len(low), fan), self.FAN
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            signature, extra = np.bitwise_or.reduceat(signature, at, axis=0), np.maximum.reduceat(extra, at)
            self.levels.append((low, high, signature, extra))
            if len(low) == 1:
                break

    def children(self, level: int, node: int) -> range:
        return range(node * self.FAN, min(len(self.levels[level - 1][0]), (node + 1) * self.FAN))

    def under(self, level: int, node: int) -> slice:
        width = self.LEAF * self.FAN**level
        return slice(node * width, (node + 1) * width)


def bitmap(elements: np.ndarray, width: int) -> np.ndarray:
    """Bits at the places that the top bits of the elements name; ``width``: a power of two."""
    flags = np.zeros(width, np.uint8)
    flags[(elements >> np.uint64(65 - width.bit_length())).astype(np.int64)] = 1
    return np.packbits(flags)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The same elements' bitmap of a smaller width."""
    flags = np.unpackbits(bits)
    return np.packbits(flags.reshape(width, -1).any(axis=1))


def width_for(n: int, each: int, most: int) -> int:
    """Bits for a set of n elements: a power of two, about ``each`` for an element."""
    return 1 << min(most, max(6, int(each * n - 1).bit_length()))


_AT_ONCE = 1 << 16  # words of bitmaps


def walk_pairs(sizes: np.ndarray, bits: np.ndarray, group: np.ndarray, sides: list[int], spaces: Spaces, visit) -> None:
    """Calls visit(i, at) for the pairs of a set i and sets ``at`` of other groups that their bitmaps don't rule out.

    bits: a row of 64-bit words for each set. sides: 0 or 1; with both, only pairs between the two are met, else
    all. Leaves are compared as a whole, some ``_AT_ONCE`` words at a time, not set by set. ``visit`` may change
    ``group``: what it joins isn't met any more."""
    spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    order = np.lexsort((group, sizes)).tolist()
    if len(set(sides)) > 1:
        left, right = (SignatureTree([k for k in order if sides[k] == side], sizes, bits, spare) for side in (0, 1))
    else:
        left = right = SignatureTree(order, sizes, bits, spare)
    num, den = spaces.num, spaces.den

    def leaves(a: int, b: int) -> None:
        left_at, right_at = left.members[left.under(0, a)], right.members[right.under(0, b)]
        step = max(1, _AT_ONCE // (len(right_at) * bits.shape[1]))
        for first in range(0, len(left_at), step):
            some = left_at[first : first + step]
            apart = group[some][:, None] != group[right_at]
            if left is right and a == b:
                apart &= np.arange(first, first + len(some))[:, None] < np.arange(len(right_at))
            if not apart.any():
                continue
            most = np.bitwise_count(bits[some][:, None] & bits[right_at]).sum(axis=-1, dtype=np.int64)
            most += np.minimum(spare[some][:, None], spare[right_at])
            x, y = sizes[some][:, None], sizes[right_at]
            apart &= np.minimum(most, np.minimum(x, y)) >= -(-num * (x + y) // (num + den))
            for k in np.flatnonzero(apart.any(axis=1)).tolist():
                at = right_at[apart[k]]
                if len(at := at[group[at] != group[some[k]]]):
                    visit(some[k], at)

    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        low_a, high_a, sign_a, extra_a = (x[a] for x in left.levels[la])
        low_b, high_b, sign_b, extra_b = (x[b] for x in right.levels[lb])
        if den * high_a < num * low_b or den * high_b < num * low_a:
            continue
        groups = group[left.members[left.under(la, a)]]
        if (groups == groups[0]).all() and (group[right.members[right.under(lb, b)]] == groups[0]).all():
            continue
        common = int(np.bitwise_count(sign_a & sign_b).sum()) + min(extra_a, extra_b)
        if min(common, high_a, high_b) < spaces.least_common(int(low_a + low_b)):
            continue
        if la == 0 and lb == 0:
            leaves(a, b)
        elif left is right and la == lb:
            # both step down; of a node with itself only one order of each pair
            ca, cb = left.children(la, a), right.children(lb, b)
            stack += [(la - 1, x, lb - 1, y) for x in ca for y in cb if a != b or x <= y]
        elif la >= lb:
            stack += [(la - 1, x, lb, b) for x in left.children(la, a)]
        else:
            stack += [(la, a, lb - 1, y) for y in right.children(lb, b)]


def _numbered(labels: list[int]) -> np.ndarray:
    number = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    return np.array([number[x] for x in labels])


def tree_links(sets: list[np.ndarray], labels: list[int], sides: list[int], spaces: Spaces) -> list[tuple[int, int]]:
    """Pairs (i, j) that link what ``labels`` doesn't join yet: enough of them to join all that links."""
    sizes = np.array([len(s) for s in sets])
    width = width_for(int(sizes.max()), 16, 15)
    bits = np.stack([bitmap(s, width).view(np.uint64) for s in sets])
    group, found = _numbered(labels), []

    def compare(i: int, at: np.ndarray) -> None:
        for j in at.tolist():
            if group[i] != group[j] and spaces.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j], assume_unique=True))):
                found.append((i, j))
                group[group == group[j]] = group[i]

    walk_pairs(sizes, bits, group, sides, spaces, compare)
    return found


def tree_sift(sizes: list[int], bitmaps: list[np.ndarray], labels: list[int], sides: list[int], spaces: Spaces) -> np.ndarray:
    """Which sets some set of another label may link with, by bitmaps of any widths."""
    width = min(len(b) for b in bitmaps) * 8
    bits = np.stack([(b if len(b) * 8 == width else folded(b, width)).view(np.uint64) for b in bitmaps])
    alive = np.zeros(len(sizes), bool)

    def visit(i: int, at: np.ndarray) -> None:
        alive[i] = alive[at] = True

    walk_pairs(np.array(sizes), bits, _numbered(labels), sides, spaces, visit)
    return alive


_TASK = ["route", "low", "high"]
_LINK = {"a": pa.int64(), "b": pa.int64()}
_ALIVE = {"route": pa.int64(), "low": pa.int32(), "high": pa.int32(), "block": pa.int32(), "set_id": pa.int64(), "label": pa.int64()}


def _by_task(batches, what: str) -> Iterator[list[dict]]:
    """The rows of each task (route, low, high), from rows sorted by it, a class once."""
    columns = (*_ALIVE, what)
    task, held = None, {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:3] != task:
                if len(held) > 1:
                    yield list(held.values())
                task, held = row[:3], {}
            held[row[4]] = dict(zip(columns, row))
    if len(held) > 1:
        yield list(held.values())


def _open(rows: list[dict]) -> bool:
    return len({r["label"] for r in rows}) > 1


def _sides(rows: list[dict]) -> list[int]:
    return [0 if r["low"] == r["high"] else int(r["block"] == r["high"]) for r in rows]


def _flushed(kind: dict, rows: Iterator[list[tuple]], most: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for found in rows:
        out += found
        if len(out) >= most:
            yield arrow_batches(kind, dict(zip(kind, zip(*out))))
            out = []
    if out:
        yield arrow_batches(kind, dict(zip(kind, zip(*out))))


def _walk(num: int, den: int):
    """Links of each task's classes, by their elements."""

    def links(rows: list[dict]) -> list[tuple]:
        sets = [np.frombuffer(r["elements"], np.uint64) for r in rows]
        found = tree_links(sets, [r["label"] for r in rows], _sides(rows), Spaces(num, den))
        return [(rows[i]["set_id"], rows[j]["set_id"]) for i, j in found]

    return lambda batches: _flushed(_LINK, (links(rows) for rows in _by_task(batches, "elements") if _open(rows)))


def _sift(num: int, den: int):
    """The rows of each task that some other one of it may link with, by bitmaps."""

    def left(rows: list[dict]) -> list[tuple]:
        sizes = [int.from_bytes(r["bits"][:8], "little") for r in rows]
        maps = [np.frombuffer(r["bits"], np.uint8, offset=8) for r in rows]
        alive = tree_sift(sizes, maps, [r["label"] for r in rows], _sides(rows), Spaces(num, den))
        return [tuple(r[c] for c in _ALIVE) for r, a in zip(rows, alive) if a]

    return lambda batches: _flushed(_ALIVE, (left(rows) for rows in _by_task(batches, "bits") if _open(rows)))


def _tasks(assigned: DataFrame, bytes_each: float, block_bytes: int) -> DataFrame:
    """(route, low, high, block, set_id, label): the tasks of the classes assigned (route, set_id, label, n).

    A route whose classes take more than ``block_bytes`` (``bytes_each`` an element) is cut into blocks; a task
    is a pair of blocks."""
    taken = F.sum(F.col("n") * bytes_each + 64) / F.lit(float(block_bytes))
    blocks = assigned.groupBy("route").agg(F.ceil(taken).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("low"), F.greatest("block", x).alias("high"))
    )
    placed = assigned.join(blocks, "route").withColumn("block", block)
    return placed.select("route", "set_id", "label", "block", F.inline(pairs)).select(*_ALIVE)


# Tells groups of the same classes: their number and two sums of hashes.
def _members() -> list:
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    return [F.count("*").alias("members"), total("set_id").alias("digest"), total(F.lit(3), "set_id").alias("digest2")]


def _run(rows: DataFrame, what: str, function, schema: str) -> DataFrame:
    return rows.select(*_ALIVE, what).repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(function, schema)


def _sets(k: int):
    """set_id, elements and bits (the number of elements, then a bitmap) of the classes asked for."""
    kind = {"set_id": pa.int64(), "elements": pa.binary(), "bits": pa.binary()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("set_id").to_pylist()
            for first, raw, off in text_chunks(batch.column("text")):
                names, elements, bits = [], [], []
                for name, s in zip(wanted[first:], shingle_sets(raw, off, k)):
                    if len(s) and set_id(s) == name:
                        names.append(name)
                        elements.append(s.tobytes())
                        bits.append(len(s).to_bytes(8, "little") + bitmap(s, width_for(len(s), 4, 16)).tobytes())
                if names:
                    yield arrow_batches(kind, {"set_id": names, "elements": elements, "bits": bits})

    return run


def _worthwhile(met: DataFrame) -> DataFrame:
    """Of (route, set_id, mark) the classes, in each space, of which as many routes are met as a link needs: a class's
    rows are brought together once, told apart and counted there. They are as many as a set has routes."""
    dealt = met.repartition("set_id").distinct().withColumn("n", F.count("*").over(Window.partitionBy("set_id", "mark")))
    return dealt.where(F.col("n") >= F.shiftright("mark", 6)).select("route", "set_id")


def _with_heads(met: DataFrame) -> DataFrame:
    """(route, set_id, head) of the routes that are still met, with the least of a route's classes."""
    ends = met.groupBy("route").agg(F.min("set_id").alias("head"), F.max("set_id").alias("last")).where("head != last")
    return met.join(ends.select("route", "head"), "route")


def _links_of_large(
    tables: Tables, met: DataFrame, star: DataFrame, clusters: DataFrame, sizes: DataFrame, sets: DataFrame, num: int, den: int, block_bytes: int, links: DataFrame
) -> DataFrame:
    """``links`` with those of sets whose clusters don't fit a task: from ``met`` (route, set_id, head) and ``star``
    (set_id, head and how many routes they meet on). A route's sets are of one cluster."""
    links_of = lambda tasks: _run(tasks, "elements", _walk(num, den), "a long, b long")
    # each class goes once to the head that it meets most
    star = star.join(clusters.where("fits"), "set_id", "left_anti")
    best = star.groupBy("set_id").agg(F.max_by("head", F.struct("times", "head")).alias("route"))
    heads = best.select(F.col("route").alias("set_id"), "route")
    first = tables.store(best.select("set_id", "route").union(heads).distinct(), "first")
    tasks = _tasks(first.withColumn("label", F.col("set_id")).join(sizes, "set_id"), 8, block_bytes)
    nearest = tables.store(links_of(tasks.join(sets.select("set_id", "elements"), "set_id")), "links")
    found = components(nearest, tables)

    # routes that still hold different components, one of those with equal members. A route's head is one of its sets,
    # so labels are compared once for each set and head, not on each route they meet on
    labels = found.select(F.col("node").alias("set_id"), F.col("component").alias("label"))
    large = sizes.join(clusters.where("not fits").select("set_id"), "set_id")
    known = tables.store(large.join(labels, "set_id", "left").select("set_id", "n", F.coalesce("label", "set_id").alias("label")), "labels")
    of_head = known.select(F.col("set_id").alias("head"), F.col("label").alias("of_head"))
    apart = star.join(known, "set_id").join(of_head, "head").where("label != of_head").select("set_id", "head")
    mixed = met.join(apart, ["set_id", "head"], "left_semi").select("route").distinct()
    members = met.join(mixed, "route").groupBy("route").agg(*_members())
    mixed = members.groupBy("members", "digest", "digest2").agg(F.min("route").alias("route")).select("route")
    rest = tables.store(met.join(mixed, "route").join(known, "set_id", "left").select("route", "set_id", "label", "n"), "open")
    tables.drop(first, found, known)
    short = _tasks(rest, 1, block_bytes).join(sets.select("set_id", "bits"), "set_id")
    alive = ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in _ALIVE.items())
    sifted = tables.store(_run(short, "bits", _sift(num, den), alive), "sifted")
    tables.drop(rest)
    # of tasks with equal members one is enough, but for those between two blocks, whose pairs differ
    between = F.when(F.col("low") != F.col("high"), F.struct(*_TASK))
    groups = sifted.groupBy(*_TASK).agg(*_members()).groupBy("members", "digest", "digest2", between).agg(F.min(F.struct(*_TASK)).alias("task"))
    last = sifted.join(groups.select("task.*"), _TASK)
    more = tables.store(links.union(nearest).union(links_of(last.join(sets.select("set_id", "elements"), "set_id"))), "links")
    tables.drop(sifted, nearest, links)
    return more


def near_duplicates(docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, block_bytes: int = 24 << 20, often: int = 64, cluster_sets: int = 2048) -> DataFrame:
    """doc_id (of any type that can be ordered and hashed), n_shingles and component_id of every row of ``docs``.

    Rows whose shingle sets have a Jaccard similarity of num / den or more are linked; component_id is the
    smallest doc_id that is reached by links, the row's own included. A null or empty text, or one without
    words, has no shingles, links with nothing and is its own component. Null doc_ids are passed over where a
    smallest is taken (a component of nothing else has a null id). Rows with one doc_id are rows of their own.
    A very long text has as many routes as its size asks for; its set is held by a task alone with those it meets.
    Columns other than doc_id and text are ignored; an empty table gives an empty result."""
    tables = Tables(docs.sparkSession)
    # a document is found again by its id, without one by its text, and then told by its class
    docs = docs.select("doc_id", "text").withColumn("ref", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))))
    id_type = docs.schema["doc_id"].dataType
    schema = f"key long, set_id long, n long, doc_id {id_type.simpleString()}"
    routed = docs.mapInArrow(_routed(shingle_words, num, den, to_arrow_type(id_type), often=often), schema)
    part = F.when(F.col("n") < 0, F.shiftright(-1 - F.col("n"), _SALT)).otherwise(0)
    dealt = routed.repartition("key", part).sortWithinPartitions("key", part, "set_id")
    all_met = tables.store(dealt.mapInArrow(_met, schema), "met")
    rows = all_met.where("n >= 0").select("doc_id", F.col("key").alias("ref"), "set_id", "n")
    classes = tables.store(rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("ref").alias("ref"), F.min("n").alias("n")), "classes")
    sizes = classes.select("set_id", "n")

    met = all_met.where("n < 0").select(F.col("key").alias("route"), "set_id", (-1 - F.col("n")).alias("mark"))
    worthwhile = tables.store(_worthwhile(met), "worthwhile")
    met = tables.store(_with_heads(worthwhile), "met-again")  # what only met those that left leaves too
    tables.drop(worthwhile)
    links_of = lambda tasks: _run(tasks, "elements", _walk(num, den), "a long, b long")

    # what can meet at all, over any number of routes: a cluster that fits a task is walked there, each set sent once
    star = tables.store(met.where("set_id != head").groupBy("set_id", "head").agg(F.count("*").alias("times")), "star")
    reached = components(star.select(F.col("set_id").alias("a"), F.col("head").alias("b")), tables).withColumnsRenamed({"node": "set_id", "component": "cluster"})
    total = reached.join(sizes, "set_id").groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(F.col("n") * 8 + 64).alias("bytes"))
    fits = (F.col("sets") <= cluster_sets) & (F.col("bytes") <= block_bytes)
    clusters = tables.store(reached.join(total.select("cluster", fits.alias("fits")), "cluster"), "clusters")
    # a sort-merge join at any size: the plan doesn't turn with what happens to fit a broadcast
    wanted = classes.join(clusters.select("set_id"), "set_id").select("ref", "set_id")
    texts = docs.select("ref", "text").join(wanted.hint("merge"), "ref").groupBy("ref", "set_id", F.xxhash64("text")).agg(F.first("text").alias("text"))
    sets = tables.store(texts.select("set_id", "text").mapInArrow(_sets(shingle_words), "set_id long, elements binary, bits binary"), "sets")
    one = lambda c: F.lit(0).alias(c)
    small = clusters.where("fits").select(F.col("cluster").alias("route"), one("low"), one("high"), one("block"), "set_id", F.col("set_id").alias("label"))
    links = tables.store(links_of(small.join(sets.select("set_id", "elements"), "set_id")), "links")
    if not clusters.where("not fits").isEmpty():
        links = _links_of_large(tables, met, star, clusters, sizes, sets, num, den, block_bytes, links)
    found = components(links, tables)

    joined = classes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reached = joined.join(smallest, "component").select("set_id", "component_id")
    with_words = rows.where("set_id is not null").join(reached, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = rows.where("set_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    result = tables.store(with_words.union(without), "near-duplicates")
    tables.drop_others(result)
    return result


def oracle_sql(shingle_words: int = 5, num: int = 80, den: int = 100) -> str:
    """DuckDB SQL for near_duplicates() over documents: all pairs that share a shingle, and the closure of the links.
    For small tables."""
    k = shingle_words
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc, min(root) AS root FROM r GROUP BY 1) c ON c.doc = d.doc_id"""
