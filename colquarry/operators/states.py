"""Mergeable states of columns: one scan fills them for all columns, and states of tasks, files or days add up.

Spark reduces each value to what the state needs (a number, a hash, a length and pattern flags, milliseconds), and tasks
fold Arrow batches of these into a state for each column: counts, central moments, bounds, a sketch of quantiles (KLL) and one of
distinct values. A state is a row of plain columns and two binary ones. States merge by a tree: groups of a bounded number
first, then these, so neither a task nor the driver ever holds those of all tasks.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars as S

#: Items that the top level of a quantile sketch holds; all levels hold three times as many. Ranks are off by about 1 / QUANTILE_ITEMS.
QUANTILE_ITEMS = 2048
#: Hashes that are kept one by one; more go into 2 ** DISTINCT_BITS registers, with an error of 0.8 %.
DISTINCT_EXACT, DISTINCT_BITS = 2048, 14
#: States that one task merges.
FAN_IN = 256


class Quantiles:
    """A KLL sketch: sorted values by levels; one of level k stands for 2 ** k values. A level that is too full is sorted and every other
    value of it goes up, beginning with the first and the second in turn."""

    def __init__(self, items: int = QUANTILE_ITEMS, levels: list[np.ndarray] | None = None, turn: int = 0) -> None:
        self.items, self.levels, self.turn = items, levels or [np.zeros(0)], turn

    def _most(self, level: int) -> int:
        return max(8, math.ceil(self.items * (2 / 3) ** (len(self.levels) - 1 - level)))

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            values = self.levels[level]
            if len(values) > self._most(level):
                if level + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                values = np.sort(values)
                even = len(values) // 2 * 2
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], values[self.turn : even : 2]])
                self.levels[level], self.turn = values[even:], 1 - self.turn
                level = -1 if level else level  # one more level lowers what those below may hold
            level += 1

    def add(self, values: np.ndarray) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, other: Quantiles) -> None:
        self.levels += [np.zeros(0) for _ in range(len(other.levels) - len(self.levels))]
        for k, values in enumerate(other.levels):
            self.levels[k] = np.concatenate([self.levels[k], values])
        self._compress()

    def at(self, shares: list[float] | tuple[float, ...]) -> list[float]:
        """The least kept value that at least this share of all values doesn't exceed."""
        values = np.concatenate(self.levels)
        if not len(values):
            return [0.0 for _ in shares]
        weights = np.repeat([1 << k for k in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        return [float(values[order][min(np.searchsorted(ranks, math.ceil(q * int(ranks[-1])), side="left"), len(values) - 1)]) for q in shares]

    def pack(self) -> bytes:
        head = struct.pack(f"<{3 + len(self.levels)}i", self.items, self.turn, len(self.levels), *map(len, self.levels))
        return head + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Quantiles:
        items, turn, n = struct.unpack_from("<3i", data)
        lengths = struct.unpack_from(f"<{n}i", data, 12)
        values = np.frombuffer(data, "<f8", offset=12 + 4 * n)
        return cls(items, [x.copy() for x in np.split(values, np.cumsum(lengths)[:-1])], turn)


class Distinct:
    """Distinct hashes: themselves while they are few, else for each of many classes the longest run of zeros seen (HyperLogLog)."""

    def __init__(self, hashes: np.ndarray | None = None, registers: np.ndarray | None = None) -> None:
        self.hashes, self.registers = np.zeros(0, np.uint64) if hashes is None else hashes, registers

    def add(self, hashes: np.ndarray) -> None:
        if self.registers is None:
            self.hashes = np.unique(np.concatenate([self.hashes, hashes]))
            if len(self.hashes) <= DISTINCT_EXACT:
                return
            hashes, self.hashes, self.registers = self.hashes, np.zeros(0, np.uint64), np.zeros(1 << DISTINCT_BITS, np.uint8)
        rest = hashes << np.uint64(DISTINCT_BITS) | np.uint64(1 << (DISTINCT_BITS - 1))
        # the place of the highest bit, from the exponent of the upper and, where that is nothing, the lower half
        high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
        zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
        np.maximum.at(self.registers, (hashes >> np.uint64(64 - DISTINCT_BITS)).astype(np.int64), (zeros + 1).astype(np.uint8))

    def merge(self, other: Distinct) -> None:
        if other.registers is None:
            self.add(other.hashes)
            return
        if self.registers is None:
            kept, self.registers = self.hashes, other.registers.copy()
            self.hashes = np.zeros(0, np.uint64)
            self.add(kept)
            return
        np.maximum(self.registers, other.registers, out=self.registers)

    def estimate(self) -> int:
        """Without bias at any number, from how many registers hold each length."""
        if self.registers is None:
            return len(self.hashes)
        m, q = len(self.registers), 64 - DISTINCT_BITS
        counts = np.bincount(self.registers, minlength=q + 2).astype(float)
        x, total, power = counts[0] / m, 0.0, 1.0
        sigma, before = x, -1.0
        while x < 1 and sigma != before:  # registers that nothing has reached
            x, before = x * x, sigma
            sigma, power = sigma + x * power, 2 * power
        x, power = 1 - counts[q + 1] / m, 1.0
        tau, before = 1 - x, -1.0
        while 0 < x < 1 and tau != before:  # registers that are full
            x, before, power = math.sqrt(x), tau, power / 2
            tau -= (1 - x) ** 2 * power
        total = m * tau / 3
        for k in range(q, 0, -1):
            total = (total + counts[k]) / 2
        return round(m * m / (2 * math.log(2)) / (total + m * sigma))

    def pack(self) -> bytes:
        return b"h" + self.hashes.astype("<u8").tobytes() if self.registers is None else b"r" + self.registers.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Distinct:
        return cls(np.frombuffer(data, "<u8", offset=1).astype(np.uint64)) if data[:1] == b"h" else cls(None, np.frombuffer(data, np.uint8, offset=1).copy())


#: Pattern flags of a text, in the order of their bits.
FLAGS = ("empty_count", "whitespace_count", "numeric", "email", "uuid", "iso_date")
_SUMS = ("row_count", "null_count", "numbers", "texts", "text_bytes", *FLAGS, "true_count", "false_count", "times")
_LEAST, _MOST = ("least", "low", "text_least", "time_least"), ("most", "high", "text_most", "time_most")
_MOMENTS = ("mean", "m2", "m3", "m4")
STATE = "column string, " + ", ".join(
    [f"{k} long" for k in _SUMS] + [f"{k} {'double' if k in ('least', 'low', 'most', 'high') else 'long'}" for k in (*_LEAST, *_MOST)] + [f"{k} double" for k in _MOMENTS]
) + ", quantiles binary, distinct binary"


@dataclass
class State:
    """What is known of a column: sums, bounds (None without values), central moments of its numbers, sketches."""

    sums: dict[str, int] = field(default_factory=lambda: dict.fromkeys(_SUMS, 0))
    bounds: dict[str, float | int | None] = field(default_factory=lambda: dict.fromkeys((*_LEAST, *_MOST)))
    moments: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    quantiles: Quantiles = field(default_factory=Quantiles)
    distinct: Distinct = field(default_factory=Distinct)

    def _bound(self, name: str, value: float | int | None) -> None:
        old = self.bounds[name]
        if value is not None:
            self.bounds[name] = value if old is None else (min if name in _LEAST else max)(old, value)

    def _moments(self, n: int, other: tuple[float, float, float, float]) -> None:
        """Those of both together (the pairwise formulas of Chan, Golub and LeVeque)."""
        a, b = self.sums["numbers"], n
        if not a or not b:
            self.moments = other if b else self.moments
            return
        (ma, a2, a3, a4), (mb, b2, b3, b4), t = self.moments, other, a + b
        d = mb - ma
        self.moments = (
            ma + d * b / t, a2 + b2 + d * d * a * b / t, a3 + b3 + d**3 * a * b * (a - b) / t / t + 3 * d * (a * b2 - b * a2) / t,
            a4 + b4 + d**4 * a * b * (a * a - a * b + b * b) / t**3 + 6 * d * d * (a * a * b2 + b * b * a2) / t / t + 4 * d * (a * b3 - b * a3) / t,
        )

    def numbers(self, x: np.ndarray) -> None:
        if not len(x):
            return
        mean = x.mean()
        d = x - mean
        d2 = d * d
        self._moments(len(x), (float(mean), float(d2.sum()), float((d2 * d).sum()), float((d2 * d2).sum())))
        self.sums["numbers"] += len(x)
        self._bound("least", float(x.min()))
        self._bound("most", float(x.max()))
        finite = x[np.isfinite(x)]
        if len(finite):
            self._bound("low", float(finite.min()))
            self._bound("high", float(finite.max()))
        self.quantiles.add(x)

    def merge(self, other: State) -> None:
        self._moments(other.sums["numbers"], other.moments)
        for k in _SUMS:
            self.sums[k] += other.sums[k]
        for k in (*_LEAST, *_MOST):
            self._bound(k, other.bounds[k])
        self.quantiles.merge(other.quantiles)
        self.distinct.merge(other.distinct)

    def row(self, column: str) -> dict:
        return {"column": column, **self.sums, **self.bounds, **dict(zip(_MOMENTS, self.moments)), "quantiles": self.quantiles.pack(), "distinct": self.distinct.pack()}

    @classmethod
    def of(cls, row: dict) -> State:
        return cls({k: row[k] for k in _SUMS}, {k: row[k] for k in (*_LEAST, *_MOST)}, tuple(row[k] for k in _MOMENTS), Quantiles.unpack(row["quantiles"]), Distinct.unpack(row["distinct"]))


def kind(t: T.DataType) -> str | None:
    tests = {"numeric": T.NumericType, "string": T.StringType, "boolean": T.BooleanType, "temporal": (T.DateType, T.TimestampType, T.TimestampNTZType)}
    return next((k for k, types in tests.items() if isinstance(t, types)), None)


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _inputs(df: DataFrame, fields: dict[str, T.DataType], unit: Column) -> DataFrame:
    """unit, then for each column: k whether it has a value, or h the hash of it; and x a number, s and f a text's bytes and flags, b, t.
    Written as SQL, which the JVM parses at once, where a tree of a thousand columns built from here takes seconds."""
    out = [unit.alias("unit")]
    for i, (c, t) in enumerate(fields.items()):
        x, of = quoted(c), kind(t)
        sql = [f"{x} IS NOT NULL AS k{i}" if isinstance(t, (T.MapType, T.VariantType)) else f"CASE WHEN {x} IS NOT NULL THEN xxhash64({x}) END AS h{i}"]
        if of == "numeric":
            sql.append(f"CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) END AS x{i}")
        elif of == "string":
            tests = (f"{x} = ''", *(f"{x} RLIKE r'{p}'" for p in (S.BLANK, S.NUMERIC, S.EMAIL, S.UUID, S.ISO_DATE)))
            flags = " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, test in enumerate(tests))
            sql += [f"octet_length({x}) AS s{i}", f"CASE WHEN {x} IS NOT NULL THEN {flags} END AS f{i}"]
        elif of == "boolean":
            sql.append(f"{x} AS b{i}")
        out += map(F.expr, sql)
        if of == "temporal":
            out.append(S.epoch_ms(F.col(x), t).alias(f"t{i}"))
    return df.select(*out)


def _known(x: pa.Array) -> np.ndarray:
    return x.drop_null().to_numpy(zero_copy_only=False)


def _folded(names: list[str]):
    arrow = to_arrow_schema(T._parse_datatype_string("unit long, " + STATE))

    def run(batches) -> Iterator[pa.RecordBatch]:
        states: list[State] = []
        unit = None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"unit": unit, **s.row(c)} for c, s in zip(names, states)], schema=arrow)

        for batch in batches:
            units = batch.column("unit").to_numpy()
            edges = np.flatnonzero(np.diff(units, prepend=units[:1] - 1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(units)]):
                if unit is None or units[a] != unit:
                    if states:
                        yield rows()
                    unit, states = int(units[a]), [State() for _ in names]
                part = batch.slice(a, b - a)
                for name, x in zip(part.schema.names[1:], part.columns[1:]):
                    _fold(states[int(name[1:])], name[0], x)
        if states:
            yield rows()

    return run


def _fold(state: State, what: str, x: pa.Array) -> None:
    sums = state.sums
    if what in "hk":
        sums["row_count"] += len(x)
        nulls = x.null_count if what == "h" else len(x) - x.true_count
        sums["null_count"] += nulls
        if what == "h" and nulls < len(x):
            state.distinct.add(_known(x).view(np.uint64))
    elif what == "x":
        with np.errstate(all="ignore"):
            state.numbers(_known(x))
    elif what == "s" and x.null_count < len(x):
        sizes = _known(x)
        sums["texts"] += len(sizes)
        sums["text_bytes"] += int(sizes.sum(dtype=np.int64))
        state._bound("text_least", int(sizes.min()))
        state._bound("text_most", int(sizes.max()))
    elif what == "f":
        by = np.bincount(_known(x), minlength=1 << len(FLAGS))
        for k, name in enumerate(FLAGS):
            sums[name] += int(by[np.arange(len(by)) >> k & 1 == 1].sum())
    elif what == "b":
        sums["true_count"] += x.true_count
        sums["false_count"] += x.false_count
    elif what == "t" and x.null_count < len(x):
        ms = _known(x)
        sums["times"] += len(ms)
        state._bound("time_least", int(ms.min()))
        state._bound("time_most", int(ms.max()))


def column_states(df: DataFrame, fields: dict[str, T.DataType], unit: Column | None = None) -> DataFrame:
    """unit and the state of each column, a row for each task and for each run of rows with one ``unit`` (a whole number; 0 if not given).
    One scan of the columns in ``fields``."""
    unit = F.lit(0).cast("long") if unit is None else unit
    return _inputs(df, fields, unit).mapInArrow(_folded(list(fields)), "unit long, " + STATE)


def _merge_rows(rows: list[dict]) -> State:
    whole = State.of(rows[0])
    for r in rows[1:]:
        whole.merge(State.of(r))
    return whole


def merged(states: DataFrame, count: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The states with one column (and ``by``) as one. ``count``: states of a column, about; above FAN_IN, groups of about so many of
    them merge first."""
    arrow = to_arrow_schema(T.StructType([*(states.schema[c] for c in by), *T._parse_datatype_string(STATE)]))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        with np.errstate(all="ignore"):
            return pa.Table.from_pylist([{**{c: rows[0][c] for c in by}, **_merge_rows(rows).row(rows[0]["column"])}], schema=arrow)

    schema = T.StructType([*(states.schema[c] for c in by), *T._parse_datatype_string(STATE)])
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        dealt = states.withColumn("_deal", F.floor(F.rand(1) * count))
        states = dealt.groupBy(*by, "column", "_deal").applyInArrow(merge, schema)
    return states.groupBy(*by, "column").applyInArrow(merge, schema)
